"""Scans: text lines, tolerant JSON lines, inbox files, telemetry CSV, stores and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEEDBACK = "id string, source string, tier string, text string, confidence double, verification_status string, context string"
# The feature columns of a telemetry row, before label and hardness.
FEATURES = [
    "duration", "protocol", "service", "flag", "srcbytes", "dstbytes", "land", "wrongfragment", "urgent", "hot", "numfailedlogins", "loggedin",
    "numcompromised", "rootshell", "suattempted", "numroot", "numfilecreations", "numshells", "numaccessfiles", "numoutboundcmds", "ishostlogin",
    "isguestlogin", "count", "srvcount", "serrorrate", "srvserrorrate", "rerrorrate", "srvrerrorrate", "samesrvrate", "diffsrvrate", "srvdiffhostrate",
    "dsthostcount", "dsthostsrvcount", "dsthostsamesrvrate", "dsthostdiffsrvrate", "dsthostsamesrcportrate", "dsthostsrvdiffhostrate",
    "dsthostserrorrate", "dsthostsrvserrorrate", "dsthostrerrorrate", "dsthostsrvrerrorrate",
]

# Attack labels of the training rows; any other label but normal is unknown there.
ATTACKS = [
    "back", "buffer_overflow", "ftp_write", "guess_passwd", "imap", "ipsweep", "land", "loadmodule", "multihop", "neptune", "nmap", "perl", "phf",
    "pod", "portsweep", "rootkit", "satan", "smurf", "spy", "teardrop", "warezclient", "warezmaster",
]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): non-blank lines of text files; files split across tasks."""
    d = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    return d.where(F.length(F.trim("line")) > 0)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): JSON lines under a schema; lines that do not parse are kept as rejects, not fatal."""
    s = T._parse_datatype_string(schema).add("_corrupt", "string")
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = raw.select("value", F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r._corrupt is null").select("r.*").drop("_corrupt")
    return good, parsed.where("r._corrupt is not null").select(F.col("value").alias("line"))


def inbox_rows(df: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """Rows of whole inbox files (path, value): .txt one row per line, .json an object or a list, .jsonl a row per line.

    Rows without text are dropped. Works on static and streaming frames alike."""
    item = T._parse_datatype_string(FEEDBACK)
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    is_txt, is_list = F.col(path).endswith(".txt"), F.trim(F.col(text)).startswith("[")
    plain = F.transform(lines, lambda x: F.struct(*[(x if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in item.fields]))
    listed = F.from_json(text, T.ArrayType(item))
    by_line = F.transform(lines, lambda x: F.from_json(x, item))
    # A pretty-printed object over several lines parses as a whole but not line by line.
    lined = F.col(path).endswith(".jsonl") | F.from_json(F.get(lines, F.lit(0)), item)["text"].isNotNull()
    rows = F.when(is_txt, plain).when(is_list, listed).when(lined, by_line).otherwise(F.array(F.from_json(text, item)))
    return df.select(F.explode(rows).alias("r"), F.col(path)).select("r.*", path).where(F.length(F.trim("text")) > 0)


def telemetry_csv(lines: DataFrame, col: str = "line", strict: bool = False, domain: bool = False) -> DataFrame:
    """(label, known, alert): alert rows of positional CSV lines: 41 features, label, hardness.

    A label is known if it is normal or one of ATTACKS. Held-out rows may have other labels of
    lower-case letters, digits and underscores; with domain only known ones are well formed. Malformed rows raise
    when strict, else come out with alert = null for the caller to count."""
    f = F.split(col, ",", -1)
    n = len(FEATURES)
    label = F.get(f, F.lit(n))
    known = F.coalesce(label.isin("normal", *ATTACKS), F.lit(False))
    ok = (F.size(f) == n + 2) & (known if domain else known | label.rlike("^[a-z0-9_]+$"))
    parts = F.concat_ws(" ", *[F.concat(F.lit(x + "="), F.get(f, F.lit(i))) for i, x in enumerate(FEATURES)])
    alert = F.concat(F.lit("ALERT "), parts, F.lit(" | EARLY_WARNING "), label, F.lit(" HARDNESS="), F.get(f, F.lit(n + 1)))
    bad = F.raise_error(F.lit("malformed telemetry row")) if strict else F.lit(None)
    return lines.select(label.alias("label"), known.alias("known"), F.when(ok, alert).otherwise(bad.cast("string")).alias("alert"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, doc): one JSON document per file, kept as text so that documents of any shape coexist."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("run_id"), F.col("value").alias("doc"))
    return d.orderBy("run_id")


def evaluation_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, items) of a question set: facts one row each, items one row per gold fact."""
    schema = "facts array<struct<id:string,content:string,kind:string,confidence:double>>, items array<struct<id:string,question:string,gold_fact_ids:array<string>>>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    facts = d.select(F.explode("facts").alias("f")).select("f.*")
    items = d.select(F.explode("items").alias("i")).select("i.id", "i.question", F.explode("i.gold_fact_ids").alias("gold_fact_id"))
    return facts, items


def list_files(spark: SparkSession, root: str, pattern: str = "*", skip: str = r"/(\.git|__pycache__|node_modules)/") -> DataFrame:
    """(path, length): files under a root by glob, noise folders left out; nothing outside the root is reached."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return d.select("path", "length").where(~F.col("path").rlike(skip)).orderBy("path")


def open_store(spark: SparkSession, path: str, embedder: dict) -> DataFrame:
    """Active, embedded records of a store; refuses another schema version or embedding configuration."""
    meta = spark.read.json(f"{path}/meta").first().asDict()
    if meta.get("schema") != 1:
        raise ValueError(f"store schema {meta.get('schema')} is not 1")
    if meta.get("embedder") != str(sorted(embedder.items())):
        raise ValueError("the store was embedded with another configuration")
    return spark.read.parquet(f"{path}/records").where("state = 'active' and embedding is not null")
