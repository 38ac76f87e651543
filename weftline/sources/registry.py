"""A registry of artifacts: immutable entries by content hash, one active entry a name, rollback to the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.writers import current, snapshot

SCHEMA = "name string, semver string, sha256 string, config_id string, created_at string, active boolean, superseded_by string"


class Registry:
    """Entries in the folder `path`; every change is a new snapshot. A registry holds artifacts, not records, and stays small."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        try:
            rows = current(spark, path).collect()
        except ValueError:
            rows = []
        self.entries = {r["sha256"]: r.asDict() for r in rows}

    def frame(self) -> DataFrame:
        order = sorted(self.entries.values(), key=lambda e: (e["created_at"], e["sha256"]))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(e[c] for c in names) for e in order], SCHEMA)

    def save(self) -> int:
        return snapshot(self.frame().coalesce(1), self.path)

    def register(self, name: str, semver: str, sha256: str, config_id: str, created_at: str) -> dict:
        """Adds an entry; the same one again changes nothing. A hash that is registered under another
        name or version, and an entry without a configuration, are errors."""
        if not config_id:
            raise ValueError("an artifact needs a configuration id")
        known = self.entries.get(sha256)
        if known is None:
            known = {"name": name, "semver": semver, "sha256": sha256, "config_id": config_id, "created_at": created_at, "active": False, "superseded_by": None}
            self.entries[sha256] = known
        elif (known["name"], known["semver"]) != (name, semver):
            raise ValueError(f"{sha256[:12]} is registered as {known['name']} {known['semver']}")
        return known

    def history(self, name: str) -> list[dict]:
        """Entries of a name, oldest first."""
        return sorted((e for e in self.entries.values() if e["name"] == name), key=lambda e: (e["created_at"], e["sha256"]))

    def active(self, name: str) -> dict | None:
        """The promoted entry, else the newest one."""
        past = self.history(name)
        return next((e for e in past if e["active"]), past[-1] if past else None)

    def promote(self, name: str, sha256: str) -> dict:
        """Makes a registered entry the active one; the one before stays, and says what replaced it."""
        if self.entries.get(sha256, {}).get("name") != name:
            raise ValueError(f"{sha256[:12]} is not registered as {name}")
        for e in self.history(name):
            if e["active"] and e["sha256"] != sha256:
                e["superseded_by"] = sha256
            e["active"] = e["sha256"] == sha256
        return self.entries[sha256]

    def rollback(self, name: str) -> dict | None:
        """Back to the entry registered before the active one; the first stays active, and None comes where none was promoted."""
        past = self.history(name)
        at = next((i for i, e in enumerate(past) if e["active"]), None)
        if at is None:
            return None
        for i, e in enumerate(past):
            e["active"] = i == max(0, at - 1)
        return past[max(0, at - 1)]
