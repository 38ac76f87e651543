"""Character-trigram naive Bayes over languages, scored for whole batches at once."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: How far another language must lead: in logarithm of likelihood a trigram, and over the whole text.
MARGIN, EVIDENCE = 0.35, 5.0
#: By how much a gram prompts must be likelier in another language than in the default: field names and invented names
#: are of no one language and lead by up to 0.2, prose leads by 0.5 and more.
PROMPT_LEAD = 0.4
#: Grams of all languages together that are added to those of each one.
SHARED = 1500.0
#: Labelled texts used to fit have this many characters.
FIT_LEAST, FIT_MOST = 41, 20_000
_KEEP = re.compile(r"\S*(?:\d|[._=/@:\\-](?=\S))\S*")

# Fixed seed texts, written for this module: function words of each language, and sentences of everyday life.
SEEDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who its now find long down day did get come made may part. My grandmother bakes bread every Saturday, and the whole street smells of it. We walked along the river until the rain began. Nothing else happened, none of it was unusual, and nobody had to do anything further. Leave it open for a while, keep it, watch it, put it away, bring it back, ask for it, write it down.",
    "de": "der die das und ist nicht ein eine zu den mit sich auf für von dem des im auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei. Meine Großmutter backt jeden Samstag Brot, und die ganze Straße duftet danach. Wir gingen am Fluss entlang, bis der Regen anfing, und kamen erst spät wieder nach Hause.",
    "fr": "le la les de des du et est que qui dans un une pour pas sur au avec il elle ne se ce cette ces par plus mais ou si leur on son sa ses nous vous ils aux été sont comme tout fait être même aussi. Ma grand-mère fait du pain chaque samedi, et toute la rue en sent l'odeur. Nous avons marché le long de la rivière jusqu'à ce que la pluie commence, puis nous sommes rentrés tard à la maison.",
    "es": "el la los las de del y es que en un una por con no se su para al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante. Mi abuela hace pan todos los sábados y la calle entera huele a él. Caminamos junto al río hasta que empezó la lluvia y volvimos tarde a casa.",
    "nl": "de het een en van ik te dat die in is niet zijn op aan met als voor er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze want nog zal geen moet worden wordt werd waar onder tussen alleen omdat zonder wanneer eerst weer steeds. Mijn grootmoeder bakt elke zaterdag brood en de hele straat ruikt ernaar. Wij liepen langs de rivier totdat het begon te regenen, en kwamen pas laat weer thuis. Het is een mooie dag om buiten te zitten en een boek te lezen. Morgen gaan we naar de markt om appels, kaas en bloemen te kopen voor het feest van mijn zus. De kinderen spelen buiten in de tuin, terwijl hun vader het eten klaarmaakt. Ik heb gisteren een brief geschreven aan een oude vriend die in het noorden woont. Wil je alsjeblieft de deur sluiten en het licht uitdoen voordat je vertrekt? Zij vroeg hoe laat de trein vertrekt en of er nog plaatsen vrij zijn. Het weer was vorige week beter dan deze week, dus blijven wij binnen.",
    "it": "il lo la i gli le di del della e è che un una per non in con su da come più ma anche sono questo si nel alla dei delle ha al se era ed essere stato deve senza tra dopo prima quando ancora molto tutti ogni cui chi dove perché solo loro suo sua. Mia nonna fa il pane ogni sabato e tutta la strada ne profuma. Abbiamo camminato lungo il fiume finché è cominciata la pioggia e siamo tornati a casa tardi. È una bella giornata per sedersi fuori e leggere un libro. Domani andremo al mercato per comprare mele, formaggio e fiori per la festa di mia sorella. I bambini giocano fuori nel giardino mentre il padre prepara la cena. Ieri ho scritto una lettera a un vecchio amico che vive nel nord. Potresti chiudere la porta e spegnere la luce prima di uscire? Lei chiese a che ora parte il treno e se ci fossero ancora posti liberi. Il tempo era migliore la settimana scorsa, quindi restiamo in casa.",
    "pt": "o a os as de do da e é que em um uma para com não por mais como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo deve nenhum todos cada onde porque ainda antes. Minha avó faz pão todos os sábados e a rua inteira cheira a ele. Caminhámos ao longo do rio até começar a chuva e voltámos tarde para casa. Está um bom dia para ficar lá fora e ler um livro. Amanhã vamos ao mercado comprar maçãs, queijo e flores para a festa da minha irmã. As crianças brincam lá fora no jardim enquanto o pai prepara o jantar. Ontem escrevi uma carta a um velho amigo que vive no norte. Podes fechar a porta e apagar a luz antes de sair? Ela perguntou a que horas parte o comboio e se ainda havia lugares. O tempo estava melhor na semana anterior, por isso ficamos em casa.",
    "pl": "i w nie na się z do to że jest o jak po co tak za od ale przez czy dla już jego być tylko lub ten są może tym by był była przed bardzo nad należy oraz przy bez jeszcze gdy który która które więc nawet pod między. Moja babcia piecze chleb w każdą sobotę i cała ulica nim pachnie. Szliśmy wzdłuż rzeki, aż zaczął padać deszcz, i wróciliśmy późno do domu. To dobry dzień, żeby posiedzieć na dworze i poczytać książkę. Jutro pójdziemy na targ kupić jabłka, ser i kwiaty na święto mojej siostry. Dzieci bawią się w ogrodzie, podczas gdy ojciec przygotowuje obiad. Wczoraj napisałem list do starego przyjaciela, który mieszka na północy. Proszę zamknąć drzwi i zgasić światło przed wyjściem. Ona zapytała, o której godzinie odjeżdża pociąg i czy są jeszcze wolne miejsca. Pogoda była lepsza w zeszłym tygodniu, więc zostajemy w domu. Musimy jeszcze sprawdzić, czy wszystko zostało dobrze zrobione i odłożone na swoje miejsce.",
    "ru": "и в не на я что он с как это по но они мы она так его за от все у же из был для вы о бы к до когда если уже или ни был того чтобы только нет мне есть при без надо ещё под между который которая поэтому сначала. Моя бабушка печёт хлеб каждую субботу, и вся улица пахнет им. Мы шли вдоль реки, пока не начался дождь, и поздно вернулись домой. Хороший день, чтобы посидеть на улице и почитать книгу. Завтра мы пойдём на рынок купить яблоки, сыр и цветы к празднику моей сестры. Дети играют в саду, пока отец готовит ужин. Вчера я написал письмо старому другу, который живёт на севере. Она спросила, во сколько отходит поезд и есть ли ещё свободные места.",
    "sv": "och att det i en jag som på är av för med till den har de inte om ett men var han så från vi när nu man hade där eller efter under också ska måste utan mellan innan alla varje bara ännu sedan mycket. Min mormor bakar bröd varje lördag och hela gatan doftar av det. Vi gick längs floden tills regnet började och kom hem sent. I morgon går vi till torget för att köpa äpplen, ost och blommor till min systers fest. Barnen leker ute i trädgården medan pappan lagar mat. I går skrev jag ett brev till en gammal vän som bor i norr. Kan du stänga dörren och släcka ljuset innan du går?",
    "cs": "a se v je na že to s z do o ve pro jako by ale po jsou které byl jeho jen už také podle nebo není před tak bylo své musí bez mezi ještě když který která proto nejprve každý. Moje babička peče chleba každou sobotu a celá ulice po něm voní. Šli jsme podél řeky, dokud nezačalo pršet, a vrátili jsme se domů pozdě. Zítra půjdeme na trh koupit jablka, sýr a květiny na oslavu mé sestry. Děti si hrají venku na zahradě, zatímco otec připravuje večeři. Včera jsem napsal dopis starému příteli, který bydlí na severu. Zavři prosím dveře a zhasni světlo, než odejdeš.",
    "tr": "ve bir bu da için de ile çok gibi daha ama ne o kadar olan olarak sonra en her var ki değil ben mi şey önce bütün hiç sadece hem ya ancak çünkü nasıl bile arasında. Büyükannem her cumartesi ekmek yapar ve bütün sokak onunla kokar. Yağmur başlayana kadar nehir boyunca yürüdük ve eve geç döndük. Yarın kız kardeşimin partisi için elma, peynir ve çiçek almaya pazara gideceğiz. Çocuklar dışarıda bahçede oynarken babaları yemek hazırlıyor. Dün kuzeyde yaşayan eski bir arkadaşıma mektup yazdım. Çıkmadan önce kapıyı kapatır mısın?",
}


def prose(text: str) -> str:
    """The words of a text in lower case without identifiers."""
    return " ".join(re.findall(r"[^\W\d_]+", _KEEP.sub(" ", text.lower())))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character trigrams and bigrams of all texts (words joined by blanks) and the offsets of each text."""
    clean = ["  " + t + "  " for t in words]
    lens = np.fromiter((len(c) for c in clean), np.int64, len(clean))
    cp = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    three, two = np.zeros(len(cp), np.int64), np.zeros(len(cp), np.int64)
    if len(cp) > 2:
        three[:-2] = (cp[:-2] * 961748927 + cp[1:-1] * 49979687 + cp[2:] * 86028121) >> 3
        two[:-1] = (cp[:-1] * 32452843 + cp[1:] * 15485863) >> 3
    return three % BUCKETS, two % BUCKETS, np.concatenate([[0], np.cumsum(lens)])


class LanguageModel:
    """Log-likelihood tables (bucket x language) of character trigrams and bigrams."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        codes = [grams([prose(t) for t in texts[lang]])[:2] for lang in self.langs]
        self.three, self.two = (self._log_shares([c[k] for c in codes]) for k in (0, 1))

    @staticmethod
    def _log_shares(codes: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of grams by language; what a language has little text for is taken from all languages alike."""
        n = np.stack([np.bincount(c, minlength=BUCKETS) for c in codes], 1).astype(float)
        common = 0.99 * (n / np.maximum(1.0, n.sum(0))).mean(1, keepdims=True) + 0.01 / BUCKETS
        return np.log((n + SHARED * common) / (n.sum(0) + SHARED)).astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood of a character's trigram and bigram, of each text and language, and trigram counts."""
        return self.scores_of_words([prose(t) for t in texts])

    def scores_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        three, two, off = grams(words)
        n = np.maximum(1, np.diff(off) - 2)
        if not len(three):
            return np.zeros((len(words), len(self.langs)), np.float32), n
        ll = np.stack([np.add.reduceat(self.three[three, k] + self.two[two, k], off[:-1]) for k in range(len(self.langs))], 1)
        return ll / (2 * n[:, None]), n

    def language_of(self, texts: list[str], default: str = "en", lead: float = PROMPT_LEAD) -> str:
        """The language of highest posterior given all of `texts` together; `default` unless another one leads it by `lead` a gram."""
        s, n = self.scores(texts)
        mean = (s * n[:, None]).sum(0) / max(1, n.sum())
        best = int(mean.argmax())
        return self.langs[best] if mean[best] - mean[self.langs.index(default)] > lead else default

    def languages_of(self, texts: list[str], default: str = "en", lead: float = PROMPT_LEAD, evidence: float = EVIDENCE) -> np.ndarray:
        """The index in `langs` of the language of highest posterior of each text; `default` unless another one leads it by
        `lead` a gram and `evidence` in all."""
        e = self.langs.index(default)
        s, n = (v[:-1] for v in self.scores([*texts, ""]))  # the last text's end has no whole grams
        ahead = s.max(1) - s[:, e]
        return np.where((ahead > lead) & (ahead * n > evidence), s.argmax(1), e)

    def foreign_words(self, words: list[str], expected: str | np.ndarray = "en", margin: float = MARGIN, evidence: float = EVIDENCE) -> np.ndarray:
        """Whether the posterior clearly prefers another language than `expected` (one, or the index of each text's): by
        `margin` a trigram and `evidence` in all, in logarithms, so that a short text needs the plainer signs; or most
        letters are of no Latin script, where the expected language is written in it."""
        s, n = self.scores_of_words(words)
        if not len(words):
            return np.zeros(0, bool)
        e = np.full(len(words), self.langs.index(expected)) if isinstance(expected, str) else expected
        own = np.arange(len(self.langs)) == e[:, None]
        lead = np.where(own, -np.inf, s).max(1) - s[own]
        other_script = np.array([sum(c > "\u024f" for c in w) > sum("a" <= c <= "\u024f" for c in w) for w in words], bool)
        return (other_script & (e != self.langs.index("ru"))) | ((lead > margin) & (lead * n > evidence))


def language_code(c):
    """First two letters of a language name or code, lower case; null for anything else."""
    x = F.substring(F.lower(F.trim(c)), 1, 2)
    return F.when(x.isin(list(SEEDS)), x)


def fit_languages(corpus: DataFrame | None, rows: int = 3000) -> LanguageModel:
    """Naive Bayes tables from the seeds and a bounded sample: at most about `rows` labelled texts of
    `corpus` (text, lang; English, German, French, Spanish) of FIT_LEAST to FIT_MOST characters.
    A text whose label is not what the seeds say is left out: labels are dirty."""
    texts = {k: [v] * 3 for k, v in SEEDS.items()}
    seeds = LanguageModel(texts)
    if corpus is not None:
        lab = corpus.select("text", language_code(F.col("lang")).alias("l")).where("l in ('en', 'de', 'fr', 'es')")
        got = sample_texts(lab, rows)
        for r, ok in zip(got, _agrees(seeds, [r["text"] for r in got], [r["l"] for r in got])):
            if ok:
                texts[r["l"]].append(r["text"])
    return LanguageModel(texts)


def sample_texts(df: DataFrame, rows: int) -> list:
    """At most about `rows` rows of df (text, ...), spread over the table by a hash of the text, of FIT_LEAST to FIT_MOST characters."""
    df = df.where(f"length(text) between {FIT_LEAST} and {FIT_MOST}")
    n = df.count()
    share = min(1.0, rows / max(1, n))
    return df.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * rows).collect()


def _agrees(model: LanguageModel, texts: list[str], langs: list[str]) -> np.ndarray:
    """Whether each label is the seed model's choice (labels are dirty)."""
    if not texts:
        return np.zeros(0, bool)
    return np.array(model.langs)[model.scores(texts)[0].argmax(1)] == np.array(langs)
