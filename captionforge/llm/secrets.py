"""Operator 1: secret scans by character Markov models.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained by
counting character pairs in labelled samples. A run of key characters is a secret if the log-likelihood ratio of the
two models, in all and per character, is high enough. Three fixed patterns (assignments, access keys, hexadecimal
runs) are found besides; the models add spans that don't overlap theirs.

DataFrame functions only: the samples, the counts and the scores are columns, and no row leaves its place (no shuffle).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

# The three base patterns and their least lengths.
ASSIGN = r"""(?:(?i)(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: A candidate for the models: a run of key characters that no letter or digit beyond ASCII touches. Either side of
#: name=value is one; "=" belongs to a run only as padding at its end.
CANDIDATE = r"(?<![\p{L}\p{N}_+/-])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![\p{L}\p{N}_+/=-]))?(?![\p{L}\p{N}_+/-])"
LEAST_RATIO, LEAST_PER_CHAR = 12.0, 0.45
KINDS = ("assign", "access", "hex", "markov")

#: Labelled samples: words of which ordinary identifiers are made (label 0; besides these, numbers, dates and rulers of
#: one character). Random strings (label 1) are digests.
ORDINARY = """
get set user name value index list item count total number string object array table column row key map cache buffer
file path reader writer stream input output config option default parser token field record model view controller
service client server request response handler manager factory builder provider context session account order customer
product price quantity address message event listener callback thread process queue worker task schedule timer date time
create update delete insert select remove find search filter sort group merge split join format convert validate check
test assert error exception warning result status state active enabled visible selected current previous next first last
internal external public private static final abstract interface implementation application development environment
the and for with that this from have not but what all were when your can said there use each which she how their will
information international organization responsibility communication understanding representative administration
geschwindigkeit wahrscheinlichkeit verantwortung entwicklung gesellschaft zusammenarbeit unterschied wissenschaft
und der die das nicht eine einer werden haben auch sich nach ueber zwischen bericht arbeit sprache
gouvernement developpement environnement responsabilite communaute entreprise connaissance traitement evenement
les des une pour dans avec sur pas plus tout etre fait comme mais leur sans sous entre cette
informacion organizacion desarrollo conocimiento responsabilidad administracion comunicacion naturaleza
los las una para con por del como pero sus este entre cuando muy sobre tambien hasta donde quien desde
""".split()  # noqa: SIM905
SAMPLES = 4000


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """The labelled samples: sample, label (1 random, 0 ordinary); n of each."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    binary = F.unhex(digest)
    size = (F.lit(20) + F.pmod(F.col("id") * 7, F.lit(44))).cast("int")
    form = F.pmod("id", F.lit(6))
    b64 = F.base64(binary)
    random = (
        F.when(form == 0, F.substring(digest, F.lit(1), size)).when(form == 1, F.upper(F.substring(digest, F.lit(1), size)))
        .when(form == 2, F.substring(F.translate(b64, "+/=", "xQ7"), F.lit(1), size)).when(form == 3, F.substring(F.translate(b64, "+/", "-_"), F.lit(1), size))
        .otherwise(F.substring(b64, F.lit(1), size))
    )
    dictionary = F.array(*[F.lit(w) for w in ORDINARY])
    at = lambda k: F.get(dictionary, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(ORDINARY))).cast("int"))
    parts = [at(k) for k in range(4)]
    camel = F.concat(parts[0], *[F.initcap(p) for p in parts[1:]])
    style = F.pmod("id", F.lit(12))
    number = F.translate(digest, "abcdef", "012345")
    day = F.concat_ws("-", *[F.substring(number, i, 2 if i > 1 else 4) for i in (1, 5, 7, 9, 11, 13)])
    alphabet = "-_/+ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    symbol = F.pmod(F.floor(F.col("id") / 12), F.lit(len(alphabet))).cast("int") + 1
    ruler = F.repeat(F.substring(F.lit(alphabet), symbol, F.lit(1)), F.lit(24))
    ordinary = (
        F.when(style == 0, camel).when(style == 1, F.concat_ws("_", *parts)).when(style == 2, F.upper(F.concat_ws("_", *parts)))
        .when(style == 3, F.concat_ws("-", *parts)).when(style == 4, F.concat_ws("/", *parts)).when(style == 5, F.upper(F.concat(*parts)))
        .when(style.isin(6, 7), F.substring(number, F.lit(1), size)).when(style == 8, day).when(style == 9, ruler)
        .otherwise(F.concat(*parts))
    )
    return ids.select(random.alias("sample"), F.lit(1).alias("label")).union(ids.select(ordinary.alias("sample"), F.lit(0).alias("label")))


def train(labelled: DataFrame, alpha: float = 0.5, symbols: int = 66) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at ascii(a) * 128 + ascii(b), from samples with labels 0 and 1.

    The counts are grouped by label and character pair before they leave the executors: 2 * 128 * 128 rows at most."""
    chars = labelled.filter(F.col("sample").isNotNull()).select("label", F.split("sample", "").alias("c"))
    pairs = chars.select("label", F.inline(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.size("c")).alias("b"))))
    pairs = pairs.select("label", F.ascii("a").alias("a"), F.ascii("b").alias("b")).filter("a between 1 and 127 and b between 1 and 127")
    n = [[[0] * 128 for _ in range(128)] for _ in range(2)]
    for r in pairs.groupBy("label", "a", "b").count().collect():
        n[int(r[0])][r[1]][r[2]] = r[3]
    p = [[[math.log((x + alpha) / (sum(row) + alpha * symbols)) for x in row] for row in of] for of in n]
    return [p[1][a][b] - p[0][a][b] for a in range(128) for b in range(128)]


def ratio(run: Column, model: Column) -> Column:
    """Log-likelihood ratio of an ASCII string."""
    chars = F.transform(F.split(run, ""), F.ascii)
    step = lambda s, c: F.struct(
        F.when(s.a < 0, s.sum).otherwise(s.sum + F.get(model, s.a * 128 + c)).alias("sum"), c.alias("a")
    )
    return F.aggregate(chars, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("a")), step, lambda s: s.sum)


def _matches(text: Column, pattern: str, kind: int, group: int) -> Column:
    """array<struct<start, kind, end, run, n>> of a pattern's matches: leftmost, non-overlapping, in code points.

    The pieces between the matches give the starts. n is the length of the group that must be long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    asked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("run"), asked.alias("group"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,run:string,n:int>>")
    step = lambda s, x: F.struct(
        F.concat(s.spans, F.array(F.struct(
            (s.at + F.length(x.gap)).alias("start"), F.lit(kind).alias("kind"), (s.at + F.length(x.gap) + F.length(x.run)).alias("end"),
            x.run.alias("run"), F.length(x.group).alias("n"),
        ))).alias("spans"),
        (s.at + F.length(x.gap) + F.length(x.run)).alias("at"),
    )
    spans = F.aggregate(zipped, F.struct(none.alias("spans"), F.lit(0).alias("at")), step, lambda s: s.spans)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def scan(docs: DataFrame, labelled: DataFrame | None = None, least_ratio: float = LEAST_RATIO, least_per_char: float = LEAST_PER_CHAR) -> DataFrame:
    """docs' columns with secrets: array of struct(kind, start, end, value, score), by start, then kind as in KINDS.

    docs: any columns with `text`. score is the log-likelihood ratio, null for base spans. Null texts are read as empty;
    an empty text has no secrets. Code points, end exclusive. Rows are independent: repeated rows give repeated results."""
    spark = docs.sparkSession
    model = F.array(*[F.lit(x) for x in train(labelled if labelled is not None else samples(spark))])
    t = F.col("__t")
    d = docs.select(*[F.col(c).alias(f"c__{c}") for c in docs.columns], F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    long_enough = lambda c, kind: F.filter(c, lambda x: x.n >= LEAST[kind])
    # runs of fewer characters than asked for can't hold a longer match, so these two may ask in the pattern
    access = _matches(t, r"AKIA[A-Z0-9]{12,}", 1, 0)
    hexes = _matches(t, r"[0-9a-f]{32,}", 2, 0)
    base = F.concat(long_enough(_matches(t, ASSIGN, 0, 2), "assign"), access, hexes)
    runs = _matches(t, CANDIDATE, 3, 0)
    d = d.withColumn("__base", base).withColumn("__runs", runs)
    scored = F.transform("__runs", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"), x.run.alias("run"), ratio(x.run, model).alias("score")))
    free = lambda x: ~F.exists("__base", lambda b: (b.start < x.end) & (x.start < b.end))
    added = F.filter(scored, lambda x: (x.score >= least_ratio) & (x.score >= (x.end - x.start) * least_per_char) & free(x))
    known = F.transform("__base", lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"), x.run.alias("run"), F.lit(None).cast("double").alias("score")))
    every = F.array_sort(F.concat(known, added))
    names = F.array(*[F.lit(k) for k in KINDS])
    out = F.transform(every, lambda x: F.struct(F.get(names, x.kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), x.run.alias("value"), x.score.alias("score")))
    return d.select(*[F.col(f"c__{c}").alias(c) for c in docs.columns], out.alias("secrets"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    d = scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda kind: F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("secrets", lambda x: x.kind != "markov")
    return d.select("doc_id", *[n(k) for k in KINDS[:3]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), n("markov"))
