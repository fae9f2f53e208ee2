"""Operator 4: benchmark decontamination with a positional inverted index.

The index is written to the shared folder: for each document the postings (term, position) of the terms that the test
items have, in order of position. It is partitioned by document, so building it moves nothing. A test window (a phrase)
is looked up from its rarest term: that term's list, moved by its offset, holds the only places at which the window can
begin; the lists of the other terms, rarest first, are moved by theirs and intersected with what is left. For proximity
matches the lists need only meet within a span of some more words than the window has.

DataFrame functions only. Windows are handled in blocks of bounded size, each with an index of its own terms; a block
reads the texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, dropped, read, words, written

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SLACK = 10, 5
#: Test tokens in a block's windows; its terms are literals of the plan.
BLOCK_TOKENS = 100_000
#: Documents with hits up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs of digits, a-z and characters beyond ASCII. Null gives an empty array."""
    return words(ascii_lower(text), GAP)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, at (0, 1, ...) and terms: every run of `size` words of an item; an item of fewer, but not none, is one.

    items: item_id, text. Items without words have no window."""
    t = items.select("item_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - size, F.lit(0)))
    return t.select("item_id", "t", F.explode(starts).alias("at")).select("item_id", "at", F.slice("t", F.col("at") + 1, size).alias("terms"))


def blocks(wins: DataFrame) -> list[DataFrame]:
    """The windows in blocks of about BLOCK_TOKENS tokens. A window is small, so no item is too long for a block."""
    total = wins.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    n = -(-total // BLOCK_TOKENS)
    return [wins] * n if n <= 1 else [wins.filter(F.pmod(F.xxhash64("terms"), F.lit(n)) == i) for i in range(n)]


def build(toks: DataFrame, terms: list[str]) -> DataFrame:
    """The stored index: toks' columns but t, n_words, and lists: array<struct<term, pos>>, the postings of `terms`.

    toks: column t (tokens) and identifying columns."""
    places = F.filter(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos"))), lambda p: p.term.isin(terms))
    rest = [c for c in toks.columns if c != "t"]
    return written(toks.select(*rest, F.size("t").cast("long").alias("n_words"), places.alias("lists")), compression="zstd")


def frequencies(index: DataFrame) -> DataFrame:
    """term and df, the length of its lists in all."""
    return index.select(F.explode("lists.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def ordered(wins: DataFrame, df: DataFrame) -> DataFrame:
    """Windows with order: their terms as struct(df, off, term), the rarest first (ties: the first in the window).

    A window with a term that no document has is left out: it can't occur."""
    each = wins.select("*", F.posexplode("terms").alias("off", "term")).join(df, "term")
    found = each.groupBy("item_id", "at", "terms").agg(F.array_sort(F.collect_list(F.struct("df", "off", "term"))).alias("order"))
    return found.filter(F.size("order") == F.size("terms"))


def postings(index: DataFrame, keep: list[str], terms: list[str], reach: int) -> DataFrame:
    """keep, term, pos and around (all postings within reach) for each posting of `terms`."""
    def place(p: Column) -> Column:
        around = F.filter("lists", lambda q: (q.pos >= p.pos - reach) & (q.pos <= p.pos + reach))
        return F.struct(p.term.alias("term"), p.pos.alias("pos"), around.alias("around"))

    return index.select(*keep, F.inline(F.transform(F.filter("lists", lambda p: p.term.isin(terms)), place)))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The matches, docs' columns but t with n_words for every row, and the stored indexes that these are read from.

    A match: docs' columns but t, item_id, at, n (words of the window), start (where it occurs word for word; null if it
    doesn't there) and near (do its terms all stand within n + slack words around the rarest one?). Each occurrence of the
    rarest term is looked at once. docs: column t (tokens) and identifying columns; items: item_id, text."""
    keep = [c for c in docs.columns if c != "t"]
    kind = dict(items.dtypes)["item_id"]
    out = every = None
    stored = []
    wins = windows(items, size).distinct()  # an item may be listed twice
    for part in blocks(wins):
        vocabulary = [r[0] for r in part.select(F.explode("terms").alias("term")).distinct().collect()]  # within BLOCK_TOKENS
        index = build(docs, vocabulary)
        stored.append(index)
        every = index.select(*keep, "n_words") if every is None else every
        asked = ordered(part, frequencies(index)).collect()  # as many windows as a block has at most
        if not asked:
            continue
        table = docs.sparkSession.createDataFrame([tuple(r) for r in asked], f"item_id {kind}, at int, terms array<string>, order array<struct<df:long,off:int,term:string>>")
        table = table.withColumn("seed", F.get("order", F.lit(0))["term"]).withColumn("off", F.get("order", F.lit(0))["off"])
        seeds = sorted({r["order"][0]["term"] for r in asked})

        lists = postings(index, keep, seeds, size + slack - 1)
        found = lists.join(F.broadcast(table), F.col("term") == F.col("seed"))
        moved = lambda x: F.transform(F.filter("around", lambda q: q.term == x.term), lambda q: q.pos - x.off)
        first = F.array(F.col("pos") - F.col("off"))
        starts = F.aggregate("order", first, lambda s, x: F.when(F.size(s) == 0, s).otherwise(F.array_intersect(s, moved(x))))
        span = F.size("terms") + slack
        inside = lambda a: F.transform(F.filter("around", lambda q: (q.pos >= a) & (q.pos < a + span)), lambda q: q.term)
        near = F.exists("around", lambda q: (q.pos <= F.col("pos")) & (q.pos + span > F.col("pos")) & (F.size(F.array_except("terms", inside(q.pos))) == 0))
        found = found.select(*keep, "item_id", "at", F.size("terms").alias("n"), F.get(starts, F.lit(0)).alias("start"), near.alias("near")).filter("start is not null or near")
        out = found if out is None else out.union(found)
    if every is None:
        every = docs.select(*keep, F.size("t").cast("long").alias("n_words"))
    if out is None:
        out = every.select(*keep, F.lit(None).cast(kind).alias("item_id"), *[F.lit(0).alias(c) for c in ("at", "n", "start")], F.lit(False).alias("near")).limit(0)
    return out, every, stored


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exact phrase matches: docs' columns but t, with item_id, at, start and n for every occurrence of a window."""
    found, _, _ = matches(docs, items, size, 0)
    return found.filter("start is not null").drop("near")


def contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs' columns but t of the rows in which a window occurs, each once, as a checkpoint; the indexes are deleted."""
    found, _, stored = matches(docs, items, size, 0)
    hits = checkpointed(found.filter("start is not null").select(*[c for c in docs.columns if c != "t"]).distinct())
    for index in stored:
        dropped(index)
    return hits


def proximity(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Proximity matches: docs' columns but t, item_id and at of the windows all of whose terms stand within n + slack
    words, once for each occurrence of the rarest one around which they do."""
    found, _, _ = matches(docs, items, size, slack)
    return found.filter("near").drop("near", "start", "n")


def covered(spans: Column) -> Column:
    """Positions inside the union of spans, an array of struct(start, n)."""
    step = lambda s, x: F.struct(
        (s.hit + F.greatest(F.lit(0), x.start + x.n - F.greatest(s.end, x.start))).alias("hit"),
        F.greatest(s.end, x.start + x.n).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")), step, lambda s: s.hit.cast("long"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, item_ids and near_ids (of exact and of proximity
    matches, sorted as strings).

    Null and empty texts have no words and no hits. Rows of the same doc_id and text are counted alike, each by
    itself; items that share an id count as one, those without an id only by their hits; other columns are ignored;
    either table may be empty."""
    keyed = docs.select("doc_id", F.xxhash64(F.col("text")).alias("k"), tokens(F.col("text")).alias("t"))
    found, every, stored = matches(keyed, items, size, slack)
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("item_id").cast("string"))))
    hits = found.groupBy("doc_id", "k").agg(
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct(F.col("start"), F.col("n")))).alias("spans"),
        ids(F.col("start").isNotNull()).alias("items"), ids(F.col("near")).alias("near"),
    )
    hits = checkpointed(hits.select(F.col("doc_id").alias("h_id"), F.col("k").alias("h_k"), covered(F.col("spans")).alias("hit"), "items", "near"))
    for index in stored[1:]:  # the first has the numbers of words
        dropped(index)
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    both = every.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("k") == F.col("h_k")), "left")
    none = F.array().cast("array<string>")
    return both.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("item_ids"), F.coalesce("near", none).alias("near_ids"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item of benchmark; n_near counts the items with proximity matches."""
    d = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"),
    )


ORACLE_OP4 = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
bw AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
win AS (SELECT item_id, list_slice(t, i, i + 9) AS terms FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 9, 1) + 1)) AS i FROM bw WHERE len(t) > 0)),
seed AS (SELECT DISTINCT item_id, terms, len(terms) AS n, array_to_string(terms, ' ') AS phrase FROM win),
lens AS (SELECT DISTINCT n FROM seed),
dwin AS (SELECT r, i, n, array_to_string(list_slice(t, i, i + n - 1), ' ') AS phrase
  FROM (SELECT r, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM dw, lens WHERE len(t) >= n)),
hit AS (SELECT DISTINCT r, i, dwin.n, item_id FROM dwin JOIN seed ON dwin.n = seed.n AND dwin.phrase = seed.phrase),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r),
voc AS (SELECT DISTINCT unnest(terms) AS w FROM seed),
post AS (SELECT r, p, w FROM (SELECT r, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM dw) JOIN voc USING (w)),
wt AS (SELECT DISTINCT item_id, phrase, n, unnest(terms) AS w FROM seed),
need AS (SELECT *, count(*) OVER (PARTITION BY item_id, phrase) AS m FROM wt),
cand AS (SELECT r, item_id, phrase, n, m FROM need JOIN (SELECT DISTINCT r, w FROM post) USING (w) GROUP BY r, item_id, phrase, n, m HAVING count(*) = m),
spots AS (SELECT c.r, c.item_id, c.phrase, c.n, c.m, post.p FROM cand c JOIN wt ON wt.phrase = c.phrase AND wt.item_id IS NOT DISTINCT FROM c.item_id JOIN post ON post.r = c.r AND post.w = wt.w),
near AS (SELECT a.r, a.item_id FROM spots a JOIN wt ON wt.phrase = a.phrase AND wt.item_id IS NOT DISTINCT FROM a.item_id
  JOIN post ON post.r = a.r AND post.w = wt.w AND post.p >= a.p AND post.p < a.p + a.n + 5
  GROUP BY a.r, a.item_id, a.phrase, a.p, a.m HAVING count(DISTINCT post.w) = a.m),
nits AS (SELECT r, count(DISTINCT item_id) AS n_near FROM near GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN nits USING (r)
"""
