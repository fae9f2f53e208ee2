import pytest
from conftest import rows

from captionforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    found = queries.QUERIES[name](spark, sf).toPandas()
    wanted = duck.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, t string, tree string, k int, size int"


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(4_000))
    data = [
        (1, None, None, None), (2, "", "en", "a"), (3, "one", None, "a"), (3, "one", None, "a"), (None, "two words", "de", None), (4, long, "en", "b"),
        (5, long, "en", "b"), (6, "x" * 50_000, "fr", "c"), (7, " \t\n ", "en", "c"), (8, "é漢字 😀 ß", "fr", "a"), (9, long + " end", "en", "b"),
    ]
    return spark.createDataFrame([(*r, None, "z", "z", "z", 1, 2) for r in data], DOCS)


LABELS, BENCH, PAGES = "doc_id long, quality int, toxic int", "item_id long, text string", "page_id long, url string, html string"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    odd_documents(spark).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (5, None, None), (8, 0, 0)], LABELS).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "word1 word2 word3"), (3, "two words"), (3, "two words"), (10, " ".join(f"word{i}" for i in range(40)))], BENCH).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>"), (2, "u", "<article><p>a"), (3, "u", "<" * 30_000)], PAGES).write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    for n, s in (("labels", LABELS), ("benchmark", BENCH), ("pages", PAGES)):
        spark.createDataFrame([], s).write.parquet(f"{d}/{n}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd_dir, name):
    n = spark.read.parquet(f"{odd_dir}/{'pages' if name.startswith('op5') else 'documents'}.parquet").count()
    got = queries.QUERIES[name](spark, odd_dir).collect()
    assert len(got) == n or name.startswith("op8") and got


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_odd_and_empty_tables_in_the_pipeline(spark, odd_dir, empty_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() > 0
    assert p.STAGES[-1][1](spark, docs, odd_dir).count() > 0
    assert p.run(spark, empty_dir).count() == 0


def test_sql_on_odd_rows(spark, odd_dir):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.sql(f"create view {t} as select * from '{odd_dir}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLES.items():
        assert rows(queries.QUERIES[name](spark, odd_dir).toPandas()) == rows(c.sql(sql).df()), name


def odd(spark, odd_dir, name):
    return queries.QUERIES[name](spark, odd_dir).toPandas()


def test_values_on_odd_rows(spark, odd_dir):
    """Nulls, empty, long, repeated and clashing rows: what each query gives for them."""
    import re

    from test_neardup import components, simhash, voted
    from test_scans import base_pii, base_secrets

    from captionforge.llm import pii, tokenpack

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = sorted((str(r.doc_id), r.text or "") for r in docs)
    key = lambda v: "None" if v != v or v is None else str(int(v))
    both = lambda got, *cols: sorted((key(r.doc_id), *(getattr(r, c) for c in cols)) for r in got.itertuples())
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    assert both(odd(spark, odd_dir, "op1_secrets"), "base_sha256") == sorted((i, sha(base_secrets(t))) for i, t in texts)
    assert both(odd(spark, odd_dir, "op2_pii"), "base_sha256") == sorted((i, sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base_pii(t)))) for i, t in texts)
    six = odd(spark, odd_dir, "op6_toxicity")
    assert six.held_out.notna().all() and six.score.between(0, 1).all() and not six[six.doc_id.isna()].held_out.any()
    seven = odd(spark, odd_dir, "op7_simhash_fingerprints")
    assert both(seven, "n_chars", "fingerprint") == sorted((i, len(t), voted(t)) for i, t in texts)
    nine = odd(spark, odd_dir, "op9_simhash_near_dedup")
    fps = [simhash(t, 4) for _, t in texts]
    ids = [float("inf") if i == "None" else int(i) for i, _ in texts]
    want = sorted((i, f, "None" if c == float("inf") else str(c)) for (i, _), f, c in zip(texts, fps, components(fps, ids, 4), strict=True))
    assert sorted((key(r.doc_id), r.fingerprint, key(r.component_id)) for r in nine.itertuples()) == want
    ten = odd(spark, odd_dir, "op10_language_id")
    assert ten.held_out.notna().all() and not ten[ten.doc_id.isna()].held_out.any()
    assert {r.doc_id for r in ten.itertuples() if r.lang_pred == "und"} == {1, 2, 7} and (ten[ten.lang_pred == "und"].score == 0).all()
    assert ten.groupby("doc_id").lang_pred.nunique().max() == 1
    eight = odd(spark, odd_dir, "op8_token_ids")
    assert eight.n_tokens.sum() == sum(len(tokenpack.encode(t)) // 2 + 1 for _, t in texts)
    assert sorted({key(d) for ids in eight.doc_ids for d in ids}) == sorted({i for i, _ in texts})
    five = odd(spark, odd_dir, "op5_html_text")
    assert list(five.n_chars) == [len(t) for t in five.text] and (five[five.page_id.isna() | (five.page_id == 1)].text == "").all()
    assert sorted(five.text.str.len())[:2] == [0, 0] and re.fullmatch("<*", five[five.page_id == 3].text.iloc[0])
