"""Toxicity, language and page models: gradients, held-out accuracy, hand-made pages."""

import numpy as np
import pytest

from captionforge.llm import crf, htmlcrf, langid, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    d = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    k = d.merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    h = k[k.held_out]
    s, y = h.score.rank().to_numpy(), h.toxic.to_numpy()
    auc = (s[y == 1].mean() - (y.sum() + 1) / 2) / (y == 0).sum()
    assert auc > 0.97 and (h.predicted == h.toxic).mean() > 0.96
    assert ((d.score >= 0.3) == (d.predicted == 1)).all() and d.score.between(0, 1).all()


def test_toxicity_uses_neither_held_out_labels_nor_lang(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.allclose(a.weights, b.weights) and (a.g7 == b.g7).all()


def _level(m, s, at, y):
    """The formula at one place, from the tables alone."""
    def kn(n, total, kinds, lower):
        return (max(n - 0.75, 0) + 0.75 * kinds * lower) / total

    p = kn(m.g2[0][s["g2"][at]], *m.c2[:, s["c2"][at]], 1 / toxicity.SYMBOLS)
    p = kn(m.g4[0][s["g4"][at]], *m.c4[:, s["c4"][at]], p)
    return kn(m.g7[y][s["g7"][at]], m.c7[y][s["c7"][at]], m.c7[2 + y][s["c7"][at]], p)


def test_kneser_ney_by_hand(spark):
    """Two words, counted by hand: the tables and one probability."""
    d = spark.createDataFrame([("ab ab", 0), ("ab", 1), ("ac", 1)], "text string, toxic int")
    m = toxicity.Model(toxicity.counts(d))
    g, starts, lengths = toxicity._grams(["ab", "ac"])
    s = {k: toxicity._slots(v, k) for k, v in g.items()}
    assert lengths.tolist() == [3, 3] and starts.tolist() == [0, 3]
    assert m.g7[:, s["g7"]].T.tolist() == [[1, 2], [1, 1], [1, 1], [1, 2], [0, 1], [0, 1]]
    assert m.c7[:, s["c7"][1]].tolist() == [1, 2, 1, 2]  # after ^a: once in class 0 (b), twice in class 1 (b, c)
    # continuations of order 4 after ^a: b and c, each in one 7-gram; of order 2 after a the same
    low = (1 - 0.75 + 0.75 * 2 * (1 / toxicity.SYMBOLS)) / 2
    mid = (1 - 0.75 + 0.75 * 2 * low) / 2
    p0 = (1 - 0.75) / 1 + 0.75 * 1 / 1 * mid
    p1 = (1 - 0.75) / 2 + 0.75 * 2 / 2 * mid
    first = np.log(p1) - np.log(p0)
    got = np.log(_level(m, s, 1, 1)) - np.log(_level(m, s, 1, 0))
    assert got == pytest.approx(first)
    assert m.ratios(["ac"])[0] > 0 > first


def test_counts_of_a_large_vocabulary_are_exact(spark):
    """As many n-grams as would fill tables of fixed size: none shares a count with another."""
    import itertools
    import random
    from collections import Counter

    r = random.Random(4)
    texts = [(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüßéèçñ", k=r.randint(4, 9))) for _ in range(400)), i % 2) for i in range(300)]
    m = toxicity.Model(toxicity.counts(spark.createDataFrame(texts, "text string, toxic int").repartition(5)))
    marked = lambda w: f"\x02{w}\x03"
    seen = (Counter(), Counter())
    for t, y in texts:
        for w in set(t.split()):
            seen[y].update(marked(w)[max(0, i - 6) : i + 1] for i in range(1, len(w) + 2))
    grams = seen[0].keys() | seen[1].keys()
    fours = Counter(g[-4:] for g in grams)
    words = texts[0][0].split()
    s, _, _ = toxicity._grams(words)
    ends = list(itertools.chain(*([marked(w)[: i + 1] for i in range(1, len(w) + 2)] for w in words)))
    assert m.g7[:, toxicity._slots(s["g7"], "g7")].T.tolist() == [[seen[0][e[-7:]], seen[1][e[-7:]]] for e in ends]
    assert m.g4[0][toxicity._slots(s["g4"], "g4")].tolist() == [fours[e[-4:]] for e in ends]
    unknown, _, _ = toxicity._grams(["жжжжжж"])
    assert not m.g7[:, toxicity._slots(unknown["g7"], "g7")].any()


def test_texts_are_scored_together(spark, monkeypatch):
    """A few looks at the tables for many texts, and the same numbers as for each text by itself, which are held against plain sums."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeéж", k=r.randint(1, 12)))
    texts = [" ".join(word() for _ in range(r.choice((0, 1, 2, 3, 60)))) for _ in range(300)] + [None, "", "12 _ 3", "\ud800 ab", "a" * 3000]
    m = toxicity.Model(toxicity.counts(spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts[:100])], "text string, toxic int")))
    made, grams = [], toxicity._grams
    monkeypatch.setattr(toxicity, "_grams", lambda words: made.append(len(words)) or grams(words))
    together = m.features(texts, {})
    assert len(made) <= 3 and together.shape == (len(texts), toxicity.N_FEATURES)
    monkeypatch.setattr(toxicity, "MOST_CACHED", 50)
    monkeypatch.setattr(toxicity, "GATHERED", 100)
    monkeypatch.setattr(toxicity, "PIECE", 16)
    cache = {}
    assert np.allclose(together, m.features(texts, cache), rtol=0, atol=1e-9)
    for t, x in zip(texts, together, strict=True):
        n = toxicity.Counter(toxicity.doc_words(t))
        w = np.array([m.ratios([v])[0] for v in n])
        if not n:
            assert not x.any()
            continue
        times, size, top = np.array(list(n.values())), np.array([len(v) + 1 for v in n]), sorted(w, reverse=True)
        wanted = [(w * times).sum() / (size * times).sum(), w.sum() / size.sum(), top[0], sum(top[:3]), np.log1p(np.maximum(w - 1.5, 0).sum()), np.maximum(w - 1.5, 0).sum() / len(w) ** 0.5, np.log(len(w)), (w > 2).sum() / len(w) ** 0.5, np.maximum(w - 3, 0).sum() / len(w) ** 0.5]
        assert np.allclose(x, wanted, rtol=0, atol=1e-9)


def test_language_held_out(spark):
    d = langid.op10_language_id(spark, SF).toPandas()
    k = d.merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    h = k[k.held_out]
    assert (h.lang_pred == h.lang).mean() > 0.97 and d.score.between(0, 1).all()


def test_a_stray_language_takes_nothing_from_the_others(spark, monkeypatch):
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    stray = next(i for i in range(10**9, 10**9 + 50) if __import__("zlib").crc32(str(i).encode()) % 4 != 2)
    more = docs.union(spark.createDataFrame([(stray, "qa zu xo qi vu", "zz")], "doc_id long, text string, lang string"))
    fit, seen = langid.Network.fit, []

    def kept(self, samples, *a, **b):
        seen.append(Counter(self.langs[y] for _, y in samples))
        return fit(self, samples, *a, **b)

    monkeypatch.setattr(langid.Network, "fit", kept)
    langid.train(docs)
    net = langid.train(more)
    assert seen[1] == seen[0] | Counter({"zz": 5})
    h = langid.predict(docs, net).join(docs.withColumnRenamed("doc_id", "d").drop("text"), langid.F.col("doc_id") == langid.F.col("d")).filter(langid.fold(langid.F.col("doc_id")) == 2).toPandas()
    assert (h.lang_pred == h.lang).mean() > 0.97


def test_language_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    net = langid.train(docs)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "der die das und nicht")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(d, net).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in net.langs
    assert [len(x) for x in net.label("ab cde")] == [4, 5]
    none = {r.lang_pred for r in langid.predict(d, None).collect()}
    assert none == {"und"}


def test_gradients_of_the_network():
    net = langid.Network(["a", "b", "c"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    batch, y = [b" ab ", b" xyz ", b" q "], np.array([0, 2, 1])

    def loss():
        o, mask, _ = net.positions(batch)
        return -(o[:, np.arange(3), y] * mask).sum() / mask.sum()

    g = net.gradients(batch, y)
    r = np.random.default_rng(0)
    for k, p in net.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in p.shape) if k != "emb" else (r.choice([97, 120, 32]), r.integers(0, p.shape[1]))
            old = p[at]
            p[at] = old + 1e-3
            up = loss()
            p[at] = old - 1e-3
            down = loss()
            p[at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[k][at], abs=2e-4)


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(3)
    m = crf.CRF(["x", "y", "z"])
    m.trans, m.start, m.end = r.normal(size=(3, 3)), r.normal(size=3), r.normal(size=3)
    ems = [r.normal(size=(n, 3)) for n in (1, 4, 2, 5, 1, 0)]
    for e, path in zip(ems, m.viterbi(ems), strict=True):
        def score(p, e=e):
            return m.start[p[0]] + sum(e[i][c] for i, c in enumerate(p)) + sum(m.trans[a, b] for a, b in zip(p, p[1:], strict=False)) + m.end[p[-1]]

        if len(e):
            assert tuple(path) == max(itertools.product(range(3), repeat=len(e)), key=score)
        else:
            assert len(path) == 0


def test_blocks():
    f = lambda h: [b.text for b in htmlcrf.blocks(h)]
    assert f(None) == f("") == f("<script>a<b</script>") == []
    assert f("a < b &amp; c &lt;") == ["a < b & c <"]
    assert f("<p>x<p>y<br>z<div>q<") == ["x", "y z", "q<"]
    assert f("<a href='x>y'>z</a>") == ["z"]
    assert f("<p>A&nbsp;&#65;  b\n <b>c</b>d</p><!-- no --><td>e") == ["A A b cd", "e"]
    assert f("<html><head><title>t</title><body>x") == ["x"]
    for bad in ("<p class='" * 50_000, "<" * 100_000, "<!--" * 50_000, "<script>" * 5_000):
        f(bad)


def test_pages_it_has_not_seen():
    right = total = 0
    for page in htmlcrf.labelled(150, seed=5):
        want = [b.text for b in htmlcrf.blocks(page) if b.label == "1"]
        right += htmlcrf.extract([page])[0] == "\n".join(want)
        total += 1
    assert right / total > 0.9


PAGE = """<html><body><header><h2>The Daily</h2><nav><a href=/>Home</a> <a href=/n>News</a></nav></header>
<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div>
<main><article><h1>A title</h1><p>First paragraph &amp; more.</p><div class="ad">Buy now!</div><p>Second one, with a <a href=x>link</a> in it.</p>
<ul><li>point one</li><li>point two</li></ul></article></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>Other story</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I disagree with this entirely.</p></div></section>
<form><label>Search</label><input></form><footer>&copy; The Daily</footer></body></html>"""


def test_a_page_by_hand():
    assert htmlcrf.extract([PAGE, None]) == ["A title\nFirst paragraph & more.\nSecond one, with a link in it.\npoint one\npoint two", ""]


def test_pages_of_the_table(spark):
    for r in htmlcrf.op5_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect():
        article = r.html[r.html.index("<article>") :].split("</article>")[0]
        assert r.text == "\n".join(b.text for b in htmlcrf.blocks(article)) and r.n_chars == len(r.text)
