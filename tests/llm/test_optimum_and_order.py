"""Fitted optimum, file order, repeated ids, recall of the sketches, unset folders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import common, langid, mixing, neardup, records

SF = "/root/testdata/sf0.001"


def solved(t, p, most):
    """Accelerated projected gradient on every rate, run far beyond need."""
    held = p.T @ t
    goal = np.array([0.97, 0.03, 0.0]) * held[0] / 0.97
    r = y = np.ones(len(t))
    k = 1.0
    for _ in range(60_000):
        new = np.clip(y - (p @ ((p.T @ (t * y) - goal) / held) + mixing.RIDGE * (y - 1)) / (1 + mixing.RIDGE), 0, most)
        k = 1.0 if (new - r) @ (t * (y - new)) > 0 else k
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y, r, k = new + (k - 1) / k2 * (new - r), new, k2
    return r


def test_rates_are_at_their_optimum(spark):
    docs, labels = (common.table(spark, SF, x) for x in ("documents", "labels"))
    posts = common.stored(mixing.scored(docs.select("doc_id", "text"), mixing.train(docs, labels)).drop("text"), "posts")
    rows = posts.collect()
    t, p = np.array([r["n_tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    for most in (None, 1.0):
        fit = mixing.fit_rates(posts, most=most)
        mine = np.clip(1 - p @ np.array(fit.pull), 0, most or np.inf)
        assert np.abs(mine - solved(t, p, most or np.inf)).max() < 1e-3 and max(fit.residuals) <= mixing.TOLERANCE
        assert np.allclose(fit.totals, p.T @ (t * mine))
    with pytest.raises(RuntimeError, match="optimum"):
        mixing.fit_rates(posts, rounds=1)


def test_file_order_beyond_five_digits(spark):
    names = [f"part-{i:05d}-x.txt" for i in range(99_990, 100_101)] + ["part-00009-x.txt", "part-10001-x.txt"]
    random.Random(1).shuffle(names)
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "file string").orderBy(records.file_order(F.col("file"))).collect()]
    assert got == sorted(names, key=lambda n: int(n.split("-")[1]))


def test_records_without_id_and_of_other_tokenizers(spark, tmp_path):
    import public_tokenizers

    rows = [(None, "a b"), (5, "c d"), (5, "c d"), (5, None), (-7, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = records.encode_records(docs, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, -7, 5, 5, 5] and [r["start"] for r in out] == list(np.cumsum([0] + [r["n_tokens"] for r in out])[:-1])
    other = public_tokenizers.path("word_bpe_49k.json")
    enc = records.Encoder(other)
    texts = ["Hello there, World.", "", "x  y\nz"]
    assert not enc.splits and [a.tolist() for a in enc.encode(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_one_id_with_several_texts(spark):
    r = random.Random(3)
    a, b = ([f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(2))
    rows = [(5, a), (5, b), (6, [*a, "tail"]), (7, [*b, "tail"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert sorted(tuple(x) for x in neardup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False)]


def test_recall_of_correlated_coordinates():
    """Pairs at a similarity of 0.75 to 0.8 share a band, although one pair of permutations makes all coordinates."""
    r = np.random.RandomState(5)
    missed = 0
    for _ in range(400):
        n = r.randint(40, 300)
        u = np.unique(r.randint(1, 1 << 55, n).astype(np.uint64))
        n = len(u)
        both = int(np.ceil(r.uniform(0.75, 0.8) * n))
        x = u.copy()
        r.shuffle(x)
        only = n - both
        left, right = np.sort(np.concatenate([x[:both], x[both : both + only // 2]])), np.sort(np.concatenate([x[:both], x[both + only // 2 :]]))
        assert both / n >= 0.75
        sig = neardup.signatures(np.array([0, len(left), len(left) + len(right)]), np.concatenate([left, right]), neardup.ROWS * neardup.BANDS)
        missed += not (sig[:, 0] == sig[:, 1]).reshape(neardup.BANDS, neardup.ROWS).all(1).any()
    assert missed <= 4


def test_large_unresolved_buckets_lose_no_link(spark, monkeypatch):
    """Many classes with a common half and links in chains, so that stars do not find them all."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    common_part = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        own = [word() for _ in range(25)]
        for _ in range(4):
            texts.append(" ".join(common_part + own))
            own = [*own[6:], *(word() for _ in range(6))]
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_language_columns_and_ties(spark):
    docs = spark.createDataFrame([(i, "aa bb", k, "x") for i, k in enumerate(("b", "a", None))] + [(9, "aa bb", None, "x")] * 2, "doc_id long, text string, lang string, has_letter string")
    got = langid.identify(docs, langid.train(docs))
    assert got.columns == [*docs.columns, "lang_pred", "score", "fits"] and {(r["lang_pred"], r["score"], r["has_letter"]) for r in got.collect()} == {("a", 0.0, "x")}
    long = spark.createDataFrame([(0, "cd " * 40_000, "z")], "doc_id long, text string, lang string")
    assert langid.identify(long, langid.train(long)).first()["lang_pred"] == "z"


def test_a_cluster_needs_its_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
