"""Corpus operators on whole inputs, at sizes where a cut would show."""

import collections
import random

import pytest

import corpus_pipeline
from terravane.llm import mixing, templates

LETTERS = "abcdefghijklmnopqrst"
NAMES, CITIES = [f"name{x}" for x in LETTERS], [f"city{x}" for x in LETTERS]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("docs", [80, 100, 400, 1000, 1600, 4000])
def test_a_template_with_two_fields_recurs_at_every_size(spark, docs):
    r = random.Random(docs)
    other = [f"{''.join(r.choice('bcdfgh') for _ in range(7))} alone {''.join(r.choice('bcdfgh') for _ in range(7))} stays" for _ in range(docs)]
    texts = [f"{other[i]}\nUser login from {NAMES[i % 20]} at {CITIES[i // 20 % 20]}" for i in range(docs)]
    got = {x["doc_id"]: x["text"] for x in templates.drop_recurring_lines(documents(spark, texts)).collect()}
    assert got == dict(enumerate(other))


def test_one_document_does_not_make_a_field_literal(spark):
    # 2,000 lines of one document hold the field's value, more than the template has.
    loud = "\n".join(f"User login from {NAMES[0]} via {''.join(CITIES[i // k % 20] for k in (1, 20, 400))}" for i in range(2000))
    texts = [loud, *(f"User login from {NAMES[i % 20]} at {CITIES[i // 20]}" for i in range(400))]
    got = {x["doc_id"]: x for x in templates.drop_recurring_lines(documents(spark, texts)).collect()}
    assert all(got[i]["n_dropped"] == 1 for i in range(1, 401)) and got[0]["n_dropped"] == 0


def test_short_literal_lines_recur(spark):
    texts = [f"own {LETTERS[i]}{LETTERS[-i]} words here\nLes.\nAnd ornd.\n{i}\npage {i}" for i in range(6)]
    got = templates.drop_recurring_lines(documents(spark, texts)).collect()
    assert {x["doc_id"]: x["text"] for x in got} == {i: f"own {LETTERS[i]}{LETTERS[-i]} words here\n{i}\npage {i}" for i in range(6)}
    few = templates.drop_recurring_lines(documents(spark, ["Les."] * 4)).collect()
    assert all(x["n_dropped"] == 0 for x in few)


def test_mixing_realises_what_it_fits(spark, tmp_path):
    r = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    # One part in a hundred is low, which is a third of its target; a sixth is toxic.
    kind = lambda i: "###" if i < 12 else "!!!" if i < 200 else ""
    docs = documents(spark, [" ".join(r.choice(words) + kind(i) for _ in range(60)) for i in range(1200)])
    known = spark.createDataFrame([(i, int(i >= 12), int(12 <= i < 200)) for i in range(1200)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    rows = {x["doc_id"]: x for x in mixing.op8_soft_mixing(spark, str(tmp_path)).collect()}
    total = lambda times, d: sum(times(i) * x["n_tokens"] * x[f"p_{d}"] for i, x in rows.items())
    held = total(lambda i: 1, "clean")
    assert max(x["rate"] for x in rows.values()) > 2 and all(x["kept"] == (x["copies"] > 0) for x in rows.values())
    for d, goal in (("clean", held), ("low", held * 3 / 97)):
        assert abs(total(lambda i: rows[i]["rate"], d) / goal - 1) < 0.1 and abs(total(lambda i: rows[i]["copies"], d) / goal - 1) < 0.15
    # Without copies: what the bounded fit says, and all of the scarce domain.
    posts = mixing.mix_documents(docs, known).drop("rate")
    fitted = {x["doc_id"]: x["rate"] for x in posts.withColumn("rate", mixing.rate_of(mixing.fit_rates(posts, most=1.0), 1.0)).collect()}
    kept = collections.Counter(x["doc_id"] for x in mixing.kept_by_rate(docs, known).collect())
    assert max(fitted.values()) <= 1 and max(kept.values()) == 1 and set(range(12)) <= set(kept)
    for d in ("clean", "low"):
        assert abs(total(lambda i: kept[i], d) / total(lambda i: fitted[i], d) - 1) < 0.05


def test_language_stage_without_any_label(spark, tmp_path):
    docs = documents(spark, ["a text", None, "12 34 !", "", "\u00e9t\u00e9"]).selectExpr("*", "cast(null as string) as lang")
    assert sorted(x["doc_id"] for x in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()) == [0, 4]
