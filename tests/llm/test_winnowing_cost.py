"""op10: what a word costs, and what the joins move."""

import random

from pyspark.sql import functions as F

from terravane.llm import common, decontam

SF = "/root/testdata/sf0.001"


def test_positions_are_the_smallest_of_each_window(spark):
    r = random.Random(5)
    rows = [(k, [r.randrange(3) for _ in range(n)]) for k, n in enumerate((0, 1, 4, 5, 9, 10, 11, 40, 300))]
    df = spark.createDataFrame(rows, "k int, codes array<bigint>")
    out = df.select("codes", decontam.gram_hashes(F.col("codes"), decontam.GRAM).alias("grams"), decontam.winnowed(F.col("codes")).alias("at"), decontam.fingerprints(F.col("codes").cast("array<string>"), []).alias("prints")).collect()
    n = decontam.WINDOW - decontam.GRAM + 1
    for x in out:
        g = [h >> 31 for h in x["grams"]]
        assert len(g) == max(0, len(x["codes"]) - decontam.GRAM + 1)
        assert x["at"] == list(dict.fromkeys(min(range(i, i + n), key=lambda j: (g[j], j)) for i in range(len(g) - n + 1)))
        words = [str(c) for c in x["codes"]]
        for p in x["prints"]:
            at, end = p["pos"], p["pos"] + decontam.GRAM
            assert (p["before"] is None) == (at < decontam.SIDE) and (p["after"] is None) == (end + decontam.SIDE > len(words))
            for q in x["prints"]:
                same = words[at:end] == words[q["pos"] : q["pos"] + decontam.GRAM]
                assert (p["hash"] == q["hash"]) == same


def test_no_array_is_copied_for_each_word(spark):
    """slice() goes through a Scala view, element by element; within a lambda it did so for every word, twice for grams and once for windows."""
    made = common.table(spark, SF, "documents").select(decontam.fingerprints(F.split("text", " "), [3]).alias("f"))
    # The one left cuts the array of window minima, once for a text.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("slice(") <= 1


def test_texts_are_not_shuffled_to_count_their_words(spark):
    df = decontam.op10_winnowing(spark, SF)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [min((k for k in (x.find("+- "), x.find(":- ")) if k >= 0), default=0) for x in lines]

    def below(i):
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        return lines[i + 1 : end]

    tops = [i for i, x in enumerate(lines) if "_row#" in x and "Join [" in x]
    assert tops and all(any("AS n_words" in x for x in below(i)) for i in tops)
    # Splitting comes after the semi-join.
    semi = [i for i, x in enumerate(lines) if "LeftSemi" in x]
    assert semi and not any("split(" in x for i in semi for x in below(i))
