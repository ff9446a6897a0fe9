"""Spans that weak supervision adds: precision and recall on planted ones."""

import random

from pyspark.sql import functions as F

from terravane.llm import pii


def luhn_number(r, first, n):
    d = [*map(int, first), *(r.randrange(10) for _ in range(n - len(first) - 1))]
    total = sum(x - 9 if x > 9 else x for x in (v * (1 + i % 2) for i, v in enumerate(reversed(d), 1)))
    return "".join(map(str, d)) + str(-total % 10)


def test_precision_and_recall_on_planted_spans(spark):
    r = random.Random(17)
    words = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, planted = [], set()
    kinds = {
        "spelled": lambda: ("email", f"{r.choice(words)}{r.randrange(99)}{r.choice([' (at) ', ' [at] ', '(at)'])}{r.choice(words)}{r.choice(['.', ' [dot] ', ' (dot) '])}com"),
        "guarded": lambda: ("ip", "[.]".join(str(r.randrange(1, 224)) for _ in range(4))),
        "twice": lambda: ("card", luhn_number(r, "4", 16)),
        "dots": lambda: ("card", ".".join(luhn_number(r, "52", 16)[i : i + 4] for i in (0, 4, 8, 12))),
        "local": lambda: ("phone", f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"),
    }
    for i in range(300):
        name = list(kinds)[i % 5]
        kind, value = kinds[name]()
        head = prose(r.randint(3, 12)) + " "
        tail = f" {luhn_number(r, '4', 16)}" if name == "twice" else ""
        rows.append((i, head + value + tail + " " + prose(6), 7))
        planted.add((i, kind, value))
        if tail:
            planted.add((i, kind, tail[1:]))
    # Ordinary addresses, and what only looks alike: versions, serials, sums, dates, fractions.
    fakes = [lambda: f"v{r.randrange(9)}.{r.randrange(9)}.{r.randrange(99)}", lambda: f"order {r.randrange(10**7, 10**8)}", lambda: f"serial {r.randrange(10**15, 10**16)}", lambda: f"2024-{r.randrange(10, 13)}-{r.randrange(10, 29)}", lambda: f"{r.randrange(1, 99)}.{r.randrange(100, 999)}.{r.randrange(100, 999)},00", lambda: f"{r.choice(words)}@{r.choice(words)}.org", lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"]
    for i in range(300, 900):
        rows.append((i, f"{prose(5)} {fakes[i % 7]()} {prose(8)}", 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int").withColumn("added", F.lit("x")).withColumn("candidates", F.lit(1))
    text = {i: t for i, t, _ in rows}
    got = {(x["doc_id"], pii.KINDS[a["kind"]], text[x["doc_id"]][a["start"] : a["end"]]) for x in pii.find_personal_data(docs.unionByName(docs.filter("doc_id < 10"))).collect() for a in x["added"]}
    right = len(got & planted)
    print("precision", right / len(got), "recall", right / len(planted))
    assert right / len(got) >= 0.95 and right / len(planted) >= 0.9
