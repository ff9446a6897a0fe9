"""Line templates against a plain count in Python, with hot lines, long texts, ties and repeated rows."""

import random
from collections import Counter, defaultdict

import pytest

from terravane.llm import templates

from test_llm import documents


def kept(texts, min_docs=5, min_tokens=3, max_variable=0.34):
    """Texts without their recurring lines, each row of ``texts`` being a document."""
    parsed = [templates.masked_lines(t or "") for t in texts]
    reached = Counter(leaf for lines in parsed for leaf in {x[1] for x in lines})
    parsed = [[(i, leaf, line.decode().split(" ")) for i, leaf, line in lines if reached[leaf] >= min_docs] for lines in parsed]
    had = Counter()
    for lines in parsed:
        had.update({(leaf, p, t) for _, leaf, tokens in lines for p, t in enumerate(tokens) if t != "<*>"})

    def of(leaf, tokens):
        ranks = [n if (n := had[leaf, p, t]) >= min_docs and t != "<*>" else 0 for p, t in enumerate(tokens)]
        allowed = int(len(ranks) * max_variable)
        for cut in {0, *ranks}:
            if sum(r <= cut for r in ranks) <= allowed and (len(ranks) >= min_tokens or cut < min(ranks)):
                yield leaf, tuple(t if r > cut else "<*>" for t, r in zip(tokens, ranks))

    docs = defaultdict(set)
    for d, lines in enumerate(parsed):
        for _, leaf, tokens in lines:
            for t in of(leaf, tokens):
                docs[t].add(d)
    out = []
    for text, lines in zip(texts, parsed):
        gone = {i for i, leaf, tokens in lines if any(len(docs[t]) >= min_docs for t in of(leaf, tokens))}
        out.append(text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda k: f"w{'abcdefghijklmnop'[r.randrange(k)]}"
    kinds = [
        lambda: "the common line of all",
        lambda: f"posted by {word(16)}{word(16)} on day {r.randrange(1000)}",
        lambda: f"all rights reserved {word(3)}",
        lambda: " ".join(word(4) for _ in range(r.randrange(1, 7))),
        lambda: "",
        lambda: f"read  more\t{r.randrange(9)}",
    ]
    texts = ["\n".join(r.choice(kinds)() for _ in range(r.randrange(6))) for _ in range(n)]
    return [*texts, None, "", *texts[:3], "\n".join(["the common line of all"] * 3 + [" ".join(f"x{'abc'[i % 3]}{i % 17}" for i in range(30_000))])]


@pytest.mark.parametrize("hot_rows", [3, 1_000])
def test_the_plain_count(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(templates, "HOT_ROWS", hot_rows)
    for seed, n in ((1, 60), (2, 150)):
        texts = corpus(seed, n)
        got = {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(documents(spark, texts)).collect()}
        want = kept(texts)
        assert any(a != b for a, b in zip(texts, want)) and any(a == b and a for a, b in zip(texts, want))
        assert got == dict(enumerate(want))


def test_repeated_rows_count_and_keep_one_text(spark):
    docs = documents(spark, ["a line of text here\nand one more", "b"])
    rows = docs.filter("doc_id = 0")
    for _ in range(2):
        rows = rows.unionAll(rows)
    got = templates.drop_recurring_lines(rows.unionAll(docs)).collect()
    assert len(got) == 6 and Counter(r["text"] for r in got) == {"": 5, "b": 1}


def test_recurring_lines_name_their_templates(spark):
    docs = documents(spark, ["the same line here"] * 6).selectExpr("doc_id row_key", "text")
    got = templates.recurring_lines(docs).collect()
    assert {(r["row_key"], r["line_no"], r["template"], r["docs"]) for r in got} == {(i, 0, "the same line here", 6) for i in range(6)}
