"""The training-data operators against brute force on small fixtures, with nulls, ties, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.llm import common, decontam, langid, mixing, neardup, pii, queries, records, sharding, substring, templates, topk
from terravane.llm.fmindex import FMIndex, WaveletMatrix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, row_key string, rank int"


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or ""), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def tables(tmp_path, **frames):
    for name, df in frames.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sample_texts(seed=1, n=60):
    """Prose of few words with copies, near copies, shared passages, nulls, blanks and a long text."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    out = [None, "", "  \t\n", "one two", "One two", "a b " * 400]
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 160))]
        if i % 4 == 0:
            at = r.randrange(len(words))
            words[at:at] = passage.split()
        out.append(" ".join(words))
        if i % 5 == 0:
            out.append(out[-1])
        if i % 6 == 0:
            copy = list(words)
            for _ in range(max(1, len(copy) // 60)):
                copy[r.randrange(len(copy))] = "Changed"
            out.append(" ".join(copy))
    out.append(" ".join(r.choice(vocabulary) for _ in range(20_000)))
    return out


def repeats(rows, window=50):
    least, split = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        split.append((i, w))
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in split:
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("hot, group", [(2000, 1000), (2, 1000), (2000, 2)])
def test_substring_removal(spark, hot, group):
    texts = sample_texts() + ["x y " * 60, "x y " * 40, "y x " * 45]
    got = substring.remove_repeats(documents(spark, texts), hot, group).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == repeats(list(enumerate(texts)))
    assert substring.remove_repeats(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, texts[-3]), (1, texts[-3]), (1, texts[-3])], "doc_id long, text string")
    assert [r["n_removed"] for r in substring.remove_repeats(odd).collect()] == [0, 0, 0]


def test_fm_index_matches_brute_force():
    r = np.random.RandomState(3)
    for trial in range(60):
        seqs = [r.randint(1, r.choice([3, 5, 20]), r.randint(1, 40)) for _ in range(r.randint(1, 12))]
        text = np.concatenate([np.append(s, 0) for s in seqs])
        queries = [r.randint(1, 5, r.randint(1, 60)) for _ in range(5)] + [np.concatenate([seqs[0], seqs[-1]])]
        query, size = np.concatenate(queries), np.array([len(q) for q in queries])
        got = FMIndex(text).matching(np.where(np.isin(query, text), query, -1), np.cumsum(size) - size, size)
        want = []
        for q in queries:
            for i in range(len(q)):
                m = 0
                while i + m < len(q) and any((s[k : k + m + 1] == q[i : i + m + 1]).all() for s in seqs for k in range(len(s) - m)):
                    m += 1
                want.append(m)
        assert got.tolist() == want
    w = WaveletMatrix(np.array([3, 1, 3, 0, 2, 3]), 2)
    assert (w.rank(np.array([3]), np.array([6])) - w.rank(np.array([3]), np.array([0])))[0] == 3


def test_only_other_documents_are_matched(monkeypatch):
    """Sequences are streamed through indexes of smaller documents only; steps fail and matches are shortened."""
    seen, short = [], []
    monkeypatch.setattr(substring.FMIndex, "matching", lambda self, text, first, size, real=FMIndex.matching: (seen.append((self.n, real(self, text, first, size), size)), seen[-1][1])[1])
    monkeypatch.setattr(substring.FMIndex, "shorten", lambda self, lo, hi, real=FMIndex.shorten: (short.append(len(lo)), real(self, lo, hi))[1])
    r = random.Random(2)
    passage = [r.choice("abcdefgh") for _ in range(70)]
    seqs, docs = [], []
    for doc in range(7):
        w = list(passage)
        w[r.choice((2, 35, 68))] = r.choice("abcdefgh")
        seqs.append(" ".join(w))
        docs.append(doc // 2 * 2)
    got = substring.match_sequences([1] * 7 + [2], [*seqs, seqs[0]], [*docs, 9])
    for k, s in enumerate(seqs):
        w = s.split()
        want = [any(" ".join(w[i : i + 50]) in " ".join(t.split()[j : j + 50]) for t, d in zip(seqs, docs) if d < docs[k] for j in range(21)) for i in range(21)]
        assert got[k].tolist() == want
    assert not got[7].any() and short and sum(n for n, *_ in seen) < 2 * 71 * 8
    # Statistics are not the lengths left, so they come from the search.
    assert any((length != np.concatenate([np.arange(n, 0, -1) for n in size])).any() for _, length, size in seen)


def classes(rows):
    sets = {}
    for i, t in rows:
        w = ascii_lower(t).encode().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("small, block", [(64, 192), (2, 3)])
def test_near_duplicates(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = sample_texts(2, 40)
    got = neardup.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(list(enumerate(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in neardup.near_duplicates(odd).collect())
    assert got == [(-1, -1), (2, 2), (4, 4), (4, 4)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 50), (60, 50), (7, 7)]
    got = {r["id"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 31)} | {50: 40, 60: 40}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_of(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice("aB1.2@-+ ()_%é5x0\n") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a" * 50_000, "1 " * 20_000, "+1" * 20_000, "é😀 a.b@c.de_x@y.org 4111 1111 1111 1111 256.1.1.1 1.2.3.4.5.6.7.8 +1 (212) 555-1234"]
    texts += [f"call me at ({200 + i}) 555-{1000 + i} or +1 ({300 + i}) 555-{2000 + i}; mail bob{i} [at] example [dot] com, or bob{i}@example.com" for i in range(60)]
    sf = tables(tmp_path, documents=documents(spark, texts))
    got = {x["doc_id"]: x for x in pii.op3_personal_data(spark, sf).collect()}
    for i, t in enumerate(texts):
        base = base_of(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t[:80]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(b.startswith(k) for b in base) for k in PATTERNS]
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
    loose = [f"call me at ({200 + i}) 555-{1000 + i} or mail bob{i} [at] example [dot] com, or +1 ({300 + i}) 555-{2000 + i}, bob{i}@example.com" for i in range(40)]
    found = pii.find_personal_data(documents(spark, loose + ["plain words only", "order 12345678 and version 1.2.3"] * 10)).collect()
    for x in found:
        text = (loose + [""] * 20)[x["doc_id"]]
        want = {f"({200 + x['doc_id']}) 555-{1000 + x['doc_id']}", f"bob{x['doc_id']} [at] example [dot] com"} if text else set()
        assert {text[a["start"] : a["end"]] for a in x["added"]} == want
    plan = pii.find_personal_data(documents(spark, ["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.find_personal_data(documents(spark, [])).count() == 0


def test_reliabilities_find_the_random_labeler():
    r = random.Random(1)
    counts = collections.Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        good = [(1 if y else -1) if r.random() < 0.9 else (-1 if y else 1) for _ in range(3)]
        counts[(*good, r.choice((-1, 1)))] += 1
    _, found = pii.reliabilities(dict(counts))
    assert abs(found["prior"] - 0.4) < 0.05 and found["real"][0][1] > 0.85 and abs(found["real"][3][1] - found["not"][3][1]) < 0.1
    bias, w = pii.span_classifier({(0, 0): {True: 95.0, False: 5.0}, (0, 7): {True: 5.0, False: 95.0}}, {True: 100.0, False: 100.0})
    assert bias == 0 and w[0][0] > 0 > w[0][7]


def test_sharding(spark, tmp_path):
    texts = sample_texts(3, 30)
    docs = documents(spark, texts)
    rows = sharding.op4_hilbert_sharding(spark, tables(tmp_path, documents=docs)).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes[i] for i in range(16)) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    cells = spark.range(512).selectExpr("id % 8 as a", "id div 8 % 8 as b", "id div 64 as c", "id as cell0")
    at = np.array(sorted(tuple(r) for r in sharding.with_curve(cells, "d", *map(F.col, "abc"), bits=3).select("d", "a", "b", "c").collect()))
    assert (at[:, 0] == np.arange(512)).all() and (np.abs(np.diff(at[:, 1:], axis=0)).sum(1) == 1).all()
    assert sharding.hilbert_shards(documents(spark, [])).count() == 0
    manifest = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert manifest.agg(F.sum("rows")).first()[0] == len(texts) and 0 < sharding.prune(manifest, source="s1").count() <= 4


def test_top_k(spark):
    r = np.random.RandomState(1)
    x = r.randn(300, 8).astype(np.float32)
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    rows += [(400, None, 0), (500, [1.0] * 7 + [None], 0), (600, [float("nan")] * 8, 0), (700, [float("inf")] * 8, 0), (800, [], 0), (None, [1.0] * 8, 0), (900, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in topk.top_k(table, F.col("vec_id") % 100 == 0, segment_rows=16).collect()}
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    want = set()
    for q in (0, 100, 200):
        s = v @ v[q]
        want |= {(q, k + 1, int(i), int(s[i])) for k, i in enumerate([j for j in np.lexsort((np.arange(300), -s)) if j != q][:10])}
    assert got == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_records(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = sample_texts(4, 20) + ["a  b\n\nc\td e", " lead", "trail ", "it's we'll", "\n", "日本語 です。", "a\r\nb", "<|endoftext|> x", "don't.  12, 34,5. ", "word " + "x" * 5000]
    out = records.encode_records(documents(spark, texts), str(tmp_path / "r"), file_text_bytes=40_000)
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    tok = Tokenizer.from_file(records.default_tokenizer())
    tok.encode_special_tokens = True
    at = 0
    for t, r in zip(texts, rows, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [records.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    back = records.read_records(spark, str(tmp_path / "r"), out.filter("doc_id in (3, 8)")).collect()
    assert {b["doc_id"]: b["ids"] for b in back} == {i: tok.encode(texts[i], add_special_tokens=False).ids + [2] for i in (3, 8)}
    raw = bytearray(records.frame(7, np.array([1, 2, 3]), 2))
    assert [(d, i.tolist()) for _, _, d, i in records.frames(bytes(raw))] == [(7, [1, 2, 3])]
    raw[-8] ^= 1
    with pytest.raises(ValueError, match="payload"):
        list(records.frames(bytes(raw)))
    assert records.encode_records(documents(spark, []), str(tmp_path / "e")).count() == 0


def test_encoder_is_exact_on_odd_text():
    enc = records.Encoder(records.default_tokenizer())
    r = random.Random(1)
    texts = ["".join(r.choice(" \n\t.,'ab1é 中😀s") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for _ in range(2):
        assert [a.tolist() for a in enc.encode(texts)] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]


def test_language(spark):
    r = random.Random(2)
    lexicon = {"en": "the and thing house water small", "de": "der und haus wasser klein zug", "fr": "le et maison eau petit très"}
    rows = []
    for i in range(240):
        k = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(r.choice(lexicon[k].split()) for _ in range(30)), k, 1))
    rows += [(900, None, "en", 1), (901, "123 !?", None, 1), (902, "", "de", 1), (903, "中文", None, 1), (904, "the thing and " * 9000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(docs, model).collect()}
    assert all(got[i][0] == rows[i][2] for i in range(240)) and got[904][0] == "en"
    assert {got[i] for i in (900, 901, 902)} == {("und", 0.0)} and got[903][0] in lexicon and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs, langid.train(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


@pytest.mark.parametrize("lane, block", [(512, 2048), (7, 3), (1, 1)])
def test_cross_parsing_counts_phrases(monkeypatch, lane, block):
    monkeypatch.setattr(langid, "LANE", lane)
    monkeypatch.setattr(langid, "BLOCK", block)
    r = np.random.RandomState(0)
    for _ in range(40):
        refs = [r.randint(1, 5, r.randint(1, 60)).tolist() for _ in range(2)]
        texts = [r.randint(0, 6, r.choice([0, 1, 3, 40, 90])).tolist() for _ in range(r.randint(0, 5))]
        want = np.zeros((2, len(texts)), int)
        for k, ref in enumerate(refs):
            text = "".join(map(str, ref))
            for m, q in enumerate(texts):
                i = 0
                while i < len(q):
                    j = i + 1
                    while j <= len(q) and "".join(map(str, q[i:j])) in text:
                        j += 1
                    want[k, m], i = want[k, m] + 1, max(j - 1, i + 1)
        off = np.cumsum([0, *map(len, texts)])
        got = langid.phrases(off, np.array(sum(texts, []), np.int32), [langid.automaton(x, 6) for x in refs])
        assert (got == want).all()


def test_mixing(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        kind = i % 10
        t = [r.choice(words) for _ in range(60)]
        if kind == 0:
            t[::6] = ["idiot"] * len(t[::6])
        if kind == 1:
            t = [x + "###" for x in t]
        rows.append((i, " ".join(t), "k", 1))
        if i % 2 == 0 or kind == 1:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(900, None, "k", 1), (901, "", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in mixing.mix_documents(docs, known).collect()}
    assert all(got[i]["rate"] > 0.9 for i in range(300) if i % 10 > 1) and all(got[i]["rate"] < 0.2 for i in range(0, 300, 10))
    held = np.array([np.array(x["posterior"]) * x["n_tokens"] for x in got.values()])
    rates = np.array([x["rate"] for x in got.values()])
    total = (held * rates[:, None]).sum(0)
    assert abs(total[0] / held.sum(0)[0] - 1) < 0.05 and abs(total[1] / (held.sum(0)[0] * 3 / 97) - 1) < 0.3
    kept = {x["doc_id"] for x in mixing.kept_by_rate(docs, known).collect()}
    assert not kept & set(range(0, 300, 10)) and len(kept & {i for i in range(300) if i % 10 > 1}) > 225
    assert {x["rate"] for x in mixing.mix_documents(docs, known.limit(0)).collect()} == {1.0}
    assert mixing.mix_documents(docs.limit(0), known).count() == 0


def test_line_templates(spark):
    r = random.Random(9)
    plain = ["\n".join(" ".join(f"{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(6)) for _ in range(2)) for _ in range(20)]
    texts = [t + f"\nPrinted at 1{i}:30 on page {i} by the press office\n\nAll rights reserved." for i, t in enumerate(plain)] + [None, "", "All rights reserved."]
    got = {r["doc_id"]: r for r in templates.drop_recurring_lines(documents(spark, texts)).collect()}
    assert [got[i]["text"] for i in range(20)] == [t + "\n" for t in plain]
    assert got[20]["text"] is None and got[21]["text"] == "" and got[22]["text"] == "" and got[0]["n_dropped"] == 2 and got[0]["n_lines"] == 5
    assert templates.drop_recurring_lines(documents(spark, [])).count() == 0
    few = templates.drop_recurring_lines(documents(spark, ["same line of text here"] * 4)).collect()
    assert all(r["n_dropped"] == 0 for r in few)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hits(docs, items):
    index = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(WORD, ascii_lower(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            index[tuple(w[j : j + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, got = re.findall(WORD, ascii_lower(t)), set(), set()
        for n in {len(k) for k in index}:
            for j in range(len(w) - n + 1):
                if found := index.get(tuple(w[j : j + n])):
                    got |= found
                    hit |= set(range(j, j + n))
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, tmp_path):
    r = random.Random(4)
    vocabulary = [f"wörd{i}" for i in range(60)] + ["The", "a"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((10, 11, 25, 40, 9, 3, 1, 12))] + [(20, None), (21, ""), (22, "!?"), (23, "a a a a a a a a a a a a")]
    items.append((30, items[2][1]))
    docs = [None, "", "...", "a " * 50, items[6][1]]
    for i in range(60):
        w, item = say(r.randint(5, 80)), items[i % 8][1].split()
        k = r.randint(1, len(item))
        at = r.randrange(len(w))
        w[at:at] = item[r.randint(0, len(item) - k) :][:k] if i % 3 else item
        docs.append(", ".join(w) if i % 2 else " ".join(w).upper().replace("Ö", "ö"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    sf = tables(tmp_path, documents=documents(spark, docs), benchmark=bench)
    df = decontam.op10_winnowing(spark, sf)
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in df.collect()}
    assert got == hits(list(enumerate(docs)), items)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert decontam.decontaminated(documents(spark, []), bench).count() == 0
    assert decontam.decontaminated(documents(spark, docs), bench.limit(0)).filter("contaminated").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    one = classes(list(rows.items()))
    dirty = hits(list(rows.items()), items)
    clean = {i for i in rows if one[i][1] == i and not dirty[i][4]}
    out = corpus_pipeline.run(spark, sf).collect()
    got = {r["doc_id"] for r in out}
    assert len(got) == len(out) and got <= clean
    good = {r["doc_id"] for r in common.table(spark, sf, "labels").filter("toxic = 0 and quality = 1").collect()}
    toxic = {r["doc_id"] for r in common.table(spark, sf, "labels").filter("toxic = 1").collect()}
    assert len(got & good) >= 0.95 * len(clean & good) and len(got & toxic) <= 0.3 * max(1, len(clean & toxic))
    at = 0
    for r in sorted(out, key=lambda r: r["doc_id"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_registry():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.queries()} == {str(i) for i in range(1, 14)}
