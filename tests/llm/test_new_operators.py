"""Token alignment, importance resampling and covering SimHash against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm import align, queries, resample, simhash

CLASHING = "doc_id long, text string, pair long, n long, row long, fp long, t long, id long, n_words long, rank int, row_key string, total long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, 8, "k", 9) for i, t in rows], CLASHING)


def some_texts():
    r = random.Random(5)
    words = ["the", "house", "Straße", "naïve", "don't", "x1y2", "12345", "漢字", "🙂", "é", "The", "HOUSE", "ing", "...", "<s>", "<|endoftext|>", " ", "<0x0A>"]
    out = [None, "", " ", "a", "  two  spaces ", "\n\n x\ty \r\n", "low▁line", "▁", "no-break space here", "\u0000 \u001f", "᠎ a ᠎b c"]
    out += [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) + r.choice(["", "\n", "  "]) for _ in range(40)]
    out += [out[-1], out[-2].upper(), " ".join(r.choice(words) for _ in range(20_000)), "x" * 3000]
    return out


def tokens_of(texts):
    """Per text (ids of A, their byte lengths, ids of B, theirs), by the libraries over whole texts."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = dict(zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)]))
    level |= dict(zip((x for x in range(256) if x not in level), itertools.count(256)))
    back = {chr(v): k for k, v in level.items()}
    for t in texts:
        if not t:
            yield [], [], [], []
            continue
        i, j = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        x = [bytes(back[c] for c in a.id_to_token(k)) for k in i]
        y = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in j for p in [b.id_to_piece(k)]]
        whole = (" " + t).encode()
        yield ([], [], [], []) if b"".join(x) != whole or b"".join(y) != whole else (i, list(map(len, x)), j, list(map(len, y)))


def alignments(texts):
    docs = []
    for i, x, j, y in tokens_of(texts):
        ends_a, ends_b = list(itertools.accumulate(x)), list(itertools.accumulate(y))
        links, k = [], 0
        for n, (end, size) in enumerate(zip(ends_a, x)):
            while k < len(j) and ends_b[k] <= end - size:
                k += 1
            m = k
            while m < len(j) and ends_b[m] - y[m] < end:
                links.append((i[n], j[m]))
                m += 1
        groups, p, q = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            n, m = ends_a.index(cut, p) + 1, ends_b.index(cut, q) + 1
            groups.append(f"{','.join(map(str, i[p:n]))}|{','.join(map(str, j[q:m]))}")
            p, q = n, m
        docs.append((len(i), len(j), groups, links))
    held = collections.Counter(p for *_, links in docs for p in set(links))
    most = collections.defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, len(g), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, links in docs]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40])
def test_token_links(spark, frequent):
    texts = some_texts()
    want = alignments(texts)
    assert sum(w[0] == 0 for w in want) >= 4 and max(w[0] for w in want) > 10_000
    got = align.token_links(documents(spark, [(None if i == 3 else i, t) for i, t in enumerate(texts)]).repartition(3), frequent=frequent).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == sorted((-1 if i == 3 else i, *w) for i, w in enumerate(want))


def test_token_links_edge_tables(spark):
    assert align.token_links(documents(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in align.token_links(documents(spark, [(1, None), (1, "")])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    same = align.token_links(documents(spark, [(4, "a house"), (4, "a house")])).collect()
    assert len(same) == 2 and same[0] == same[1] and same[0]["count_sum"] == 2 * same[0]["n_links"]


def test_groups_as_text(spark):
    texts = [t for t in some_texts() if t]
    rows = align.aligned(documents(spark, list(enumerate(texts))), texts=True).collect()
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows)
    assert all(len(r["pairs"]) == len(set(r["pairs"])) and sum(r["times"]) == r["n_links"] for r in rows)


def test_owner_arrays():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(0, 30)
        cut = lambda: np.diff([0, *sorted(r.sample(range(1, n), r.randint(0, n - 1) if n > 1 else 0)), n]) if n else np.zeros(0, int)  # noqa: E731, B023
        a, b = cut(), cut()
        i, j, both = align.overlaps(a, b)
        ea, eb = np.cumsum(a), np.cumsum(b)
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if ea[x] - a[x] < eb[y] and eb[y] - b[y] < ea[x]]
        assert list(zip(i.tolist(), j.tolist())) == want
        assert both.sum() == len(set(ea.tolist()) & set(eb.tolist()))
    with pytest.raises(ValueError):
        align.overlaps(np.array([2]), np.array([1]))


# --- Importance resampling.


def runs_of(text, longest):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, longest, buckets, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(of(f) for x in texts for f in runs_of(x, longest)[1]) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1.0) * float(s_all + buckets) / ((s[k] + 1.0) * float(t_all + buckets))))
    out, able = [], []
    for i, (doc_id, text) in enumerate(rows):
        w, f = runs_of(text, longest)
        weight = sum(gain(of(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if len(w) >= least:
            able.append((-score, -1 if doc_id is None else doc_id, len(f), weight, i))
    for place, (*_, i) in enumerate(sorted(able)[: len(able) * percent // 100], 1):
        out[i][4] = place
    return sorted(map(tuple, out), key=repr)


def prose():
    r = random.Random(9)
    vocabulary = [*(f"w{i}" for i in range(300)), "Été", "漢字", "ÀB", "O'Neil", "x_y", "3.14"]
    return [(i, " ".join(r.choice(vocabulary[: 20 + 10 * (i % 30)]) for _ in range(r.randint(1, 90)))) for i in range(300)]


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 500)])
def test_resampling(spark, longest, buckets):
    rows = [*prose(), (300, None), (301, ""), (302, "  ?! "), (None, "w1 " * 30), (None, "w1 " * 30), (7, prose()[7][1]), (303, "w5 Été " * 40_000)]
    target = ["w1 w2 w3 w4 Été", None, "", "w2 w3 " * 9]
    got = resample.resample(documents(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, percent=25).collect()
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got), key=repr) == resampled(rows, target, longest, buckets, 25, 20)


def test_resampling_edge_tables_and_draw(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(documents(spark, []), none).count() == 0
    few = resample.resample(documents(spark, [(1, "w " * 25)]), none).collect()
    assert few[0]["rank"] is None and few[0]["n_features"] == 25
    docs = documents(spark, prose())
    drawn = resample.draw(docs, spark.createDataFrame([("w1 w2",)], "text string"))
    ranks = resample.resample(docs, spark.createDataFrame([("w1 w2",)], "text string")).filter("rank is not null")
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in ranks.collect()} and ranks.count() > 10


@pytest.mark.parametrize("longest, step", [(1, 4), (3, 4), (3, 1), (4, 3)])
def test_trie_in_parts(monkeypatch, longest, step):
    monkeypatch.setattr(resample, "STEP", step)
    for n in range(20):
        words = [b"a b c a b".split()[i * i % 5] for i in range(n)]
        trie, want = resample.WordTrie(longest, 64), collections.Counter()
        for part in resample.nodes(trie, words):
            trie.count(part)
        for k in range(1, longest + 1):
            want.update(zlib.crc32(b" ".join(words[i : i + k])) % 64 for i in range(n - k + 1))
        got = trie.totals()
        assert dict(zip(got["bucket"].tolist(), got["n"].tolist())) == want and len(trie.crc) == 1


# --- Covering SimHash.


def simprint(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components_of(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(prints))]


def test_every_pair_within_the_radius_agrees_under_a_mask():
    for positions in (list(range(64)), list(range(3, 34)), list(range(5))):
        masks = np.array(simhash.covering(positions), np.uint64)
        assert len(masks) == 15
        for d in range(1, 4):
            apart = np.array([sum(1 << p for p in c) for c in itertools.combinations(positions, d)], np.uint64)
            assert ((apart[:, None] & masks[None, :]) == 0).any(axis=1).all()
    level, depth = [(0, 0)], 0
    while family := simhash.tables_of(level):
        level, depth = [(t, m) for _, t, m in family], depth + 1
    assert depth == 3 and all(64 - m.bit_count() <= simhash.FEW for _, m in level)


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_links_of_dense_fingerprints(spark, group):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    # Clusters in which fingerprints are two to four bits from their base, and one that differs in a few positions only.
    prints = {*base, 0, 1, 3, 7, 15, (1 << 64) - 1, *(b ^ sum(1 << p for p in r.sample(range(64), r.randint(1, 4))) for b in base[:6] for _ in range(60)), *(base[7] ^ x << 20 for x in range(300))}
    prints = sorted(prints)
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame(rows, "id long, fp long"), group=group).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3}


def test_simhash_components(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \t", "one", "One TWO", "one two", "one two three", " x", *("a b c " * k for k in (1, 2, 30))]
    for _ in range(25):
        t = [r.choice(words) for _ in range(r.randint(40, 400))]
        texts += [" ".join(t), "  ".join(t).upper() + "\n"]
        for _ in range(4):
            t = list(t)
            t[r.randrange(len(t))] = "other"
            texts.append(" ".join(t))
    texts += [texts[20], " ".join(r.choice(words) for _ in range(40_000))]
    prints = [simprint(t) for t in texts]
    label = components_of(prints)
    ids = [1000 - i if i % 7 else (5 if i < 20 else None) for i in range(len(texts))]
    want = []
    for i, p in enumerate(prints):
        same = [ids[k] for k in range(len(texts)) if label[k] == label[i] and ids[k] is not None]
        want.append((ids[i], f"{p:016x}", min(same, default=None)))
    assert len({w[2] for w in want}) > 20 and max(collections.Counter(w[2] for w in want).values()) > 3
    out = simhash.simhash_components(documents(spark, list(zip(ids, texts))).repartition(4)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op11_byte_owner_alignment", "op13_covering_simhash"])
def test_queries_over_the_whole_table(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    texts = [r["text"] for r in docs]
    if name.startswith("op11"):
        want = [(r["doc_id"], *w) for r, w in zip(docs, alignments(texts))]
    else:
        prints = [simprint(t) for t in texts]
        label, least = components_of(prints), {}
        for r, k in zip(docs, label):
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
        want = [(r["doc_id"], f"{p:016x}", least[k]) for r, p, k in zip(docs, prints, label)]
    assert [tuple(r) for r in got] == want
