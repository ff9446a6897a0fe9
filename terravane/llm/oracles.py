"""DuckDB SQL for the corpus queries that SQL can express, by query; brute force over whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op1_fm_substring"] = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT h, min(doc_id) AS m FROM k GROUP BY 1),
    g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (h) WHERE m < doc_id),
    r AS (SELECT doc_id, count(*) AS n, list(p) AS gone FROM g GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id)"""

SQL["op2_circulant_minhash"] = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(@LOW, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id WHERE r.root < e.y),
    c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)""".replace("@LOW", _LOW)

SQL["op5_pivot_topk"] = r"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

SQL["op10_winnowing"] = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(@LOW, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(@LOW, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
    n AS (SELECT DISTINCT least(10, len(w)) AS n FROM b WHERE len(w) > 0),
    bk AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    dk AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
    m AS (SELECT DISTINCT doc_id, n, i, item_id FROM dk JOIN bk USING (n, k)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""".replace("@LOW", _LOW)

# CRC-32 byte by byte: the table of the reflected polynomial 0xEDB88320, then the bytes of each distinct word.
SQL["op12_word_trie_resampling"] = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(@LOW, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT list_filter(string_split_regex(@LOW, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    du AS (SELECT row_id, unnest(w) AS f FROM (SELECT w, row_number() OVER () AS row_id FROM d)), bu AS (SELECT unnest(w) AS f FROM b),
    tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
    v AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS k
        FROM (SELECT f FROM du UNION SELECT f FROM bu), tab),
    s AS (SELECT k, count(*) AS s FROM du JOIN v USING (f) GROUP BY 1), t AS (SELECT k, count(*) AS t FROM bu JOIN v USING (f) GROUP BY 1),
    a AS (SELECT (SELECT count(*) FROM du) AS sa, (SELECT count(*) FROM bu) AS ta),
    g AS (SELECT f, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000)::DOUBLE)))::BIGINT AS gain FROM v LEFT JOIN s USING (k) LEFT JOIN t USING (k), a),
    e AS (SELECT row_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*)::DOUBLE)::BIGINT AS weight FROM du JOIN g USING (f) GROUP BY 1),
    c AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
        FROM (SELECT *, row_number() OVER () AS row_id FROM d) LEFT JOIN e USING (row_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS able FROM c)
    SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM r""".replace("@LOW", _LOW)
