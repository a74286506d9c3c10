"""DuckDB SQL for the text queries that SQL can express at the size of the correctness check."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

TOPK = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5"""

REPEATS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
many AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT doc_id, k FROM win WHERE s IN (SELECT s FROM many)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
mark AS (SELECT word.doc_id, word.k, x, coalesce(max(hit.k) OVER (PARTITION BY word.doc_id ORDER BY word.k) >= word.k - 34, false) AS gone FROM word LEFT JOIN hit ON word.doc_id = hit.doc_id AND word.k = hit.k),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY k) FILTER (NOT gone) AS t FROM mark GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.a"""

#: CRC-32 of the bytes that hexadecimal digits spell.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) // 2 + 1), lambda i: CAST('0x' || {0}[2 * i - 1:2 * i] AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


def _crc(text: str) -> str:
    return _CRC.format(f"hex(encode({text}))")


BACKOFF = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc("CAST(doc_id AS VARCHAR)")} % 5 = 1, false) AS held, list_concat([' s'], {_WORDS.format(_LOW)}, [' e']) AS w FROM documents),
x AS (SELECT r, held, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS MATERIALIZED (SELECT r, held, lag(x) OVER (PARTITION BY r ORDER BY i) AS h, x FROM x),
c AS MATERIALIZED (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x),
n AS MATERIALIZED (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c WHERE x <> ' s'),
g AS MATERIALIZED (SELECT h, x, count(*) AS g FROM t WHERE NOT held AND h IS NOT NULL GROUP BY ALL),
q AS MATERIALIZED (SELECT length(bin(c.c)) AS k, (count(*) FILTER (g = 1) + 0.5::DOUBLE) / (sum(g) + 1) AS q FROM g JOIN c ON g.h = c.x GROUP BY k),
m AS (SELECT c.x AS h, c.c AS ch, q FROM c JOIN q ON length(bin(c.c)) = q.k),
p AS (SELECT t.r, coalesce(c.c, 0) AS cx, ch, q, g, (coalesce(c.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p FROM t CROSS JOIN n LEFT JOIN c ON t.x = c.x LEFT JOIN m ON t.h = m.h LEFT JOIN g ON t.h = g.h AND t.x = g.x WHERE t.h IS NOT NULL),
s AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (cx > 0) AS n_known, fsum(log10(p)) AS base, fsum(log10(CASE WHEN ch IS NULL THEN p ELSE (1 - q) * coalesce(g, 0) / ch + q * p END)) AS score FROM p GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, round(base, 6) AS base_score, round(score, 6) AS score FROM d JOIN s ON d.r = s.r CROSS JOIN n"""


def _centroids(rounds: int = 10) -> str:
    """Lloyd's rounds one after the other."""
    near = "SELECT v.r, v.vec_id, v.q, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.cluster)) AS cluster, min(CAST(list_sum(list_transform(list_zip(v.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)) AS distance FROM v CROSS JOIN {0} c GROUP BY ALL"
    steps = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, q AS c FROM v QUALIFY cluster < 8)"]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(f'c{k}')})")
        steps.append(f"s{k} AS (SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, 65)) AS j FROM a{k}) GROUP BY ALL)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT cluster, list((s - (s % n + n) % n) // n ORDER BY j) AS c FROM s{k} GROUP BY cluster) m ON c.cluster = m.cluster)")
    steps.append(f"a AS MATERIALIZED ({near.format(f'c{rounds}')})")
    return f"""
WITH {", ".join(steps)},
i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS n FROM a GROUP BY cluster)
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, i.n AS cluster_inertia, (SELECT CAST(sum(n) AS BIGINT) FROM i) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a JOIN i ON a.cluster = i.cluster JOIN c{rounds} c ON a.cluster = c.cluster"""


CENTROIDS = _centroids()

_BUCKET_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLING = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_BUCKET_WORDS} AS w FROM documents),
b AS (SELECT unnest({_BUCKET_WORDS}) AS x FROM benchmark),
x AS MATERIALIZED (SELECT r, unnest(w) AS x FROM d),
k AS MATERIALIZED (SELECT x, {_crc("x")} % 10000 AS k FROM (SELECT x FROM x UNION SELECT x FROM b)),
s AS (SELECT k, count(*) AS s FROM x JOIN k ON x.x = k.x GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN k ON b.x = k.x GROUP BY k),
g AS MATERIALIZED (SELECT s.k, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) AS DOUBLE) / CAST((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.k = t.k),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM x JOIN k ON x.x = k.x JOIN g ON k.k = g.k GROUP BY r),
o AS MATERIALIZED (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m ON d.r = m.r),
f AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER () // 100 AS most FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM o LEFT JOIN f ON o.r = f.r"""
