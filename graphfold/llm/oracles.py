"""The same results in DuckDB's SQL, for the operators and parts of operators that SQL can express."""

from __future__ import annotations

#: Documents with their words, shingles and links; recursion over links gives the components.
NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2], ' ', ws[i + 3]))) END AS sh FROM w
),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, hash(x) AS g, x FROM (SELECT doc_id, unnest(sh) AS x FROM s)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM g a JOIN g b ON a.g = b.g AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.both >= 85 * (x.n + y.n - c.both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS start, a AS id FROM e UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.id),
m AS (SELECT start, min(id) AS component FROM r GROUP BY start)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component, n.doc_id) AS component_id FROM n LEFT JOIN m ON m.start = n.doc_id
"""

#: Strings of 50 bytes as 100 hexadecimal digits; runs of covered bytes are islands of their places.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
-- pieces of 1000 places, so that no long string is cut at each of its places
c AS (SELECT doc_id, length(hx) // 2 - 50 AS last, unnest(generate_series(0, (length(hx) // 2 - 50) // 1000)) AS k, hx FROM d WHERE length(hx) >= 100),
y AS (SELECT doc_id, k, least(999, last - 1000 * k) AS most, hx[2000 * k + 1 : 2000 * k + 2098] AS piece FROM c),
p AS (SELECT doc_id, k, piece, unnest(generate_series(0, most)) AS j FROM y),
x AS (SELECT doc_id, 1000 * k + j AS i, md5_number(piece[2 * j + 1 : 2 * j + 100]) AS s FROM p),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s),
h AS (SELECT x.doc_id, x.i FROM x JOIN f ON f.s = x.s WHERE f.first < x.doc_id),
o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM r),
t AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(d.hx[2 * before + 1 : 2 * a], '' ORDER BY run) AS head FROM q JOIN d USING (doc_id) GROUP BY q.doc_id)
SELECT d.doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(concat(coalesce(head, ''), hx[2 * coalesce(last, 0) + 1 :]))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

_KINDS = (
    (0, "assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""),
    (1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    (2, "hex", "[0-9a-f]+", "length(m) >= 32"),
)
_MATCHES = ",\n".join(
    f"""z{k} AS (SELECT doc_id, list_zip(regexp_extract_all(t, '{pattern}'), string_split_regex(t, '{pattern}')[1 : len(regexp_extract_all(t, '{pattern}'))]) AS z FROM d),
u{k} AS (SELECT doc_id, unnest(z) AS z, generate_subscripts(z, 1) AS i FROM z{k}),
p{k} AS (SELECT doc_id, z[1] AS m, sum(length(z[1]) + length(z[2])) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM u{k}),
s{k} AS (SELECT doc_id, {k} AS kind, concat('{name}:', CAST(stop - length(m) AS BIGINT), ':', CAST(stop AS BIGINT)) AS s, stop - length(m) AS start FROM p{k} WHERE {good})"""
    for k, name, pattern, good in _KINDS
)
BASE_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_MATCHES},
every AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2, string_agg(s, ',' ORDER BY start, kind) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

URL_RULES = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, of_host, of_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM h JOIN r ON (host = of_host OR ends_with(host, concat('.', of_host))) AND starts_with(path, of_path))
SELECT h.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, f.rule, f.verdict FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.k = 1
"""

#: Every phrase of one to four words of every piece, counted by itself.
PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest(list_transform(generate_series(1, len(ws) - m + 1), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM w, generate_series(1, 4) AS s(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, a, unnest(generate_series(1, m - 1)) AS k, ws FROM c),
x AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, 2000000::HUGEINT * k.a // (l.f + r.f) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[: k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1 :], ' ')),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS one FROM x),
i AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(generate_series(2, m - 1), lambda s: list_transform(generate_series(1, m - s + 1), lambda j: array_to_string(ws[j : j + s - 1], ' ')))))) AS phrase FROM c WHERE m > 2),
z AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY lang, phrase),
v AS (SELECT o.*, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank FROM o LEFT JOIN z ON z.lang = o.lang AND z.phrase = o.phrase WHERE one = 1 AND (around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a))
SELECT v.lang, rank, v.phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM v JOIN n ON n.lang = v.lang WHERE rank <= 2000
"""

#: Every anchor against every row; sums of whole numbers stay exact in doubles.
NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE k <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

#: The texts' bytes with zeros up to a multiple of 64, which a lossless form gives back.
MEDIA_PAYLOAD = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents), n AS (SELECT doc_id, hx, length(hx) // 2 AS n, 64 * greatest(1, (length(hx) // 2 + 63) // 64) AS m FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(unhex(concat(hx, repeat('00', m - n)))) AS payload_sha256 FROM n
"""

MIXING_TOKENS = r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents"

EXACT_NEIGHBOURS = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""
