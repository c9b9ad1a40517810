"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import bitplanes, licences, resampling
from tidemark.llm.decontaminate import PERCENT, WINDOW
from tidemark.llm.minhash import SHINGLE, SIMILARITY
from tidemark.llm.vectorgraph import COSINE
from tidemark.llm.warc import LEAST

_LOWER = f"translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE} + 2), lambda p: array_to_string(list_slice(w, p, p + {SHINGLE} - 1), ' ')) END) AS shingle FROM d),
  n AS (SELECT d.doc_id, count(s.shingle) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {SIMILARITY} * (x.n + y.n - common)),
  r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT doc_id, any_value(n) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""

#: The same list as the query's: notices and whole licences.
_ALL_KNOWN = [(name, text) for name, texts in licences.KNOWN.items() for text in texts] + licences.whole_licences()
_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in dict.fromkeys(_ALL_KNOWN))


def _canonical(text: str) -> str:
    out = f"translate({text}, '{licences.UPPER}', '{licences.LOWER}')"
    for variant, usual in licences.SPELLINGS:
        out = f"replace({out}, {_quoted(variant)}, {_quoted(usual)})"
    out = f"regexp_replace({out}, '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{licences.PUNCTUATION}', ' ', 'g'))"


def _digest(text: str) -> str:
    return f"CASE WHEN {_canonical(text)} <> '' THEN sha256({_canonical(text)}) END"


LICENCES = f"""
WITH k AS (SELECT {_digest('text')} AS digest, min(licence) AS licence FROM (VALUES {_KNOWN}) v(licence, text) GROUP BY 1),
  d AS (SELECT doc_id, {_digest('text')} AS text_digest, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  u AS (SELECT doc_id, unnest(lines) AS line FROM d),
  f AS (SELECT doc_id, licence FROM (SELECT doc_id, {_digest('line')} AS digest FROM u) JOIN k USING (digest)),
  g AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS licence_lines FROM f GROUP BY doc_id)
SELECT d.doc_id, d.text_digest, k.licence AS text_licence, coalesce(g.line_licences, '') AS line_licences, coalesce(g.licence_lines, 0) AS licence_lines
FROM d LEFT JOIN k ON k.digest = d.text_digest LEFT JOIN g ON g.doc_id = d.doc_id
"""

ARCHIVE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS words FROM
    (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
  dw AS (SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS words FROM
    (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
  h AS (SELECT doc_id, item_id, k, p FROM dw JOIN iw USING (k, words)),
  n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
  t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * 100 >= len(w) * {PERCENT} AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  g AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  u AS (SELECT * FROM g WHERE norm > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {COSINE}),
  r AS (SELECT vec_id, vec_id AS reached FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
  n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(reached) AS component_id, vec_id = min(reached) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""


def _clusters() -> str:
    """The rounds written out; DuckDB's // rounds towards zero, so the sums are brought to a multiple of the count first."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, v, unnest(d).c AS cluster, unnest(d).distance AS distance FROM (
    SELECT vec_id, any_value(v) AS v, [arg_min({{'c': c, 'distance': distance}}, (distance, c))] AS d FROM (
      SELECT vec_id, v, c, list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS distance FROM k, c{r}) GROUP BY vec_id))"""
    moved = """c{s} AS MATERIALIZED (SELECT c, coalesce(any_value(w), any_value(m)) AS m FROM c{r} LEFT JOIN (
    SELECT cluster, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS t, count(*) AS n FROM a{r}, range(1, {n} + 1) x(i) GROUP BY cluster, i) GROUP BY cluster) ON cluster = c GROUP BY c)"""
    steps = [
        f"""WITH e AS (SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = {bitplanes.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({bitplanes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM e)",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (
    SELECT v, sha256('{bitplanes.SEED}:' || vec_id) AS h FROM k ORDER BY h LIMIT {bitplanes.CLUSTERS}))""",
    ]
    for r in range(bitplanes.ROUNDS):
        steps += [nearest.format(r=r, n=bitplanes.DIMENSIONS), moved.format(r=r, s=r + 1, n=bitplanes.DIMENSIONS)]
    last = bitplanes.ROUNDS
    return ",\n  ".join([*steps, nearest.format(r=last, n=bitplanes.DIMENSIONS)]) + f"""
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON c = cluster
"""


CLUSTERS = _clusters()

#: crc32 by its table of 256 steps, over the bytes of each distinct word.
RESAMPLING = rf"""
WITH x AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) r(i)),
  d AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), q AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
  w AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM q)),
  b AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, steps[(xor(c, y) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket FROM w, x),
  s AS (SELECT bucket, count(*) AS s FROM d JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM q JOIN b USING (word) GROUP BY bucket),
  g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {resampling.BUCKETS})
    / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {resampling.BUCKETS}))))::BIGINT AS gain
    FROM range({resampling.BUCKETS}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
  m AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM d JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
  f AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight FROM documents LEFT JOIN m USING (doc_id)),
  p AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM f),
  o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM p WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {resampling.PERCENT} * n // 100 THEN place END AS rank FROM p LEFT JOIN o USING (doc_id)
"""

ORACLES = {
    "op1_minmax_near_duplicates": NEAR_DUPLICATES, "op4_licence_digests": LICENCES, "op5_content_addressed_archive": ARCHIVE, "op10_positional_decontamination": CONTAMINATION,
    "op11_pruned_graph_near_duplicates": NEAR_VECTORS, "op12_bit_plane_clustering": CLUSTERS, "op13_radix_importance_resampling": RESAMPLING,
}
