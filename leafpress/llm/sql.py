"""DuckDB equivalents of the operators' queries that SQL can express."""

from leafpress.llm.mixing import MOST_COPIES, WEIGHTS

_TOKENS = r"""tokens AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents))"""

SUBSTRINGS = rf"""WITH {_TOKENS},
windows AS (SELECT *, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS win FROM tokens),
marked AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS dup FROM windows),
gone AS (SELECT *, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

NEIGHBOURS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 20"""

_RANK = "((u / (1 - u)) / (part / (1 - part)))"
MIXING = rf"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ({list(WEIGHTS)})[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight FROM per),
filled AS (SELECT *, source_size * {MOST_COPIES}.0::DOUBLE AS cap, source_size * {MOST_COPIES}.0::DOUBLE / weight AS full_at FROM weighed),
levels AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open FROM filled WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT remaining / open FROM levels WHERE full_at >= remaining / open ORDER BY full_at, open DESC LIMIT 1), 0)) AS target FROM levels),
shares AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12), {MOST_COPIES}) AS whole, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM targets),
parts AS (SELECT *, CASE WHEN whole >= {MOST_COPIES} THEN 0 ELSE greatest(share - whole, 0) END AS part FROM shares),
drawn AS (SELECT s.doc_id, s.size, p.*, (('0x' || left(md5(s.doc_id || '/mix'), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
ranked AS (SELECT *, CASE WHEN part > 0 THEN target - whole * source_size ELSE 0 END AS need, CASE WHEN part > 0 THEN {_RANK} / (1 + {_RANK}) ELSE 1 END AS rk FROM drawn),
summed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rk, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN part > 0 AND before + size - need <= need - before THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM summed"""

JACCARD = rf"""WITH RECURSIVE {_TOKENS},
grams AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM tokens) WHERE i + 4 <= n OR n < 5 AND i = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.a, r.m FROM reach r JOIN links l ON l.b = r.d)
SELECT d AS doc_id, min(m) AS class_id, (SELECT count(*) FROM links WHERE a = d) AS n_links FROM reach GROUP BY d"""

ORACLES = {"op2_substring_dedup": SUBSTRINGS, "op4_int8_block_join": NEIGHBOURS, "op6_pareto_mixing": MIXING, "op8_minhash_forest_join": JACCARD}
