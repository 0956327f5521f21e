"""The operators' results in plain SQL, where SQL can express them."""

from __future__ import annotations

from credsieve.llm import chat, embedding_dedup, mixing, ngram_join, sharding
from credsieve.llm.decontaminate import WINDOW_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_COMPONENTS = """
reach(node, other) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
),
smallest AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""

OP2 = f"""
WITH rows_ AS (
    SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, {sharding.ID_BITS // 4}))::BIGINT AS hash
    FROM documents
),
levels AS (SELECT unnest(range(0, {sharding.ID_BITS + 1}))::BIGINT AS depth),
buckets AS (
    SELECT depth, hash >> ({sharding.ID_BITS} - depth) AS prefix,
           sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
    FROM rows_, levels GROUP BY ALL
),
places AS (
    SELECT doc_id, n_bytes, depth, prefix, shard_bytes, shard_rows,
           row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth
    FROM rows_, levels
    JOIN buckets USING (depth)
    WHERE prefix = hash >> ({sharding.ID_BITS} - depth)
      AND (shard_bytes <= {sharding.SHARD_BYTES} OR shard_rows = 1)
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 64) || bin(prefix), depth) END AS shard,
       depth, shard_bytes, shard_rows
FROM places WHERE nth = 1
"""

OP4 = f"""
WITH items AS (
    SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM benchmark
),
windows AS (
    SELECT DISTINCT item_id, list_slice(w, i + 1, i + {WINDOW_WORDS}) AS win
    FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - {WINDOW_WORDS - 1}))) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS k FROM windows),
slices AS (
    SELECT doc_id, k, p, list_slice(w, p, p + k - 1) AS win
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, sizes WHERE len(w) >= k)
),
hits AS (SELECT doc_id, k, p, item_id FROM slices JOIN windows USING (win)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids
    FROM hits GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP5 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + {ngram_join.SHINGLE_WORDS}), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {ngram_join.SHINGLE_WORDS - 1}))) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * o >= {ngram_join.THRESHOLD} * (p.n + q.n - o)
),
nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN smallest ON node = doc_id
"""

_WEIGHTS = ", ".join(str(w) for w in mixing.WEIGHTS)
_SLOPES = ", ".join(str(s) for s in mixing.SLOPES)

OP8 = f"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SPACED}))::BIGINT AS size,
           substr(md5(doc_id::VARCHAR), 1, 15) AS place
    FROM documents
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           list_extract([{_WEIGHTS}]::DOUBLE[], 1 + (row_number() OVER o - 1) % {len(mixing.WEIGHTS)}) AS weight,
           list_extract([{_SLOPES}]::DOUBLE[], 1 + (row_number() OVER o - 1) % {len(mixing.SLOPES)}) AS slope
    FROM docs GROUP BY source WINDOW o AS (ORDER BY source NULLS LAST)
),
capped AS (SELECT *, source_size * {float(mixing.MAX_REPEATS)}::DOUBLE AS cap, sum(source_size) OVER () * {mixing.SHARE}::DOUBLE AS demand FROM sources),
levels AS (
    SELECT *, (demand - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM capped WINDOW f AS (ORDER BY cap / weight, source NULLS FIRST)
),
one AS (SELECT min(level) FILTER (level <= cap / weight) AS unused, arg_min(level, cap / weight) FILTER (level <= cap / weight) AS level FROM levels),
targets AS (
    SELECT source, source_size, slope, demand, CASE WHEN one.level IS NULL THEN cap ELSE least(cap, one.level * weight) END AS target
    FROM levels, one
),
placed AS (
    SELECT doc_id, size, source_size, target, slope, demand, sum(size) OVER (PARTITION BY docs.source ORDER BY place, doc_id::VARCHAR, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
    FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
),
taken AS (
    SELECT *, (start + size / 2 < target)::BIGINT + (source_size + start + size / 2 < target)::BIGINT AS passes,
           (0 * source_size + start + size / 2) / target AS u, 1 - slope AS b
    FROM placed
)
SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken,
       CASE WHEN passes > 0 THEN floor(CASE WHEN slope = 0 THEN u ELSE (sqrt(b * b + 4 * slope * u) - b) / (2 * slope) END * demand)::BIGINT END AS first_position
FROM taken
"""

OP9 = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {embedding_dedup.THRESHOLD}
),
{_COMPONENTS},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept
FROM smallest LEFT JOIN counts ON a = node
"""

_ESCAPED = f"replace(replace({{0}}, '{chat.ESCAPE}', '{chat.ESCAPE}0'), '<|', '{chat.ESCAPE}1')"

OP10 = f"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '{chat.END}{chat.START}assistant ok' FROM range(2) t(i)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('{chat.START}{chat.END}') + 2 + length(replace({_ESCAPED.format('role')}, chr(10), '{chat.ESCAPE}2'))
           + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""

OP12 = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
        list_inner_product(a.v, r.v)::BIGINT AS score
    FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
),
negatives AS (
    SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
    FROM positives p JOIN scored s USING (anchor_id)
    WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

ORACLES = {
    "op2_sharding": OP2,
    "op4_decontaminate": OP4,
    "op5_ngram_join": OP5,
    "op8_mixing": OP8,
    "op9_embedding_dedup": OP9,
    "op10_chat": OP10,
    "op12_hard_negatives": OP12,
}
