"""The registered queries: each applies one operator to its whole table.

The two on vectors have SQL that checks them. For the others there is none: DuckDB has
neither XXH64 with a seed, byte-level BPE, checksums by digit, nor models to train.
``tests/llm`` holds each against a brute-force version instead.
"""

from __future__ import annotations

from curbside.llm.byte_bpe import op6_byte_bpe
from curbside.llm.collocations import op11_collocations
from curbside.llm.context_mixing import op13_context_mixing
from curbside.llm.embeddings import op1_embedding_dedup
from curbside.llm.language import op7_language
from curbside.llm.packing import op8_packing
from curbside.llm.pii import op4_pii
from curbside.llm.quality import op10_quality
from curbside.llm.secret_scan import op9_secrets
from curbside.llm.simhash import op3_simhash
from curbside.llm.spelling import op12_spelling
from curbside.llm.topk_search import op2_topk
from curbside.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_context_mixing": op13_context_mixing,
}

_USABLE = """
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""

ORACLE_SQL = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE vectors AS (
    SELECT * FROM ({_USABLE}) WHERE len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reached(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), roots AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts ON a = vec_id
""",
    "op2_topk": f"""
WITH vectors AS (
    SELECT vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
    FROM ({_USABLE})
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT)
             AS score
    FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place
      FROM scores)
WHERE place <= 5
""",
    "op11_collocations": r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents WHERE text IS NOT NULL
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), lines AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lines GROUP BY lang
), places AS (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM lines, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m
), f AS (
    SELECT lang, m, w[i : i + m - 1] AS p, count(*) AS a FROM places
    GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
    SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scores AS (
    SELECT c.lang, c.m, c.p, c.a, c.k, x.a AS l, y.a AS r,
           CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.a + y.a) AS BIGINT) AS score
    FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.k]
    JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 : c.m]
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM scores
), lengths AS (
    SELECT lang, m, p, a, unnest(range(2, m)) AS size FROM f WHERE m > 2
), inner_places AS (
    SELECT *, unnest(range(1, m - size + 2)) AS i FROM lengths
), within AS (
    SELECT lang, p[i : i + size - 1] AS p, max(a) AS longer FROM inner_places GROUP BY ALL
), phrases AS (
    SELECT o.lang, array_to_string(o.p, ' ') AS phrase, o.a, o.l, o.r, o.score
    FROM lowest o LEFT JOIN within w ON w.lang = o.lang AND w.p = o.p
    WHERE o.place = 1
      AND (w.longer IS NULL OR 100 * CAST(w.longer AS HUGEINT) < 80 * CAST(o.a AS HUGEINT))
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM phrases
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
WHERE rank <= 2000
""",
}
