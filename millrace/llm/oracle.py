"""The training-data queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

RECORDS = r"""recs AS MATERIALIZED (SELECT docid, regexp_extract_all(lower(min(trim(text, chr(32) || chr(9) || chr(10) || chr(12) || chr(13)))), '[a-z](?:[^ \t\n\r\f]*[a-z])?') AS t
FROM query_results WHERE docid IS NOT NULL AND text IS NOT NULL GROUP BY docid), total AS (SELECT count(*) AS total FROM recs),
occ AS (SELECT docid, unnest(t) AS term FROM recs), tf AS MATERIALIZED (SELECT docid, term, count(*)::INTEGER AS tf FROM occ GROUP BY 1, 2)"""
FREQUENCY = f"WITH {RECORDS}, freq AS (SELECT term, sum(tf)::BIGINT AS n, count(*) AS df, CASE WHEN count(*) <= 2 THEN 'rare' WHEN 10 * count(*) >= (SELECT total FROM total) THEN 'common' END AS mark FROM tf GROUP BY term)"
SCORES = f"""WITH {RECORDS}, marginal AS (SELECT term, count(*) AS df, sum(tf) AS n_t FROM tf GROUP BY term), lens AS (SELECT docid, len(t) AS len FROM recs WHERE len(t) > 0),
smooth AS (SELECT sum(pow(len, 0.75)) AS z FROM lens),
scores AS (SELECT tf.docid, tf.term, tf.tf, df, greatest(0.0, ln(tf * z / (n_t * pow(len, 0.75)))) AS ppmi, tf * ln((SELECT total FROM total)::DOUBLE / df) AS weight
FROM tf JOIN marginal USING (term) JOIN lens USING (docid), smooth)"""


def _pairs(terms: str) -> str:
    return f"""WITH {RECORDS}, items AS MATERIALIZED (SELECT docid, unnest(list_distinct({terms})) AS term FROM recs), single AS (SELECT term, count(*) AS c FROM items GROUP BY term),
pairs AS (SELECT a.term AS term_a, b.term AS term_b, count(*) AS n FROM items a JOIN items b ON a.docid = b.docid AND a.term < b.term GROUP BY 1, 2),
rated AS (SELECT term_a, term_b, n, x.c AS c_a, y.c AS c_b, n * (SELECT total FROM total) / (x.c::DOUBLE * y.c) AS lift FROM pairs JOIN single x ON x.term = term_a JOIN single y ON y.term = term_b)"""


TOP = """WITH newest AS (SELECT source, nodeid, max(CASE WHEN isfinite(logp) THEN logp END)::DOUBLE AS score FROM ppr_scores WHERE source IS NOT NULL AND nodeid IS NOT NULL
GROUP BY source, nodeid, iteration QUALIFY row_number() OVER (PARTITION BY source, nodeid ORDER BY iteration DESC NULLS LAST) = 1),
top AS (SELECT source, nodeid, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, nodeid)::INTEGER AS rank FROM newest WHERE score IS NOT NULL QUALIFY rank <= 10)"""

ORACLE: dict[str, str] = {
    "p1_found": f"{FREQUENCY} SELECT term, mark FROM freq WHERE mark IS NOT NULL",
    "p1_terms": f"{FREQUENCY} SELECT term, n, df, mark FROM freq",
    "p2_found": f"""{SCORES}, ranked AS (SELECT docid, term, round(weight, 6) AS w, row_number() OVER (PARTITION BY docid ORDER BY round(weight, 6) DESC, term) AS r FROM scores WHERE df >= 3)
SELECT a.docid, a.term FROM ranked a JOIN ranked b ON a.docid = b.docid AND a.r = 1 AND b.r = 2 WHERE a.w >= 2 * b.w""",
    "p2_scores": f"{SCORES} SELECT docid, term, tf, df, round(ppmi, 6) AS ppmi FROM scores",
    "p3_found": f"{_pairs('t[:40]')} SELECT term_a, term_b FROM rated WHERE n >= 5 AND 5000 * n >= (SELECT total FROM total) AND n * (SELECT total FROM total) >= 20 * c_a * c_b",
    "p3_pairs": f"{_pairs('t')} SELECT term_a, term_b, n, c_a, c_b, round(lift, 6) AS lift FROM rated",
    "p5_found": f"{TOP} SELECT source, nodeid FROM top",
    "p5_top": f"{TOP} SELECT source, nodeid, score, rank FROM top",
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_chars": """WITH each AS (SELECT profile, capacity, n_chars AS n FROM documents, (SELECT DISTINCT profile, capacity FROM pack_profiles) WHERE n_chars > 0)
SELECT profile, count(*) AS items, sum((n + capacity - 1) // capacity)::BIGINT AS parts, sum(n)::BIGINT AS chars, ((sum(n) + capacity - 1) // capacity)::BIGINT AS least, 0::BIGINT AS wrong FROM each GROUP BY profile, capacity""",
    "p8_texts": "SELECT source, count(*) AS texts FROM documents GROUP BY source",
}
