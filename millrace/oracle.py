"""The same queries in DuckDB's SQL, over the registered tables."""

from __future__ import annotations

from millrace.operators.index import BLOCK
from millrace.queries import CUT, DAY, NATIONS, PMI_THRESHOLD, PPR_STEPS, SMALL_BLOCK

TOKENS = r"regexp_extract_all(lower({}), '[a-z](?:[^ \t\n\r\f]*[a-z])?')"


def _tok(column: str) -> str:
    return f"coalesce({TOKENS.format(column)}, [])"


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
TOKS = f"{LINES}, toks AS (SELECT doc_id, line_no, {_tok('line')} AS t FROM lines)"
WORDS = f"WITH {TOKS}, words AS (SELECT unnest(t) AS word FROM toks), counted AS (SELECT word, count(*) AS n FROM words GROUP BY word)"
BIGRAMS = f"WITH {TOKS}, pairs AS (SELECT unnest(list_zip(t[:-2], t[2:])) AS p FROM toks WHERE len(t) > 1), bi AS (SELECT p[1] AS \"left\", p[2] AS \"right\", count(*) AS n FROM pairs GROUP BY 1, 2), ratio AS (SELECT \"left\", \"right\", n / sum(n) OVER (PARTITION BY \"left\") AS value, n FROM bi)"
HEADS = f"{TOKS}, heads AS (SELECT row_number() OVER () AS id, list_distinct(t[:40]) AS h FROM toks), items AS (SELECT id, unnest(h) AS word FROM heads), df AS (SELECT word, count(*) AS c FROM items GROUP BY word), total AS (SELECT count(*) AS total FROM toks)"
PMI = f"""WITH {HEADS}, both_ AS (SELECT a.word AS "left", b.word AS "right", count(*) AS n FROM items a JOIN items b ON a.id = b.id AND a.word <> b.word GROUP BY 1, 2 HAVING count(*) >= {PMI_THRESHOLD}),
pmi AS (SELECT "left", "right", log10(n * total / (x.c::DOUBLE * y.c)) AS pmi, n FROM both_ JOIN df x ON x.word = "left" JOIN df y ON y.word = "right", total)"""
POSTINGS = f"posts AS (SELECT term, doc_id, count(*)::INTEGER AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY 1, 2)"
HITS = f"WITH {POSTINGS}, hits AS (SELECT doc_id FROM posts GROUP BY doc_id HAVING (bool_or(term = 'the') OR bool_or(term = 'that')) AND bool_or(term = 'of'))"


def _blocks(size: int) -> str:
    return f"placed AS (SELECT term, doc_id, tf, count(*) OVER (PARTITION BY term) AS df, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // {size} AS block FROM posts)"


GAPS = f"{_blocks(BLOCK)}, gaps AS (SELECT term, block, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term, block ORDER BY doc_id) AS gap, tf FROM placed)"
RARE_HITS = f"WITH {POSTINGS}, hits AS (SELECT doc_id FROM posts GROUP BY doc_id HAVING (bool_or(term = 'ledger') AND bool_or(term = 'harbour')) OR bool_or(term = 'orchard'))"
NODES = "nodes AS (SELECT nodeid AS id, list_filter(coalesce(adjacency, []), lambda x: x IS NOT NULL) AS adjacency FROM graph_nodes WHERE nodeid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY nodeid ORDER BY loaded_at DESC NULLS LAST, len(coalesce(adjacency, [])) DESC) = 1)"


def _ppr(select: str) -> str:
    steps = [
        f"WITH {NODES}, src AS (SELECT DISTINCT nodeid AS source FROM source_nodes WHERE is_source)",
        "edges AS (SELECT id, unnest(adjacency) AS dst, len(adjacency) AS deg FROM nodes)",
        "s0 AS MATERIALIZED (SELECT source, id, CASE WHEN id = source THEN 1.0::DOUBLE ELSE 0 END AS p FROM nodes, src)",
    ]
    for i in range(1, PPR_STEPS + 1):
        steps += [
            f"r{i} AS (SELECT source, dst, sum(p / deg) AS m FROM s{i - 1} JOIN edges USING (id) GROUP BY 1, 2)",
            f"a{i} AS MATERIALIZED (SELECT s.source, s.id, coalesce(m, 0) AS m FROM s{i - 1} s LEFT JOIN r{i} r ON r.source = s.source AND r.dst = s.id)",
            f"t{i} AS (SELECT source, greatest(0, 1 - sum(m)) AS lost FROM a{i} GROUP BY source)",
            f"s{i} AS MATERIALIZED (SELECT source, id, 0.85 * (m + CASE WHEN id = source THEN lost ELSE 0 END) + CASE WHEN id = source THEN 0.15 ELSE 0 END AS p FROM a{i} JOIN t{i} USING (source))",
        ]
    return ", ".join(steps) + f", ppr AS (SELECT source, id, round(p, 12) AS p FROM s{PPR_STEPS}) " + select


INSTANCES = f"inst AS (SELECT doc_id, CASE WHEN source LIKE 'mail\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS y, list_transform({_tok('text')}, lambda t: ('0x' || substr(md5(t), 1, 4))::INTEGER) AS features FROM documents)"
SCORES = f"""WITH {INSTANCES}, models AS (SELECT unnest([0, 1, 2])::BIGINT AS model_id), f AS (SELECT doc_id, unnest(features) AS feature FROM inst),
part AS (SELECT doc_id, model_id, sum(CASE WHEN feature % 3 <> 0 THEN feature * (2 * model_id + 7) % 201 - 100 ELSE 0 END)::DOUBLE AS s FROM f, models GROUP BY 1, 2),
scores AS (SELECT i.doc_id, m.model_id, coalesce(s, 0.0)::DOUBLE AS score FROM (SELECT DISTINCT doc_id FROM inst) i CROSS JOIN models m LEFT JOIN part USING (doc_id, model_id))"""
AVERAGE = f"{SCORES}, average AS (SELECT doc_id, round(CASE WHEN avg(score) = 0 THEN 0.0 ELSE avg(score) END, 6) AS score, CASE WHEN avg(score) > 0 THEN 'spam' ELSE 'ham' END AS predicted FROM scores GROUP BY doc_id)"
MESSAGES = "msgs AS (SELECT min(iteration) AS iteration, min(neighbor) AS neighbor, min(mass) AS mass FROM mass_messages GROUP BY msg_id HAVING min(neighbor) IS NOT NULL)"


def _trained(model: str = "0", order: str = "doc_id") -> str:
    """Training as a recursion over the instances of each model, which updates only the weights of their features."""
    return f"""WITH RECURSIVE {INSTANCES}, ordered AS (SELECT {model} AS model, row_number() OVER (PARTITION BY {model} ORDER BY {order}) AS rn, y, features FROM inst),
feats AS MATERIALIZED (SELECT model, rn, y, f, count(*) AS k FROM (SELECT model, rn, y, unnest(features) AS f FROM ordered) GROUP BY ALL UNION ALL SELECT model, rn, y, -1, 0 FROM ordered),
trained(model, f, w, rn) USING KEY (model, f) AS (SELECT DISTINCT model, -1, 0.0::DOUBLE, 0::BIGINT FROM ordered
UNION ALL SELECT model, f, w0 + k * step, rn FROM (SELECT i.model, i.f, i.k, i.rn, coalesce(r.w, 0) AS w0, (i.y - 1 / (1 + exp(-sum(i.k * coalesce(r.w, 0)) OVER (PARTITION BY i.model)))) * 0.002 AS step
FROM (SELECT model, max(rn) AS last FROM trained GROUP BY model) c JOIN feats i ON i.model = c.model AND i.rn = c.last + 1 LEFT JOIN recurring.trained r ON r.model = i.model AND r.f = i.f))"""


WEIGHTS = "SELECT model::BIGINT AS model_id, f::INTEGER AS feature, round(w, 9) + 0 AS weight FROM trained WHERE f >= 0"


NATION_LIST = ", ".join(f"'{n}'" for n in NATIONS)
JOIN4 = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"

ORACLE: dict[str, str] = {
    "q1_shipdate_count": f"SELECT count(*) AS n FROM lineitem WHERE l_shipdate = TIMESTAMP '{DAY}'",
    "q2_clerk_topk": f"SELECT o_orderpriority AS clerk, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate = TIMESTAMP '{DAY}' ORDER BY o_orderkey, clerk LIMIT 20",
    "q3_part_supplier_topk": f"SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate = TIMESTAMP '{DAY}' ORDER BY 1, 2, 3 LIMIT 20",
    "q4_nation_count": f"SELECT n_nationkey, n_name, count(*) AS n FROM {JOIN4} WHERE l_shipdate = TIMESTAMP '{DAY}' GROUP BY 1, 2",
    "q5_nation_month": f"SELECT n_nationkey, n_name, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM {JOIN4} WHERE n_name IN ({NATION_LIST}) GROUP BY 1, 2, 3",
    "q6_pricing_summary": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice), 6) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 6) AS sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate = TIMESTAMP '{DAY}' GROUP BY 1, 2""",
    "q7_shipping_priority": f"""SELECT c_name, l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate, o_orderpriority AS o_shippriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '{CUT}' AND l_shipdate > TIMESTAMP '{CUT}'
GROUP BY c_name, l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey, c_name LIMIT 10""",
    "q5_any_case": f"SELECT n_nationkey, n_name, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM {JOIN4} WHERE upper(n_name) IN ({NATION_LIST}) GROUP BY 1, 2, 3",
    "q7_left": f"""SELECT coalesce(c_name, '') AS c_name, l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate, o_orderpriority AS o_shippriority
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderdate < TIMESTAMP '{CUT}' AND l_shipdate > TIMESTAMP '{CUT}'
GROUP BY 1, l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey, c_name LIMIT 10""",
    "source_tbl": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS sum_qty, round(sum(l_extendedprice), 6) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 6) AS sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate = TIMESTAMP '{DAY}' GROUP BY 1, 2""",
    "source_adjacency": f"WITH {NODES} SELECT id, array_to_string(adjacency, ' ') AS adjacency FROM nodes",
    "source_instances": f"WITH {INSTANCES} SELECT doc_id::VARCHAR AS doc_id, y::DOUBLE AS y, len(features)::BIGINT AS n, md5(array_to_string(features, ' ')) AS digest FROM inst WHERE doc_id IS NOT NULL",
    "source_model": "SELECT f::INTEGER AS feature, (f * 7 % 201 - 100)::DOUBLE AS weight FROM range(65536) r(f) WHERE f % 3 <> 0",
    "tok_count": f"WITH {TOKS} SELECT doc_id, line_no::INTEGER AS line_no, len(t)::BIGINT AS n_tokens FROM toks",
    "word_count": f"{WORDS} SELECT word, n FROM counted",
    "top_words": f"{WORDS} SELECT word, n FROM counted ORDER BY n DESC, word LIMIT 20",
    "word_lookup": f"{WORDS} SELECT word, n FROM counted WHERE word = 'ledger'",
    "follower_count": f"{BIGRAMS} SELECT \"right\" AS word, n FROM bi WHERE \"left\" = 'the' AND n > 1",
    "line_df": f"WITH {HEADS} SELECT word, c AS n FROM df UNION ALL SELECT '*', total FROM total",
    "bigram_pairs": f"{BIGRAMS} SELECT \"left\", \"right\", round(value, 9) AS value FROM ratio UNION ALL SELECT \"left\", '*', sum(n)::DOUBLE FROM bi GROUP BY 1",
    "bigram_stripes": f"{BIGRAMS} SELECT \"left\", string_agg(\"right\" || '=' || floor(value * 1e6 + 0.5)::BIGINT, ',' ORDER BY \"right\") AS stripe FROM ratio GROUP BY 1",
    "pmi_pairs": f"{PMI} SELECT \"left\", \"right\", round(pmi, 6) AS pmi, n FROM pmi",
    "pmi_stripes": f"{PMI} SELECT \"left\", string_agg(\"right\" || '=' || floor(pmi * 1e6 + 0.5)::BIGINT || '/' || n, ',' ORDER BY \"right\") AS stripe FROM pmi GROUP BY 1",
    "pmi_topk": f"{PMI}, ranked AS (SELECT \"left\", \"right\", round(pmi, 6) AS pmi, n, row_number() OVER (PARTITION BY \"left\" ORDER BY round(pmi, 9) DESC, \"right\")::INTEGER AS rank FROM pmi) SELECT * FROM ranked WHERE rank <= 3",
    "index_vocabulary": f"WITH {POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM posts GROUP BY term",
    "index_build": f"WITH {POSTINGS}, {_blocks(BLOCK)} SELECT term, block, df, string_agg(doc_id || ':' || tf, ' ' ORDER BY doc_id) AS postings FROM placed GROUP BY 1, 2, 3",
    "index_blocks": f"WITH {POSTINGS}, {_blocks(SMALL_BLOCK)} SELECT term, block, df, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM placed GROUP BY 1, 2, 3",
    "index_bytes": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM posts",
    "index_size": f"""WITH {POSTINGS}, {GAPS}, bytes AS (SELECT greatest(1, ceil(ln(gap + 1) / ln(128)))::BIGINT + greatest(1, ceil(ln(tf + 1) / ln(128)))::BIGINT AS b FROM gaps)
SELECT (SELECT count(DISTINCT term) FROM posts) AS terms, count(*) AS postings, sum(b)::BIGINT AS bytes FROM bytes""",
    "index_stored_lookup": f"WITH {POSTINGS} SELECT doc_id, tf FROM posts WHERE term = 'ledger'",
    "bool_stored": f"{HITS} SELECT doc_id FROM hits",
    "search_stored": f"{HITS} SELECT doc_id, to_json({{'docid': doc_id, 'text': text}})::VARCHAR AS hit FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)",
    "fetch_stored": f"{RARE_HITS} SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)",
    "index_gaps": f"WITH {POSTINGS}, {GAPS} SELECT term, block, gap, tf FROM gaps",
    "index_roundtrip": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM posts",
    "term_lookup": f"WITH {POSTINGS} SELECT doc_id, tf FROM posts WHERE term = 'ledger'",
    "bool_and": f"WITH {POSTINGS} SELECT doc_id FROM posts WHERE term = 'the' INTERSECT SELECT doc_id FROM posts WHERE term = 'of'",
    "bool_or": f"WITH {POSTINGS} SELECT DISTINCT doc_id FROM posts WHERE term IN ('ledger', 'harbour')",
    "bool_postfix": f"{HITS} SELECT doc_id FROM hits",
    "fetch_line": f"{HITS} SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)",
    "search_json": f"{HITS} SELECT doc_id, to_json({{'docid': doc_id, 'text': text}})::VARCHAR AS hit FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)",
    "graph_stats": f"WITH {NODES} SELECT count(*) AS num_nodes, coalesce(sum(len(adjacency)), 0)::BIGINT AS num_edges, count(*) FILTER (len(adjacency) > 0) AS num_active FROM nodes",
    "graph_edges": f"WITH {NODES} SELECT id AS src, unnest(adjacency) AS dst FROM nodes",
    "graph_partition_hash": f"WITH {NODES} SELECT id, (id % 10)::INTEGER AS part FROM nodes",
    "graph_counters": f"""WITH {NODES}, e AS (SELECT unnest(adjacency) AS dst FROM nodes) SELECT 'null_id' AS name, count(*) FILTER (nodeid IS NULL) AS n FROM graph_nodes
UNION ALL SELECT 'repeated_record', count(nodeid) - count(DISTINCT nodeid) FROM graph_nodes UNION ALL SELECT 'dangling', count(*) FILTER (len(adjacency) = 0) FROM nodes
UNION ALL SELECT 'missing_receiver', count(*) FROM e WHERE dst NOT IN (SELECT id FROM nodes)""",
    "log_added": "SELECT DISTINCT mass::DOUBLE AS mass, round(ln(exp(mass::DOUBLE) + exp(-1.5)), 9) AS added FROM mass_messages WHERE mass IS NOT NULL AND NOT isnan(mass)",
    "graph_partition": f"WITH {NODES} SELECT id, (floor(id / (SELECT count(*) FROM nodes) * 10) % 10)::INTEGER AS part FROM nodes",
    "ppr": _ppr("SELECT source, id, p FROM ppr"),
    "ppr_topk": _ppr(", ranked AS (SELECT source, id, p, row_number() OVER (PARTITION BY source ORDER BY p DESC, id)::INTEGER AS rank FROM ppr) SELECT * FROM ranked WHERE rank <= 10"),
    "sgd_train": f"{_trained()} {WEIGHTS}",
    "sgd_train_shuffled": f"{_trained(order="md5('17:' || doc_id)")} {WEIGHTS}",
    "sgd_train_ensemble": f"{_trained('doc_id % 3')} {WEIGHTS}",
    "spam_trained": f"""{_trained('doc_id % 3')}, f AS (SELECT doc_id, unnest(features) AS feature FROM inst), s AS (SELECT doc_id, sum(w) / 3 AS score FROM f JOIN trained t ON t.f = feature GROUP BY doc_id),
average AS (SELECT doc_id, y, round(coalesce(score, 0), 6) AS score FROM inst LEFT JOIN s USING (doc_id)), by_score AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM average GROUP BY score),
ranked AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)
SELECT round(100 * (1 - sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg))), 4) AS one_minus_roca FROM ranked""",
    "spam_score": f"{SCORES} SELECT doc_id, model_id, score, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS predicted FROM scores",
    "spam_ensemble_avg": f"{AVERAGE} SELECT * FROM average",
    "spam_ensemble_vote": f"{SCORES}, v AS (SELECT doc_id, sum(CASE WHEN score > 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS score FROM scores GROUP BY 1) SELECT doc_id, score, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS predicted FROM v",
    "spam_roca": f"""{AVERAGE}, by_score AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM average JOIN inst USING (doc_id) GROUP BY score),
ranked AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_score)
SELECT round(100 * (1 - sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg))), 6) AS one_minus_roca FROM ranked""",
    "p4_found": f"WITH {MESSAGES}, n AS (SELECT iteration, neighbor, count(*) AS n FROM msgs GROUP BY 1, 2) SELECT iteration, neighbor FROM n QUALIFY 100 * n >= sum(n) OVER (PARTITION BY iteration)",
    "p4_receivers": f"""WITH {MESSAGES}, n AS (SELECT iteration, neighbor, count(*) AS n, coalesce(ln(sum(exp(mass::DOUBLE)) FILTER (mass IS NOT NULL AND NOT isnan(mass) AND mass > '-inf'::FLOAT)), '-inf'::DOUBLE) AS log_mass,
count(DISTINCT mass) FILTER (NOT isnan(mass)) AS n_distinct FROM msgs GROUP BY 1, 2), w AS (SELECT iteration, neighbor, mass, count(*) AS w FROM msgs WHERE NOT isnan(mass) GROUP BY 1, 2, 3),
m AS (SELECT iteration, neighbor, mass::DOUBLE AS mode FROM w QUALIFY row_number() OVER (PARTITION BY iteration, neighbor ORDER BY w DESC, mass) = 1)
SELECT n.iteration, n.neighbor, n, round(log_mass, 6) AS log_mass, n_distinct, mode, n.neighbor IN (SELECT nodeid FROM graph_nodes WHERE nodeid IS NOT NULL) AS known FROM n LEFT JOIN m ON n.iteration IS NOT DISTINCT FROM m.iteration AND n.neighbor = m.neighbor""",
    "p4_percentiles": f"""WITH {MESSAGES}, r AS (SELECT iteration, neighbor, mass::DOUBLE AS mass, row_number() OVER w AS r, count(*) OVER (PARTITION BY iteration, neighbor) AS n FROM msgs
WHERE mass IS NOT NULL AND NOT isnan(mass) WINDOW w AS (PARTITION BY iteration, neighbor ORDER BY mass))
SELECT iteration, neighbor, min(mass) FILTER (100 * r >= 10 * n) AS p_10, min(mass) FILTER (100 * r >= 50 * n) AS p_50, min(mass) FILTER (100 * r >= 90 * n) AS p_90 FROM r GROUP BY 1, 2""",
}
