"""The registered queries of the core operators. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.logmath import log_add
from millrace.functions.text import tokens
from millrace.operators import graph, index, learn, relational, skew
from millrace.operators import text as words
from millrace import sources
from millrace.session import scratch, spread, written
from millrace.sources import document_lines, load

DAY, CUT = "1996-11-01", "1998-01-01"
NATIONS = ["NATION_3", "NATION_24"]
QUERY = "the that OR of AND"
RARE_QUERY = "ledger harbour AND orchard OR"
PMI_THRESHOLD = 10
PPR_STEPS = 3
#: Postings in a block of the index of which the blocks are shown.
SMALL_BLOCK = 128


def _tables(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [load(spark, d, n) for n in names]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def q1(spark: SparkSession, d: str) -> DataFrame:
    return relational.shipdate_count(load(spark, d, "lineitem"), DAY)


def q2(spark: SparkSession, d: str) -> DataFrame:
    return relational.clerks(*_tables(spark, d, "lineitem", "orders"), DAY)


def q3(spark: SparkSession, d: str) -> DataFrame:
    return relational.parts_and_suppliers(*_tables(spark, d, "lineitem", "part", "supplier"), DAY)


def q4(spark: SparkSession, d: str) -> DataFrame:
    return relational.shipped_to_nations(*_tables(spark, d, "lineitem", "orders", "customer", "nation"), DAY)


def q5(spark: SparkSession, d: str) -> DataFrame:
    return relational.monthly_by_nation(*_tables(spark, d, "lineitem", "orders", "customer", "nation"), NATIONS)


def q6(spark: SparkSession, d: str) -> DataFrame:
    df = relational.pricing_summary(load(spark, d, "lineitem"), DAY)
    return _rounded(df, 6, *[c for c in df.columns if c.startswith(("sum_", "avg_"))])


def q7(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(relational.shipping_priority(*_tables(spark, d, "customer", "orders", "lineitem"), CUT), 4, "revenue")


def q5_any_case(spark: SparkSession, d: str) -> DataFrame:
    return relational.monthly_by_nation(*_tables(spark, d, "lineitem", "orders", "customer", "nation"), ["nation_3", "Nation_24"], any_case=True)


def q7_left(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(relational.shipping_priority(*_tables(spark, d, "customer", "orders", "lineitem"), CUT, unknown=True), 4, "revenue")


def source_tbl(spark: SparkSession, d: str) -> DataFrame:
    """The pricing summary over line items read from a pipe-delimited file, which is written first."""
    path, names = f"{scratch(spark)}/lineitem.tbl", [f.split()[0] for f in sources.TBL_SCHEMAS["lineitem"].split(",")]
    items = load(spark, d, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    sources.write_text(items.select(*[F.col(n) if n in items.columns else F.lit(None).cast("string").alias(n) for n in names]), path, "|")
    df = relational.pricing_summary(sources.read_tbl(spark, path, "lineitem"), DAY)
    return _rounded(df, 6, *[c for c in df.columns if c.startswith(("sum_", "avg_"))])


def source_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """The graph's nodes read from lines of adjacency, which are written first."""
    path = f"{scratch(spark)}/graph.txt"
    _nodes(spark, d).select(F.concat_ws(" ", F.col("id").cast("string"), F.transform("adjacency", lambda x: x.cast("string")))).write.text(path)
    return sources.read_adjacency(spark, path).select("id", F.concat_ws(" ", F.transform("adjacency", lambda x: x.cast("string"))).alias("adjacency"))


def source_instances(spark: SparkSession, d: str) -> DataFrame:
    """The labelled instances read from lines, which are written first."""
    path, label = f"{scratch(spark)}/instances.txt", F.when(F.col("y") > 0, "spam").otherwise("ham")
    _instances(spark, d).select(F.concat_ws(" ", F.col("doc_id").cast("string"), label, F.transform("features", lambda x: x.cast("string")))).write.text(path)
    return sources.read_instances(spark, path).select("doc_id", "y", F.size("features").cast("bigint").alias("n"), F.md5(F.concat_ws(" ", F.transform("features", lambda x: x.cast("string"))).cast("binary")).alias("digest"))


def source_model(spark: SparkSession, d: str) -> DataFrame:
    """A model read from lines, which are written first."""
    path = f"{scratch(spark)}/model"
    sources.write_model(_fixed_model(spark).where("model_id = 0"), path)
    return sources.read_model(spark, path)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(_texts(spark, d))


def tok_count(spark: SparkSession, d: str) -> DataFrame:
    return words.token_counts(_lines(spark, d), ["doc_id", "line_no"], "line")


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return words.word_count(_lines(spark, d), "line")


def top_words(spark: SparkSession, d: str) -> DataFrame:
    return words.top_words(word_count(spark, d), 20)


def word_lookup(spark: SparkSession, d: str) -> DataFrame:
    return words.lookup(word_count(spark, d), "ledger")


def follower_count(spark: SparkSession, d: str) -> DataFrame:
    return words.follower_count(_lines(spark, d), "line", "the")


def line_df(spark: SparkSession, d: str) -> DataFrame:
    return words.line_frequency(_lines(spark, d), "line")


def bigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(words.bigram_pairs(_lines(spark, d), "line"), 9, "value")


def _printed(stripe: str, value: Callable) -> F.Column:
    return F.concat_ws(",", F.transform(F.map_entries(stripe), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))))


def _millionths(x: F.Column) -> F.Column:
    """x in whole millionths, halves up: engines disagree on the last digit of printed decimals."""
    return F.floor(x * 1e6 + 0.5).cast("string")


def bigram_stripes(spark: SparkSession, d: str) -> DataFrame:
    printed = _printed("stripe", _millionths)
    return words.bigram_stripes(_lines(spark, d), "line").select("left", printed.alias("stripe"))


def _pmi(spark: SparkSession, d: str) -> DataFrame:
    return words.pmi_pairs(_lines(spark, d), "line", threshold=PMI_THRESHOLD)


def pmi_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_pmi(spark, d), 6, "pmi")


def pmi_stripes(spark: SparkSession, d: str) -> DataFrame:
    return words.pmi_stripes(_pmi(spark, d)).select("left", _printed("stripe", lambda v: F.concat(_millionths(v["pmi"]), F.lit("/"), v["n"].cast("string"))).alias("stripe"))


def pmi_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(words.pmi_top(_pmi(spark, d), 3), 6, "pmi")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_texts(spark, d), "doc_id", "text")


def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.vocabulary(_postings(spark, d))


def index_build(spark: SparkSession, d: str) -> DataFrame:
    printed = F.concat_ws(" ", F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))))
    return index.build_index(_postings(spark, d)).select("term", "block", "df", printed.alias("postings"))


def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    return index.encode_gaps(index.build_index(_postings(spark, d))).select("term", "block", F.inline("gaps"))


def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return index.decode_gaps(index.encode_gaps(index.build_index(_postings(spark, d))))


def index_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of an index of small ones, by their first and last document."""
    built = index.build_index(_postings(spark, d), SMALL_BLOCK)
    return built.select("term", "block", "df", F.size("postings").cast("bigint").alias("n"), F.array_min("postings.doc_id").alias("first"), F.array_max("postings.doc_id").alias("last"))


def index_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The postings back from their bytes."""
    gaps = index.encode_gaps(index.build_index(_postings(spark, d), SMALL_BLOCK))
    return index.decode_gaps(index.decode_bytes(index.encode_bytes(gaps)))


def index_size(spark: SparkSession, d: str) -> DataFrame:
    """Terms, postings, and bytes of the lists of the whole index."""
    stored = index.encode_bytes(index.encode_gaps(index.build_index(_postings(spark, d))))
    first = F.col("block") == 0
    return stored.agg(F.count(F.when(first, 1)).alias("terms"), F.sum(F.when(first, F.col("df"))).alias("postings"), F.sum(F.octet_length("bytes").cast("bigint")).alias("bytes"))


#: Where the index and the collection of a folder were stored, by application and folder.
_stored: dict[tuple[str, str], str] = {}


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored index and collection of the documents, built by the first query that needs them."""
    key = spark.sparkContext.applicationId, d
    if key not in _stored:
        path = scratch(spark)
        index.write_index(index.build_index(_postings(spark, d)), f"{path}/index")
        index.write_collection(load(spark, d, "documents").where("doc_id is not null"), f"{path}/collection", "doc_id", "text")
        _stored[key] = path
    return spark.read.parquet(f"{_stored[key]}/index"), spark.read.parquet(f"{_stored[key]}/collection")


def index_stored_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.lookup_term(_store(spark, d)[0], "ledger")


def bool_stored(spark: SparkSession, d: str) -> DataFrame:
    return index.boolean_search(index.postings_of(_store(spark, d)[0], QUERY), QUERY)


def search_stored(spark: SparkSession, d: str) -> DataFrame:
    return index.as_json(index.search_stored(*_store(spark, d), QUERY, None))


def fetch_stored(spark: SparkSession, d: str) -> DataFrame:
    return index.search_stored(*_store(spark, d), RARE_QUERY)


def bool_and(spark: SparkSession, d: str) -> DataFrame:
    p = _postings(spark, d)
    return index.intersect(p.where("term = 'the'"), p.where("term = 'of'"))


def bool_or(spark: SparkSession, d: str) -> DataFrame:
    p = _postings(spark, d)
    return index.unite(p.where("term = 'ledger'"), p.where("term = 'harbour'"))


def bool_postfix(spark: SparkSession, d: str) -> DataFrame:
    return index.boolean_search(_postings(spark, d), QUERY)


def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.lookup_term(index.build_index(_postings(spark, d)), "ledger")


def fetch_line(spark: SparkSession, d: str) -> DataFrame:
    return index.fetch(bool_postfix(spark, d), load(spark, d, "documents"), "doc_id", "text")


def search_json(spark: SparkSession, d: str) -> DataFrame:
    return index.search_json(_postings(spark, d), load(spark, d, "documents"), QUERY, "doc_id", "text")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.latest_nodes(load(spark, d, "graph_nodes"))


def _sources(spark: SparkSession, d: str) -> list[int]:
    """The named source nodes: a table of fixed size."""
    return [r[0] for r in load(spark, d, "source_nodes").where("is_source").select("nodeid").distinct().orderBy("nodeid").collect()]


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(_nodes(spark, d))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_nodes(spark, d))


def graph_partition_hash(spark: SparkSession, d: str) -> DataFrame:
    return graph.hash_partition(_nodes(spark, d), 10)


def graph_counters(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_counters(load(spark, d, "graph_nodes"), _nodes(spark, d))


def log_added(spark: SparkSession, d: str) -> DataFrame:
    """Each different mass added to a fixed one, both as logarithms."""
    mass = load(spark, d, "mass_messages").select(F.col("mass").cast("double").alias("mass")).where("mass is not null and not isnan(mass)").distinct()
    return mass.select("mass", F.round(log_add(F.col("mass"), F.lit(-1.5)), 9).alias("added"))


def graph_partition(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return graph.range_partition(nodes, nodes.count(), 10)


def _ppr(spark: SparkSession, d: str) -> DataFrame:
    sources = _sources(spark, d)
    return graph.by_source(graph.personalized_pagerank(_nodes(spark, d), sources, PPR_STEPS), sources)


def ppr(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ppr(spark, d), 12, "p")


def ppr_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_nodes(_rounded(_ppr(spark, d), 12, "p"), 10)


def _instances(spark: SparkSession, d: str) -> DataFrame:
    """Mails against all other texts; a token's feature is the first 16 bits of its md5."""
    features = F.transform(tokens("text"), lambda t: F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"))
    docs = spread(load(spark, d, "documents").select("doc_id", "source", "text"))
    return docs.select("doc_id", F.when(F.col("source").startswith("mail_"), 1.0).otherwise(0.0).alias("y"), features.alias("features"))


def _fixed_model(spark: SparkSession) -> DataFrame:
    """Three models of whole-number weights by formula; a third of the features is unknown to them."""
    model = spark.range(65536).where("id % 3 <> 0").select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("model_id"), F.col("id").cast("int").alias("feature"))
    return model.withColumn("weight", ((F.col("feature") * (2 * F.col("model_id") + 7)) % 201 - 100).cast("double"))


def sgd_train(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(learn.sgd_train(_instances(spark, d), ["doc_id"]), 9, "weight")


def sgd_train_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(learn.sgd_train(learn.shuffled(_instances(spark, d), 17), ["ord", "doc_id"]), 9, "weight")


def sgd_train_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_ensemble(spark, d), 9, "weight")


def _ensemble(spark: SparkSession, d: str) -> DataFrame:
    return learn.sgd_train(_instances(spark, d).withColumn("shard", F.pmod("doc_id", F.lit(3))), ["doc_id"], "shard")


def spam_trained(spark: SparkSession, d: str) -> DataFrame:
    """The whole way: an ensemble trained on three shards, its average over all documents, and its area under the curve."""
    scored = learn.ensemble_average(learn.score(_instances(spark, d), written(_ensemble(spark, d))))
    return _rounded(learn.one_minus_roca(scored.withColumn("score", F.round("score", 6)).join(_instances(spark, d).select("doc_id", "y"), "doc_id")), 4, "one_minus_roca")


def spam_score(spark: SparkSession, d: str) -> DataFrame:
    return learn.score(_instances(spark, d), _fixed_model(spark))


def spam_ensemble_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(learn.ensemble_average(spam_score(spark, d)), 6, "score")


def spam_ensemble_vote(spark: SparkSession, d: str) -> DataFrame:
    return learn.ensemble_vote(spam_score(spark, d))


def spam_roca(spark: SparkSession, d: str) -> DataFrame:
    y = load(spark, d, "documents").select("doc_id", F.when(F.col("source").startswith("mail_"), 1).otherwise(0).alias("y"))
    return _rounded(learn.one_minus_roca(learn.ensemble_average(spam_score(spark, d)).withColumn("score", F.round("score", 6)).join(y, "doc_id")), 6, "one_minus_roca")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return skew.once(load(spark, d, "mass_messages"), "msg_id", "iteration", "neighbor", "mass").where("neighbor is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(_messages(spark, d), ["iteration"], ["neighbor"], "mass").select("iteration", "neighbor")


def p4_receivers(spark: SparkSession, d: str) -> DataFrame:
    """Per iteration and receiver: messages, log of the summed mass, different masses, most frequent mass, and whether
    the receiver has a node record."""
    nodes = load(spark, d, "graph_nodes").select(F.col("nodeid").alias("neighbor"), F.lit(True).alias("known")).where("neighbor is not null").distinct()
    summary = skew.group_summary(_messages(spark, d), ["iteration", "neighbor"], "mass")
    return summary.join(nodes, "neighbor", "left").select("iteration", "neighbor", "n", F.round("log_sum", 6).alias("log_mass"), "n_distinct", F.col("mode").cast("double").alias("mode"), F.coalesce("known", F.lit(False)).alias("known"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per iteration and receiver: the mass that a tenth, half, and nine tenths of its messages do not exceed."""
    keys = ["iteration", "neighbor"]
    found = skew.percentiles(skew.weighted_values(_messages(spark, d), keys, "mass"), keys, "mass", [10, 50, 90])
    return found.select(*keys, *[F.col(f"p_{p}").cast("double").alias(f"p_{p}") for p in (10, 50, 90)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q1_shipdate_count": q1,
    "q2_clerk_topk": q2,
    "q3_part_supplier_topk": q3,
    "q4_nation_count": q4,
    "q5_nation_month": q5,
    "q6_pricing_summary": q6,
    "q7_shipping_priority": q7,
} | {
    f.__name__: f
    for f in (
        q5_any_case, q7_left, source_tbl, source_adjacency, source_instances, source_model,
        tok_count, word_count, top_words, word_lookup, follower_count, line_df, bigram_pairs, bigram_stripes, pmi_pairs, pmi_stripes, pmi_topk,
        index_vocabulary, index_build, index_gaps, index_roundtrip, term_lookup, bool_and, bool_or, bool_postfix, fetch_line, search_json,
        index_blocks, index_bytes, index_size, index_stored_lookup, bool_stored, search_stored, fetch_stored,
        graph_stats, graph_edges, graph_partition, graph_partition_hash, graph_counters, log_added, ppr, ppr_topk,
        sgd_train, sgd_train_shuffled, sgd_train_ensemble, spam_score, spam_ensemble_avg, spam_ensemble_vote, spam_roca, spam_trained,
        p4_found, p4_receivers, p4_percentiles,
    )
}
