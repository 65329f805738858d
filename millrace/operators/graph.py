"""Personalized PageRank for several sources at once.

Nodes are rows (id, adjacency). Neighbours may repeat (each mention gets a share) and may lack a node record (their
mass is lost and comes back through the jump). Null ids are left out, null adjacency means no neighbours, null
neighbours are dropped. Mass is kept as one double column per source beside the structure, so that an iteration is one
aggregation by neighbour and one join, and hubs are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.session import discard, written

ALPHA = 0.15
#: Neighbours in a row of the structure.
LIST = 1 << 14


def latest_nodes(records: DataFrame, node_id: str = "nodeid", adjacency: str = "adjacency", loaded_at: str = "loaded_at") -> DataFrame:
    """(id, adjacency): one row per node - of several records the latest loaded, then the longest, then by content."""
    clean = records.where(F.col(node_id).isNotNull()).select(
        F.col(node_id).alias("id"), F.filter(F.coalesce(F.col(adjacency), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("adjacency"), F.col(loaded_at).alias("at")
    )
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last("at"), F.desc(F.size("adjacency")), "adjacency"))
    return clean.withColumn("r", rank).where("r = 1").select("id", "adjacency")


def graph_stats(nodes: DataFrame) -> DataFrame:
    """(num_nodes, num_edges, num_active): records, listed neighbours, nodes with at least one."""
    degree = F.size("adjacency").cast("bigint")
    return nodes.agg(F.count("*").alias("num_nodes"), F.coalesce(F.sum(degree), F.lit(0)).alias("num_edges"), F.count(F.when(degree > 0, 1)).alias("num_active"))


def graph_counters(records: DataFrame, nodes: DataFrame, node_id: str = "nodeid") -> DataFrame:
    """(name, n): records of no id, further records of a node, nodes without neighbours, and messages that a step sends
    to nodes without a record, whose mass is lost. Hubs are counted before the join, so no receiver is one task's."""
    of_id = records.groupBy(node_id).agg(F.count("*").alias("n"))
    to = edges(nodes).groupBy("dst").agg(F.count("*").alias("n"))
    lost = to.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = lambda df, name: df.select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n"))
    null = of_id.where(F.col(node_id).isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    again = of_id.where(F.col(node_id).isNotNull()).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    dangling = nodes.where(F.size("adjacency") == 0).agg(F.count("*").alias("n"))
    return total(null, "null_id").unionByName(total(again, "repeated_record")).unionByName(total(dangling, "dangling")).unionByName(total(lost, "missing_receiver"))


def edges(nodes: DataFrame) -> DataFrame:
    """(src, dst): one row per listed neighbour."""
    return nodes.select(F.col("id").alias("src"), F.explode("adjacency").alias("dst"))


def partition_nodes(nodes: DataFrame, partitions: int, by_range: bool = False) -> DataFrame:
    """Nodes laid out over `partitions` partitions, by hash or by id range."""
    return nodes.repartitionByRange(partitions, "id") if by_range else nodes.repartition(partitions, "id")


def hash_partition(nodes: DataFrame, partitions: int) -> DataFrame:
    """(id, part): the partition number of an id's hash, which is the id itself."""
    return nodes.select("id", F.pmod("id", F.lit(partitions)).cast("int").alias("part"))


def range_partition(nodes: DataFrame, node_count: int, partitions: int) -> DataFrame:
    """(id, part): the partition number id / node_count * partitions, rounded down, modulo partitions."""
    return nodes.select("id", (F.floor(F.col("id") / F.lit(float(node_count)) * partitions) % partitions).cast("int").alias("part"))


def personalized_pagerank(nodes: DataFrame, sources: list[int], iterations: int, alpha: float = ALPHA) -> DataFrame:
    """(id, p_0 ... p_k): probability of each node for each source after `iterations` steps.

    `sources` is a short list (a column each). A node starts with 1 for its own source, else 0. A step spreads each
    node's mass evenly over its neighbours; what does not arrive (dangling nodes, missing records) goes back to the
    source together with the jump. The step's totals are one row of k sums, read by the driver. Each step's state is
    written to the shared folder, which cuts the lineage, and the one before is deleted; the structure is laid out by id
    once and kept (in memory and on disk), so that no step shuffles adjacency lists, only mass. Long lists lie in rows
    of `LIST` neighbours.
    """
    names = [f"p_{i}" for i in range(len(sources))]
    own = lambda s: f"CASE WHEN id = {int(s)} THEN 1.0D ELSE 0.0D END"
    start = lambda ids: ids.selectExpr("id", *[f"{own(s)} AS {p}" for s, p in zip(sources, names, strict=True)])
    if iterations < 1:
        return start(nodes)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size("adjacency") - 1, F.lit(0)), F.lit(LIST)), lambda i: F.struct((i == 0).alias("first"), F.slice("adjacency", i + 1, LIST).alias("listed")))
    structure = written(nodes.select("id", F.size("adjacency").alias("degree"), F.inline(pieces))).repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    structure.count()  # the layout is known to later plans only once it is there
    ids = structure.where("first").select("id")
    mass, before = start(ids), None
    for _ in range(iterations):
        sent = structure.join(mass, "id").selectExpr("explode(listed) AS id", *[f"{p} / degree AS {p}" for p in names])
        received = sent.groupBy("id").agg(*[F.expr(f"sum({p}) AS {p}") for p in names])
        arrived = written(ids.join(received, "id", "left").selectExpr("id", *[f"coalesce({p}, 0.0D) AS {p}" for p in names]))
        totals = arrived.selectExpr(*[f"coalesce(sum({p}), 0.0D) AS {p}" for p in names]).first()
        lost = {p: max(0.0, 1.0 - totals[p]) for p in names}
        mass = arrived.selectExpr(
            "id", *[f"{1 - alpha!r}D * ({p} + CASE WHEN id = {int(s)} THEN {lost[p]!r}D ELSE 0.0D END) + CASE WHEN id = {int(s)} THEN {alpha!r}D ELSE 0.0D END AS {p}" for s, p in zip(sources, names, strict=True)]
        )
        if before is not None:
            discard(before)
        before = arrived
    structure.unpersist()
    return mass


def by_source(mass: DataFrame, sources: list[int]) -> DataFrame:
    """(source, id, p): the wide mass table with a row per source and node."""
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"p_{i}").alias("p")) for i, s in enumerate(sources)])
    return mass.select("id", F.inline(rows)).select("source", "id", "p")


def top_nodes(scores: DataFrame, k: int) -> DataFrame:
    """(source, id, p, rank): the k nodes of highest p for each source, ties by id; fewer where there are fewer."""
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("p"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
