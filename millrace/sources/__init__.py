"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column order of the pipe-delimited tables (name and type, as in the TPC-H layout).
TBL_SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date,"
    " o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey int, c_phone string,"
    " c_acctbal double, c_mktsegment string, c_comment string",
    "supplier": "s_suppkey long, s_name string, s_address string, s_nationkey int, s_phone string,"
    " s_acctbal double, s_comment string",
    "part": "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int,"
    " p_container string, p_retailprice double, p_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The Parquet table `table` of `folder`."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def read_tbl(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A pipe-delimited `.tbl` file with the fixed schema of `table`; a trailing pipe is ignored, bad fields are null."""
    return spark.read.csv(path, sep="|", schema=TBL_SCHEMAS[table], mode="PERMISSIVE")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (doc_id long, line string), one row per line, ids unique and ascending within a file.

    Ids come from the reading position (partition and line); pass a table with its own id where ids must be stable
    across layouts. Empty lines are kept.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("line"))


def document_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Split multi-line texts at LF into (doc_id, line_no, line).

    Null texts have no lines; an empty text is one empty line; a trailing LF opens a last, empty line.
    """
    return documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """Adjacency lists `id n1 n2 ...` as (id int, adjacency array<int>); nodes without neighbours keep an empty list."""
    return parse_adjacency(spark.read.text(path).select(F.col("value").alias("line")), "line")


def parse_adjacency(lines: DataFrame, line: str) -> DataFrame:
    """Parse `id n1 n2 ...` lines; blank or null lines give no node, fields that are no numbers are skipped."""
    fields = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda x: x != "")
    numbers = F.transform(fields, lambda x: x.try_cast("int"))
    return (
        lines.select(numbers.alias("f"))
        .where(F.get("f", F.lit(0)).isNotNull())
        .select(F.get("f", F.lit(0)).alias("id"), F.filter(F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), lambda x: x.isNotNull()).alias("adjacency"))
    )


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Labelled instances `docid label f1 f2 ...` as (doc_id string, y double, features array<int>)."""
    return parse_instances(spark.read.text(path).select(F.col("value").alias("line")), "line")


def parse_instances(lines: DataFrame, line: str) -> DataFrame:
    """Parse labelled instances; label `spam` gives y = 1, any other 0. Lines of fewer than two fields are left out."""
    f = F.split(F.trim(F.col(line)), " +")
    return (
        lines.select(f.alias("f"))
        .where(F.size("f") >= 2)
        .select(
            F.get("f", F.lit(0)).alias("doc_id"),
            F.when(F.get("f", F.lit(1)) == "spam", 1.0).otherwise(0.0).alias("y"),
            F.filter(F.transform(F.slice("f", 3, F.size("f")), lambda x: x.try_cast("int")), lambda x: x.isNotNull()).alias("features"),
        )
    )


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A text model, one `(feature,weight)` per line, as (feature int, weight double); other lines are left out."""
    part = lambda i: F.regexp_extract("value", r"^\(\s*(-?\d+)\s*,\s*([^)\s]+)\s*\)\s*$", i)
    return spark.read.text(path).select(part(1).try_cast("int").alias("feature"), part(2).try_cast("double").alias("weight")).where("feature is not null and weight is not null")


def write_model(model: DataFrame, path: str) -> None:
    """Write (feature, weight) as the text lines `read_model` reads, replacing `path`."""
    model.select(F.concat(F.lit("("), F.col("feature").cast("string"), F.lit(","), F.col("weight").cast("string"), F.lit(")"))).write.mode("overwrite").text(path)


def write_keyed(df: DataFrame, path: str, *key: str | Column) -> None:
    """Write a table for keyed lookup: range-partitioned and sorted by `key` (further ones spread a hot first), so that file and row-group statistics
    let a filter on the key read few row groups. Replaces `path`. A hot key may span several files."""
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").option("parquet.block.size", str(16 << 20)).parquet(path)


def write_text(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Write flat rows as delimited text, replacing `path`."""
    df.write.mode("overwrite").csv(path, sep=sep)
