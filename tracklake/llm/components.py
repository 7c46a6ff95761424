"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.sources.shared import fresh_folder, shared_folder


def unused(df: DataFrame, name: str) -> str:
    """A name for an internal column that no column of the table has."""
    names = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in names:
        name = f"_{name}"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files that all executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: cuts the lineage, and later reads take single columns.

    Shuffle files behind the table go as soon as it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "table")
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's greater (large) or smaller and own (small) neighbours to its least neighbour.

    The least neighbour comes from a partial aggregate, so a node with very many links is
    not gathered in one task; the join back is one that Spark can split.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        joined = edges.join(least, "b")
        out = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).union(joined.select(F.col("m").alias("a"), "b"))
    return out.where("a < b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    Ends when a round changes nothing: the rounds grow with the logarithm of the longest
    path.  Null and equal ends are no links.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    edges = checkpoint(edges)
    state = None
    while True:
        edges = checkpoint(_star(_star(edges, True), False))
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return nodes.union(roots)
