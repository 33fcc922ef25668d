"""Graphs as edge tables: components, degrees, layout. Rounds are cut off by tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in that of spark.checkpoint.dir, which all executors share.

    A local folder is made only where the setting is absent and Spark runs in one process; on a cluster, whose machines
    can't see each other's folders, its absence is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="foliant-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/foliant-{context.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that written() has made for this application; frames that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, where its lineage ends; zstd is for texts, which it makes much smaller."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable over edges in either direction.

    Large-star and small-star rounds until the edges stay as they are: about as many as the logarithm of the longest
    chain. Minima are pre-aggregated and neighbours never collected.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))

    def marked(e: DataFrame):
        e = written(e.where("a <> b").distinct(), "edges")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e, mark = marked(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    while mark[0]:
        two = both(e)
        least = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = two.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = written(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        e, now = marked(down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")))
        if now == mark:
            break
        mark = now
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def reachable(edges: DataFrame, start: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(start, node): what can be reached from each start, itself included, also where no edge touches it."""
    comps = written(components(edges, a, b), "components")
    own = start.join(comps, start[start.columns[0]] == comps["node"], "left").select(F.col(start.columns[0]).alias("start"), "root")
    hit = own.where("root IS NOT NULL").join(comps, "root").select("start", "node")
    return hit.union(own.where("root IS NULL").select("start", F.col("start").alias("node")))


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def circle(edges: DataFrame, by: str, size: float, a: str = "a", b: str = "b") -> DataFrame:
    """(by, node, degree, x, y): nodes of each graph on a circle by falling degree, rounded to six places."""
    deg = edges.select(by, F.explode(F.array(a, b)).alias("node")).groupBy(by, "node").agg(F.count(F.lit(1)).alias("degree"))
    w = Window.partitionBy(by)
    place = deg.withColumn("i", F.row_number().over(w.orderBy(F.desc("degree"), "node")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    angle = F.col("i") / F.col("n") * F.lit(2 * 3.141592653589793) - F.lit(3.141592653589793 / 2)
    at = lambda f: F.round(F.lit(size / 2) + F.lit(size / 2 - 44) * f(angle), 6)
    return place.select(by, "node", "degree", at(F.cos).alias("x"), at(F.sin).alias("y"))
