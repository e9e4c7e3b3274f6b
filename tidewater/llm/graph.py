"""Connected components over a table of links, and the written tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


# Spark's own switch: an execution removes its shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared checkpoint folder once and goes on from the files. The
    shuffle files of the write go when it has ended, as nothing reads them any more; the
    caller's setting is put back."""
    path = scratch_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.parquet(path)
    out.settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more: all that was made from them has been
    written in turn."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Union-find over links (a, b): returns (node, comp) with the smallest reachable node, for
    every node that has a link (or is in ``labels``, an earlier result to go on from). The
    result is a written table, and the only one that stays.

    Each round contracts the graph: links between different labels hook the larger label to
    the smallest one it touches, then pointers are halved until every label is a root."""
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    if labels is None:
        labels = nodes.distinct().select("node", F.col("node").alias("comp"))
    else:
        fresh = nodes.distinct().join(labels, "node", "left_anti")
        labels = labels.union(fresh.select("node", F.col("node").alias("comp")))
    labels = settle(labels, "labels")
    while True:
        ends = (links.join(labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a")
                .join(labels.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
                .where("ca <> cb"))
        hooks = settle(ends.select(F.greatest("ca", "cb").alias("hi"), F.least("ca", "cb").alias("lo"))
                       .groupBy("hi").agg(F.min("lo").alias("up")), "hooks")
        if hooks.isEmpty():
            discard(hooks)
            return labels
        while True:
            above = hooks.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            jumped = settle(hooks.join(above, "up", "left")
                            .select("hi", F.coalesce("top", "up").alias("up"),
                                    F.col("top").isNotNull().alias("moved")), "jumps")
            discard(hooks)
            hooks = jumped
            if jumped.where("moved").isEmpty():
                break
        new = settle(labels.join(hooks.select(F.col("hi").alias("comp"), "up"), "comp", "left")
                     .select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        discard(labels, hooks)
        labels = new
