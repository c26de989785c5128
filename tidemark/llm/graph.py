"""Connected components by contraction, and joins whose hot keys are dealt over many tasks.

A round takes each node to the best of itself and its neighbours, renames the ends of all edges so, and keeps distinct
edges between different nodes; what is left shrinks until nothing is. Even rounds prefer the smallest node, which
folds stars about small nodes at once; odd rounds prefer by a hash of their own, which halves chains in
expectation. The largest node of a component never survives a round, so every graph ends. Then the rounds' maps
are chained from the last to the first. Nothing but whether edges are left reaches the driver.

Each round is a table in the shared folder, of which Spark knows the size: the estimates that a checkpoint carries on
multiply with every join. It has as many files as its edges need, however many partitions a shuffle has. The tables go
when the last map is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import Tables, cut

#: Rows of one key on the large side of a join that one task takes; more are dealt out, see ``spread_join``.
HOT = 200_000


#: Rows of one file of a round's table.
FILE_ROWS = 500_000


def heavy_keys(counts: DataFrame, key: str, n: str, most: int = HOT) -> DataFrame:
    """key, tasks: keys with over ``most`` rows, of a materialised table of counts. There are at most rows / most of them."""
    return counts.filter(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("__tasks"))


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """left joined with right, which has a row per key. Rows of a heavy key are dealt by a hash of the whole row over
    its tasks, and right's row is copied to each; ``heavy`` is broadcast, bounded by left's rows / ``HOT``."""
    if heavy.isEmpty():
        return left.join(right, key, how)
    small = F.broadcast(heavy)
    tasks = F.coalesce("__tasks", F.lit(1))
    dealt = left.join(small, key, "left").withColumn("__task", F.pmod(F.xxhash64(*left.columns), tasks).cast("int")).drop("__tasks")
    copied = right.join(small, key, "left").withColumn("__task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("__tasks")
    return dealt.join(copied, [key, "__task"], how).drop("__task")


def _apart(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(edges: DataFrame, most: int = HOT) -> DataFrame:
    """node, root (long): for each end of edges (a, b) one node of its component, the same for all of it."""
    kept = Tables(edges.sparkSession)
    few = lambda df, rows: df.coalesce(-(-rows // FILE_ROWS))
    left, maps = kept.table(_apart(edges)), []
    while n := left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, r=len(maps): F.struct((F.xxhash64(c, F.lit(r)) if r % 2 else F.col(c)).alias("r"), F.col(c).alias("id"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"), F.count("*").alias("degree"))
        step = kept.table(few(best.select(F.col("a").alias("node"), F.least(rank("a"), "best")["id"].alias("to"), "degree"), n))
        heavy, to = heavy_keys(step, "node", "degree", most), step.select("node", "to")
        for end, other in (("a", "b"), ("b", "a")):
            left = spread_join(left.withColumnRenamed(end, "node"), to, "node", heavy).select(F.col("to").alias(end), other)
        left = kept.table(few(_apart(left), n))
        maps.append((to, n))
    out = maps.pop()[0].withColumnRenamed("to", "root") if maps else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while maps:
        own, n = maps.pop()
        own = own.withColumnsRenamed({"node": "first", "to": "node"})
        count = kept.table(few(own.groupBy("node").agg(F.count("*").alias("n")), n))
        out = spread_join(own, out, "node", heavy_keys(count, "node", "n", most), "left").select(F.col("first").alias("node"), F.coalesce("root", "node").alias("root"))
        out = kept.table(few(out, n))
    out = cut(out)
    kept.drop()
    return out


def least_of(rooted: DataFrame, value: str, most: int = HOT) -> DataFrame:
    """rooted with ``least``: the smallest ``value`` of the rows of its root."""
    by_root = rooted.groupBy("root").agg(F.min(value).alias("least"), F.count("*").alias("n"))
    by_root = cut(by_root)
    return spread_join(rooted, by_root.select("root", "least"), "root", heavy_keys(by_root, "root", "n", most))


def components(edges: DataFrame, most: int = HOT) -> DataFrame:
    """node, label: for each end of edges (a, b) the smallest node that it reaches."""
    return least_of(roots(edges, most), "node", most).select("node", F.col("least").alias("label"))
