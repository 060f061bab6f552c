"""Who blocks whom, followed to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtwarden.session import written


def first_blockers(locks: DataFrame) -> DataFrame:
    """(trx, blocker): what each waiting transaction has waited for longest; the smaller number of two that began at once."""
    known = locks.where("waiting_trx IS NOT NULL AND granted_trx IS NOT NULL")
    first = F.min(F.struct(F.col("wait_started").isNull().alias("unknown"), "wait_started", "granted_trx"))
    return known.groupBy(F.col("waiting_trx").alias("trx")).agg(first["granted_trx"].alias("blocker"))


def _followed(edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Pointers (trx, at, steps, least) followed until they leave the waiting transactions, and those that never do.

    Each round doubles the steps: a pointer takes over the pointer of what it
    points at, and ``least`` becomes the smallest number on the way. What has
    arrived takes no further part. When as many steps are made as there are
    transactions left, what is left runs in circles.
    """
    live = written(edges.select("trx", F.col("blocker").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("trx").alias("least")), label)
    ended, steps, n = None, 1, live.count()
    while True:
        nxt = live.select(F.col("trx").alias("_t"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
        # an earlier round may have ended the way of what is pointed at
        done = ended.select(F.col("trx").alias("_t"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("least").alias("_least")) if ended is not None else None
        known = nxt if done is None else nxt.withColumn("_live", F.lit(True)).unionByName(done.withColumn("_live", F.lit(False)))
        if done is None:
            known = known.withColumn("_live", F.lit(True))
        far = written(live.join(known, F.col("at") == F.col("_t"), "left"), label)
        moved = far.select("trx", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.least("least", "_least").alias("least"), F.coalesce("_live", F.lit(False)).alias("_live"))
        arrived = moved.where("NOT _live").drop("_live")
        ended = arrived if ended is None else ended.unionByName(arrived)
        live = moved.where("_live").drop("_live")
        if live.isEmpty() or steps > n:
            return ended, live
        steps *= 2


def blocking_chains(locks: DataFrame) -> DataFrame:
    """Per waiting transaction its root blocker, the number of waits to it, and deadlocks: (trx, blocker, root_trx, depth, in_cycle, deadlocked).

    Every transaction waits for the one it has waited for longest. At the end
    of a chain stands one that waits for nothing; a chain that ends in a circle
    has the circle's smallest number as its root, is ``deadlocked``, and its
    depth counts the waits up to the circle. Members of the circle are
    ``in_cycle`` with depth 0. Rows without either number are left out. Chains
    of n waits take about log2(n) joins.
    """
    edges = written(first_blockers(locks), "blockers")
    ended, circling = _followed(edges, "chains")
    free = ended.select("trx", F.col("at").alias("root_trx"), F.col("steps").alias("depth"), F.lit(False).alias("in_cycle"), F.lit(False).alias("deadlocked"))
    # after as many steps as there are transactions every pointer lies on a circle, and each of its members is pointed at
    members = written(circling.select("at").distinct().join(circling.select(F.col("trx").alias("at"), "least"), "at").select(F.col("at").alias("trx"), F.col("least").alias("root_trx")), "circles")
    on_it = members.select("trx", "root_trx", F.lit(0).cast("long").alias("depth"), F.lit(True).alias("in_cycle"), F.lit(True).alias("deadlocked"))
    out = free.unionByName(on_it)
    behind = edges.join(circling.select("trx"), "trx", "left_semi").join(members.select("trx"), "trx", "left_anti")
    if not behind.isEmpty():
        led, _ = _followed(behind, "tails")
        roots = members.select(F.col("trx").alias("at"), "root_trx")
        out = out.unionByName(led.join(roots, "at").select("trx", "root_trx", F.col("steps").alias("depth"), F.lit(False).alias("in_cycle"), F.lit(True).alias("deadlocked")))
    return edges.join(out, "trx").select("trx", "blocker", "root_trx", "depth", "in_cycle", "deadlocked")
