"""Connected components of an edge list, by distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node long, root long) for every node of an edge, root being the smallest node of its component.

    Each round hooks every node to the least of its neighbourhood and contracts the edges to the hooked
    labels.  Rounds order nodes by id, which folds stars at once, except every third, which orders them by
    a hash of that round and so halves long chains.  Only the shrinking edge list is written between
    rounds; the labels are joined at the end.  Null ends and self loops are ignored; no edges, no rows.
    """
    e = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
    first = e = cut_lineage(e.where("u < v").distinct())
    maps, left = [], e.count()
    while left:
        if len(maps) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        seed = len(maps)
        if seed % 3 == 2:
            rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("n"))
            both = e.select("u", rank("v").alias("r")).union(e.select("v", rank("u")))
            low = both.groupBy("u").agg(F.min("r").alias("r"))
            hook = low.select("u", F.least("r", rank("u"))["n"].alias("p"))
        else:
            both = e.select("u", "v").union(e.select("v", "u"))
            hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = cut_lineage(hook)
        maps.append(hook)
        pu, pv = hook.toDF("u", "pu"), hook.toDF("v", "pv")
        step = e.join(pu, "u").join(pv, "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        last, e = e, cut_lineage(step.where("u < v").distinct())
        if last is not first:
            release(last)
        left = e.count()
    label = first.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("at", F.col("node"))
    for m in maps:
        label = label.join(m.toDF("at", "next"), "at", "left").select("node", F.coalesce("next", "at").alias("at"))
    label = cut_lineage(label)
    release(first, *maps, *([e] if e is not first else []))
    # Written first, so that the join may split the rows of a very large component.
    low = cut_lineage(label.groupBy("at").agg(F.min("node").alias("root")))
    return label.join(low, "at").select("node", "root")
