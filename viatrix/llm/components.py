"""Connected components by repeated minimum labels with pointer jumping."""

from pyspark.sql import DataFrame, functions as F

from viatrix.llm.store import Cuts


def components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, component) for every end of edges (a, b); component is the smallest node reachable.

    Each round takes, for every node, the smallest label among its neighbours (partial sums of
    minima before the shuffle, so a hub costs one row a task), hooks the node's present root to
    it, and halves the paths. The labels stay in written tables; only one count a round comes to
    the driver. No edges give an empty table.
    """
    both = cuts.cut(
        edges.where("a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = cuts.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        # a root learns the smallest label beside any node of its tree
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        seen = labels.join(near.select(F.col("a").alias("node"), "m"), "node").where("m < component")
        hooks = seen.groupBy(F.col("component").alias("node")).agg(F.min("m").alias("hook"))
        own = seen.select("node", F.col("m").alias("hook"))
        better = cuts.cut(hooks.unionByName(own).groupBy("node").agg(F.min("hook").alias("hook")))
        if better.isEmpty():
            cuts.drop(both, better)
            return labels
        hooked = labels.join(better, "node", "left").select("node", F.least("component", F.coalesce("hook", "component")).alias("component"))
        hooked = cuts.cut(hooked)
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = cuts.cut(hooked.join(up, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")))
        cuts.drop(better, labels, hooked)
        labels = jumped
