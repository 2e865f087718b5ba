"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest
    node of the component.

    Contraction: every node points to the smallest of itself and its
    neighbours, then to where that one points; edges are redrawn between the
    nodes pointed to, and loops and repeats go. The edge table shrinks from round
    to round until it is empty; the pointers of all rounds, followed in turn, lead
    to the root. A node with very many edges is a pre-aggregated minimum and one
    side of a join that adaptive execution splits. Each round is written to the
    shared folder. Both sides of every join grow with the edges, so none is
    broadcast (a broadcast side lies whole in the driver; its size is guessed from
    compressed files).
    """
    links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialize(links.filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        lowest = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        onward = lowest.select(F.col("node").alias("to"), F.col("to").alias("next"))
        steps.append(materialize(lowest.join(onward.hint("merge"), "to").select("node", F.col("next").alias("to")), "pointers"))
        start = steps[-1].select(F.col("node").alias("a"), F.col("to").alias("ta"))
        end = steps[-1].select(F.col("node").alias("b"), F.col("to").alias("tb"))
        links = materialize(links.filter("a < b").join(start.hint("merge"), "a").join(end.hint("merge"), "b").filter("ta <> tb")
                            .select(F.explode(F.array(F.struct(F.col("ta").alias("a"), F.col("tb").alias("b")),
                                                      F.struct(F.col("tb").alias("a"), F.col("ta").alias("b")))).alias("e"))
                            .select("e.*").distinct(), "edges")
        if links.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    labels = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), "to")
        labels = labels.join(onward.hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(labels, "components")
