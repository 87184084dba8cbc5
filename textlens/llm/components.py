"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b); label is the smallest node of its component.

    Each round every node takes the smallest label among its neighbours', then the label of its label. Rounds go on until
    none changes. All sums are grouped minima, which combine before the shuffle, so a node with very many links is no
    hot spot; every round is stored.
    """
    ends = links.select("a", "b")
    edges = stored(ends.union(ends.select("b", "a")).toDF("node", "other").filter("node <> other").distinct(), "edges")
    state = stored(edges.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        seen = edges.join(state.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = state.join(seen, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = state.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = nearer.join(jump, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old"))
        state = stored(after, "labels")
        if state.filter("label <> old").isEmpty():
            return state.select("node", "label")
        state = state.select("node", "label")
