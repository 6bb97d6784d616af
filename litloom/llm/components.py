"""Connected components by alternating minimum labels over shared keys, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.runtime import cut


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, label``: label is the smallest id of the component.

    ``nodes`` has one column id; ``links`` has id and key: nodes with an equal
    key are connected, without any pair being formed.  Each round takes the
    minimum label per key and per node and then jumps to the label's own
    label, so that chains shorten by more than half; rounds end when no label
    changes.  Nodes without a key are their own component.
    """
    links = links.select("id", "key").distinct()
    # Keys of one node connect nothing: only nodes that share a key take part in the rounds.
    shared = links.groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2").select("key")
    links = cut(links.join(shared, "key"))
    state = links.select("id").distinct().select("id", F.col("id").alias("label"))
    whole = nodes.select("id").distinct()
    for _ in range(most_rounds):
        per_key = links.join(state, "id").groupBy("key").agg(F.min("label").alias("low"))
        per_node = links.join(per_key, "key").groupBy("id").agg(F.min("low").alias("low"))
        step = state.join(per_node, "id").select("id", "label", F.least("label", "low").alias("next"))
        roots = step.select(F.col("id").alias("next"), F.col("next").alias("up"))
        step = cut(step.join(roots, "next").select("id", "label", F.least("next", "up").alias("next")))
        state = step.select("id", F.col("next").alias("label"))
        if not step.filter("next <> label").limit(1).count():
            return whole.join(state, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
