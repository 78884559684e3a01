"""Connected components of an edge table, distributed: labels spread to neighbours, then jump through their own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillset.llm.common import hot_keys, look_up, materialize, release


#: Rows that one task takes in its stride; no key of so few is a burden.
FEW = 1_000_000


def _hot(rows: DataFrame, key: str) -> DataFrame | None:
    if rows.count() <= FEW:
        return None
    found = materialize(hot_keys(rows, key), "hot-keys")
    if found.limit(1).count():
        return found
    release(found)
    return None


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge names. Null ends form no edge.

    A round takes the least label among neighbours (summed up before the shuffle, so a node of very many neighbours is one
    row of each task) and then the label's own label, which halves the rest of a long chain. Nodes of very many neighbours,
    and labels of very many nodes, are few; they meet their rows by a broadcast, so no task holds a hub's edges. Each round's
    labels are written to the shared folder, in place of the last one's; the driver sees one count a round. A round without
    an end lowers a label, so there is an end.
    """
    one = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    both = materialize(one.union(one.select("b", "a")).distinct(), "edges")
    hubs = _hot(both, "a")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        said = look_up(both, "a", labels.select("node", "component"), "node", hubs)
        heard = said.groupBy("b").agg(F.min("component").alias("heard"))
        near = materialize(labels.join(heard, F.col("node") == F.col("b")).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("near")), "near")
        roots = _hot(near, "near")
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        new = look_up(near, "near", jump, "at", roots).select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("old")).alias("moved"))
        last, labels = labels, materialize(new, "labels")
        release(last, near, *([roots] if roots is not None else []))
    release(both, *([hubs] if hubs is not None else []))
    return labels.select("node", "component")
