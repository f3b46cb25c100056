"""Connected components of a link table, by pointer doubling and contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Up to so many links (16 bytes each) are labelled in the driver.
LOCAL = 200_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links u-v, in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        if (low == high).all():
            return nodes, nodes[up]
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def components(links: DataFrame, a: str = "a", b: str = "b", *, rounds: list[int] | None = None, local: int = LOCAL) -> DataFrame:
    """(node, label) for each node of a link; label: the smallest node reachable.

    In each round every node that has a smaller neighbour points to its smallest one. These
    pointers form trees; they are doubled until all point to the roots of their trees, in as many
    steps as the logarithm of the deepest tree, and the links are contracted to the roots. A link
    whose ends meet is dropped; the rounds end when no link is left. All tables stay distributed;
    a node that very many others point to is left to the splitting of skewed joins. Links to
    itself and repeated links change nothing; null ends are dropped; no links: no rows. `rounds`,
    if given, receives the doubling steps of each round.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = links.where(x.isNotNull() & y.isNotNull()).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    if rounds is None:
        links = given = written(links, "given")
        if given.count() <= local:
            t = given.toArrow()
            found = smallest_reachable(t["u"].to_numpy(), t["v"].to_numpy())
            dropped(given)
            return written(links.sparkSession.createDataFrame(pa.table(found, names=["node", "label"]), "node bigint, label bigint"), "nodes")
    nodes = written(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")), "nodes")
    links = written(links.where("u <> v").distinct(), "links")
    while not links.isEmpty():
        up, steps = written(links.groupBy("u").agg(F.min("v").alias("p")), "parents"), 0
        while True:
            on = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            further = written(up.select("u", "p").join(on, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
            dropped(up)
            up, steps = further, steps + 1
            if up.where("moved").isEmpty():
                break
        if rounds is not None:
            rounds.append(steps)
        above = lambda c: up.select(F.col("u").alias(c), F.col("p").alias(f"{c}_up"))
        moved = links.join(above("u"), "u").join(above("v"), "v", "left")
        t = F.coalesce("v_up", "v")
        old, links = [up, links, nodes], written(moved.select(F.greatest("u_up", t).alias("u"), F.least("u_up", t).alias("v")).where("u <> v").distinct(), "links")
        nodes = written(nodes.join(above("label"), "label", "left").select("node", F.coalesce("label_up", "label").alias("label")), "nodes")
        dropped(*old)
    dropped(links, *([given] if rounds is None else []))
    return nodes
