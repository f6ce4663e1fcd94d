"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.staging import stage


def smallest_reached(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node (a number at a place) the smallest node that it reaches over links between places ``a`` and ``b``."""
    low, settled = nodes.copy(), len(a) == 0
    while not settled:
        before, least = low.copy(), np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        settled = bool((before == low).all())
    return low


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Each round hands the smallest neighbour on: large-star to the larger neighbours, small-star to
    the smaller ones; rounds grow with the logarithm of the longest path. Every round is a written
    table, so lineage stays short, and the minimum per node is combined before it is shuffled and
    written before it is joined, so that adaptive execution can split the join at a hub.
    Null ends, self links and repeated links are ignored; no links give an empty table.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    edges = stage(
        links.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(*pair(F.col(a), F.col(b))).distinct(), "links")
    mark = _fingerprint(edges)
    while mark[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stage(
            both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
            .distinct(), "large")
        least = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").where("lo <> m").select(*pair(F.col("lo"), F.col("m")))
        edges = stage(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        before, mark = mark, _fingerprint(edges)
        if mark == before:
            break
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.union(edges.select("lo", "lo").distinct())
