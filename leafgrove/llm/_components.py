"""Connected components of a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is a few aggregations and joins on node ids, written to the shared folder; nothing is gathered on the driver
but a count and a checksum. A node with very many links is aggregated before the shuffle, and its join is checked or
salted, so a hub costs no single task its whole neighbourhood. What is left of at most AT_ONCE links is solved in one
task, with the same result: rounds over so few cost more than the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgrove.llm._shared import lookup, materialize


#: Links (16 bytes each) that one task may hold.
AT_ONCE = 200_000


def components(links: DataFrame) -> DataFrame:
    """node, component (least id that it reaches) for every node of a link (a, b); links with a null end or a = b count for nothing."""
    ends = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = materialize(links.where("a <> b").select(*ends).distinct(), "links")
    seen = None
    while (mark := _mark(edges)) != seen:
        if mark[0] <= AT_ONCE:
            return _at_once(edges)
        seen = mark
        edges = materialize(_small(materialize(_large(edges), "large")), "small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                up.setdefault(a, a), up.setdefault(b, b)
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])

    return materialize(edges.coalesce(1).mapInArrow(run, "node long, component long"), "components")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours link to the least of its neighbours and itself."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return lookup(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours link to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = lookup(edges, least, ["u"], "inner")
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
