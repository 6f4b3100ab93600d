"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Exactly equal vectors are counted once with their number. Spherical k-means, fitted on a bounded sample, gives every
vector a home cell. A vector within the threshold of x can lie in another cell only if x is near the plane between the
two centroids, and if x's angle to that centroid is, but for the threshold's angle, one that the cell's own vectors
have; only those cells x visits, and with this no link is lost. Cells are gathered in groups, by a k-means of their
centroids, so that a vector is sent once for each group and not once for each cell. Groups are worked on in parts, one
after another, so that copies of vectors on disk are bounded by their number. In each group, blocks of home vectors
are multiplied with the vectors that visit their cell. A block yields counts and a spanning forest of its links, never
pairs. Linked vectors form groups, of which the least id is kept.

Null vectors, zero vectors and those with null or non-finite components link with nothing and are kept. Vectors of
another length are compared among each other. Repeated rows are copies of each other. Ties do not matter. An empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm._components import components
from leafgrove.llm._shared import lookup, materialize, read, scratch, slices

THRESHOLD = 0.95
#: Vectors a cell, and a group of cells, on average; cells at most (beyond it cells and groups grow and are compared in
#: blocks); k-means is fitted on about so many vectors a cell.
CELL, GROUP, CELLS, SAMPLE = 48, 4_000, 1_024, 8
#: Home vectors, and visiting ones, in a block.
BLOCK, VISITORS = 4_096, 32_768
#: Rows of vectors that a part of the groups may write and send where there are fewer vectors; vectors that parts are sized by.
ROWS, SIZED = 2_000_000, 20_000
#: Single-precision cosines this much below the threshold are looked at again in double precision.
SLACK = 1e-4


def fit(sample: np.ndarray, cells: int, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors."""
    centroids = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Cells:
    """Centroids of the vectors of one length, the group of each, and the least and greatest angle of its own vectors."""

    kind: np.dtype
    centroids: np.ndarray
    group: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def home(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cosines to all centroids, and the home cell, of each vector."""
        dots = matrix(vectors.to_pylist(), len(vectors), self.kind) @ self.centroids.T
        return dots, dots.argmax(1)


def angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1, 1))


def homed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vectors with cell (home) and dot (cosine to its centroid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            if batch.num_rows:
                dots, home = cells.home(batch.column(2))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(dots[np.arange(len(home)), home])], ["id", "n", "vector", "cell", "dot"])

    return vectors.select("id", "n", "vector").mapInArrow(run, "id long, n long, vector binary, cell int, dot double")


def ringed(vectors: DataFrame, cells: Cells) -> Cells:
    """cells with the angles of all vectors to their home centroid."""
    rows = vectors.groupBy("cell").agg(F.min("dot").alias("low"), F.max("dot").alias("high")).toArrow()
    low, high = np.full(len(cells.centroids), np.inf), np.full(len(cells.centroids), -np.inf)  # an empty cell is never visited
    low[rows["cell"].to_numpy()], high[rows["cell"].to_numpy()] = angles(rows["high"].to_numpy()), angles(rows["low"].to_numpy())
    return replace(cells, low=low, high=high)


def placed(vectors: DataFrame, cells: Cells, threshold: float, groups: list[int]) -> DataFrame:
    """grp, id, n, vector, home (the home cell where it is in the group, else -1) and visits: a row for each of the groups of cells that a vector visits."""
    reach, angle = math.sqrt(2 - 2 * threshold) + 1e-9, math.acos(threshold) + 1e-7
    between = np.array([np.linalg.norm(cells.centroids - x, axis=1) for x in cells.centroids])
    members = [np.flatnonzero(cells.group == g) for g in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            if not batch.num_rows:
                continue
            x, home, best = matrix(batch.column(2).to_pylist(), batch.num_rows, cells.kind), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for g, own in zip(groups, members, strict=True):
                dots = x @ cells.centroids[own].T
                at = angles(dots)
                inside = (best[:, None] - dots <= reach * between[np.ix_(home, own)] + 1e-12) & (at <= cells.high[own] + angle) & (at >= cells.low[own] - angle)
                inside |= home[:, None] == own[None]
                row, k = np.nonzero(inside)
                rows, sizes = np.unique(row, return_counts=True)
                if len(rows):
                    visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(own[k], pa.int32()))
                    at_home = np.where(cells.group[home[rows]] == g, home[rows], -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g), pa.int32()), *(c.take(pa.array(rows)) for c in batch.columns[:3]), pa.array(at_home, pa.int32()), visits], ["grp", "id", "n", "vector", "home", "visits"])

    return vectors.select("id", "n", "vector", "cell", "dot").mapInArrow(run, "grp int, id long, n long, vector binary, home int, visits array<int>")


def matrix(vectors: Iterable[bytes], n: int, kind: np.dtype) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vectors), kind).reshape(n, -1).astype(np.float64))


def compare(group: pd.DataFrame, threshold: float, kind: np.dtype) -> pd.DataFrame:
    """Links of one pair of blocks: id, n_links (of home vectors, to all there), label (least id that it reaches here).

    Home cell by home cell: where single precision sees a cosine near the threshold, the rows and columns concerned are
    multiplied again in double precision.
    """
    home, others = group[group.home_side], group[~group.home_side]
    ids, counts, labels = [], [], []
    if len(home) and len(others):
        left, right = matrix(home.vector, len(home), kind), matrix(others.vector, len(others), kind)
        left_small, right_small = left.astype(np.float32), right.astype(np.float32)
        a, b, n = home.id.to_numpy(), others.id.to_numpy(), others.n.to_numpy()
        visits = np.concatenate(others.visits.to_numpy())
        place = np.repeat(np.arange(len(others)), others.visits.map(len))
        order = np.argsort(visits, kind="stable")
        visits, place = visits[order], place[order]
        cell = home.home.to_numpy()
        for c in np.unique(cell):
            mine, there = np.flatnonzero(cell == c), place[np.searchsorted(visits, c) : np.searchsorted(visits, c, "right")]
            near = left_small[mine] @ right_small[there].T >= np.float32(threshold - SLACK)
            rows, columns = mine[near.any(1)], there[near.any(0)]
            linked = left[rows] @ right[columns].T >= threshold
            own, other = a[rows], b[columns]
            linked &= own[:, None] != other[None]
            if not linked.any():
                continue
            label, far, found = own.copy(), np.iinfo(np.int64).max, other.copy()
            while True:
                new_found = np.minimum(found, np.where(linked, label[:, None], far).min(0))
                new_label = np.minimum(label, np.where(linked, new_found[None], far).min(1))
                if (new_found == found).all() and (new_label == label).all():
                    break
                label, found = new_label, new_found
            ids += [own, other]
            counts += [linked @ n[columns], np.zeros(len(other), np.int64)]
            labels += [label, found]
    out = {name: np.concatenate(x) if x else np.empty(0, np.int64) for name, x in (("id", ids), ("n_links", counts), ("label", labels))}
    found = pd.DataFrame(out).astype("int64")
    return found[(found.n_links > 0) | (found.id != found.label)]


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: id, n_links, component_id, kept."""
    v = F.col("vector")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    single = df.schema[vector_col].dataType.elementType.typeName() == "float"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(finite, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.struct(F.xxhash64("vector"), F.hash("vector"), F.size("vector"))))
    kind = np.dtype(np.float32 if single else np.float64)
    with scratch():
        rows = materialize(rows, "vectors")
        copies = rows.where("ok").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        rows = lookup(rows.select("id", "key", "ok", "vector"), copies, ["key"]).select("id", "ok", "vector", F.coalesce("rep", "id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"))
        members = materialize(rows.select("id", "ok", "rep", "n"), "members", outer=True)
        vectors = materialize(packed(rows.where("ok and id = rep").dropDuplicates(["id"]), kind), "packed", outer=True)
    links = _links(vectors, threshold, kind)
    if links is None:
        found = members.select("id", (F.col("n") - 1).alias("n_links"), F.col("rep").alias("component_id"))
    else:
        counts = links.groupBy("id").agg(F.sum("n_links").alias("more")).where("more > 0")
        groups = components(links.select(F.col("id").alias("a"), F.col("label").alias("b")))
        about = counts.join(groups, counts["id"] == groups["node"], "left").select(F.col("id").alias("rep"), "more", "component")
        found = lookup(members, about, ["rep"]).select("id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def packed(distinct: DataFrame, kind: np.dtype) -> DataFrame:
    """id, n, width and the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes(), vectors.offsets.to_numpy()
            ends = (ends - ends[0]) * kind.itemsize if len(ends) else ends
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends) // kind.itemsize, pa.int32()), pa.array([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "n", "width", "vector"])

    return distinct.select("id", "n", "vector").mapInArrow(run, "id long, n long, width int, vector binary")


def _links(vectors: DataFrame, threshold: float, kind: np.dtype) -> DataFrame | None:
    widths = {r["width"]: r["count"] for r in vectors.groupBy("width").count().where("count > 1").collect()}
    found = [_links_of(vectors.where(F.col("width") == w), total, threshold, kind) for w, total in sorted(widths.items())]
    return reduce(DataFrame.union, found) if found else None


def centroids_of(vectors: DataFrame, total: int, kind: np.dtype) -> np.ndarray:
    """Centroids of the cells, fitted on a sample of SAMPLE vectors a cell."""
    cells = max(1, min(CELLS, total // CELL))
    part = max(1, total // (SAMPLE * cells))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0).select("vector").toArrow()["vector"].to_pylist() or [vectors.first()["vector"]]
    return fit(matrix(sample, len(sample), kind), cells)


def _links_of(vectors: DataFrame, total: int, threshold: float, kind: np.dtype) -> DataFrame:
    """Links of the vectors of one length."""
    centroids = centroids_of(vectors, total, kind)
    some = fit(centroids, min(len(centroids), -(-total // GROUP)))
    cells = Cells(kind, centroids, (centroids @ some.T).argmax(1), np.empty(0), np.empty(0))
    with scratch():
        vectors = materialize(homed(vectors, cells), "homed")
        cells = ringed(vectors, cells)
        found = []
        for groups in _parts(vectors, cells, total, threshold):
            with scratch():
                found.append(_compared(materialize(placed(vectors, cells, threshold, groups), "cells"), threshold, kind))
        return materialize(reduce(DataFrame.union, found), "links", outer=True)


def _parts(vectors: DataFrame, cells: Cells, total: int, threshold: float) -> list[list[int]]:
    """The groups in parts, each of which writes and sends about as many rows as there are vectors (ROWS at least), by what a sample visits."""
    groups, step = list(range(int(cells.group.max()) + 1)), max(1, total // SIZED)
    some = placed(vectors.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(step)) == 0), cells, threshold, groups)
    seen = {r["grp"]: (step * r["homes"], step * r["alls"]) for r in _sizes(some)}
    parts, room = [], 0
    for g in groups:
        homes, alls = seen.get(g, (0, 0))
        rows = alls + homes * -(-alls // VISITORS) + alls * -(-homes // BLOCK)
        if not parts or rows > room:
            parts.append([])
            room = max(ROWS, total)
        parts[-1].append(g)
        room -= rows
    return parts


def _sizes(spots: DataFrame) -> list:
    return spots.groupBy("grp").agg(F.sum((F.col("home") >= 0).cast("long")).alias("homes"), F.count("*").alias("alls")).collect()


def _compared(spots: DataFrame, threshold: float, kind: np.dtype) -> DataFrame:
    """Links of the vectors that meet in the groups of spots."""
    sizes = [(r["grp"], max(1, -(-r["homes"] // BLOCK)), -(-r["alls"] // VISITORS)) for r in _sizes(spots)]
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    blocks = spots.sparkSession.createDataFrame(sizes, "grp int, homes int, alls int")
    spots = spots.join(F.broadcast(blocks), "grp")
    none = F.array().cast("array<int>")
    home = spots.where("home >= 0").select("grp", deal(F.col("homes")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), F.lit(True).alias("home_side"), "id", "n", "vector", "home", none.alias("visits"))
    all_ = spots.select("grp", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), deal(F.col("alls")).alias("j"), F.lit(False).alias("home_side"), "id", "n", "vector", "home", "visits")
    pairs = home.unionByName(all_).groupBy("grp", "i", "j").applyInPandas(lambda g: compare(g, threshold, kind), "id long, n_links long, label long")
    return materialize(pairs, "blocks", outer=True)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT DISTINCT a, a AS r FROM links UNION SELECT l.b, r FROM reach JOIN links l ON l.a = reach.a WHERE r < l.b),
component AS (SELECT a, min(r) AS c FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN component ON component.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""
