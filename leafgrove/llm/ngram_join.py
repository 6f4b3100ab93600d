"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word n-grams. Documents with equal sets count once. All n-grams have one order,
rarest first (by counts of all n-grams in hashed bins). For two sets to reach the similarity, the first few n-grams of
both in that order (|x| - needed overlap + d of them) must share d, so only these are indexed.

1. Groups. Each document is a group of its own. In each indexed n-gram that several groups share, one document is the
   pivot, and the others are compared with it; what links joins groups. A few rounds partition near copies into groups
   at a cost in proportion to the index, however large a group grows.
2. Families. Near copies of one text that are not similar enough to each other are in no group; each joins the family of
   a document near it. Two documents of a family are compared by what tells them from the family's middle (the n-grams
   of most of its documents), as the difference of two sets is that of their differences from a third: these are few, and
   a pair that links must share so many of them that hardly any other pair meets.
3. Token-group matrix. For each family (or group, of documents without one), the union of its documents' indexed n-grams.
   A document's overlap with the union of another family bounds its overlap with any member. Only families with an
   overlap of d are opened, and only then are members compared one by one. So no link between different sets is lost.

The whole texts are read twice (counts, indexed n-grams); sets to compare pairs by are made once, of the documents that
share enough indexed n-grams with others.

Null and empty texts, and texts without words, have an empty set and link with nothing. A text with fewer words than n
has one n-gram, the whole sequence. Texts are taken whole. Repeated rows are equal sets. A row with a null id links with
nothing and has no component. Ids are integers. Ties of size or rarity do not matter. An empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrove.llm._components import components
from leafgrove.llm._shared import lookup, materialize, read, scratch, slices, small_batches

#: Bits of the bins of the rarity counts; bins that are added up together. A rarity is eight times the binary logarithm of
#: a count, in one byte.
BITS, SEGMENT = 20, 1 << 14
#: Parts of the n-grams that are matched one after another.
SLICES = 4
#: N-grams that a candidate pair must share in the index: 2 + size / DEPTH. More cost index rows, but a passage that two
#: unlike documents share then makes no candidate of them.
DEPTH = 33
#: Rounds that build groups before groups are opened, at most; another follows if a link came for so many documents left.
ROUNDS, WORTH = 3, 20
#: Levels of difference from a family's middle, up to what similar sets may differ by.
LEVELS = 8
#: Distinct words whose hashes a Python worker remembers.
MEMORY = 80_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_words: dict[bytes, int] = {}


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Hashes of a text's distinct word n-grams. bytes.lower() changes A-Z only, bytes.split() cuts at 0x20 and 0x09-0x0D only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > MEMORY:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):  # the place counts: each step is mixed before the next is added
        total = (total ^ hashes[k : len(words) - n + 1 + k]) * _MIX[k % len(_MIX)]
        total ^= total >> np.uint64(29)
    return np.unique(total * _MIX[(n + 1) % len(_MIX)] ^ total >> np.uint64(32))


def rarities(df: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Rarity of each bin by its count of n-grams over all texts: a byte a bin, whatever the corpus."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.uint32)
        held, waiting = [], 0
        for batch in slices(batches):
            for text in batch.column(0):
                held.append((ngrams(text.as_py(), n) & np.uint64(size - 1)).astype(np.int32))
                waiting += len(held[-1])
                if waiting > 500_000:
                    counts += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
                    held, waiting = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=size).astype(np.uint32)
        if counts.any():
            parts = counts.reshape(-1, min(SEGMENT, size))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["segment", "counts"])

    def level(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(SEGMENT, size), np.int64)
        for table in tables:
            for x in table.column("counts"):
                total += np.frombuffer(x.as_py(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8).tobytes()], pa.binary())], ["segment", "levels"])

    found = df.select(text_col).mapInArrow(count, "segment int, counts binary").groupBy("segment").applyInArrow(level, "segment int, levels binary").toArrow()
    levels = np.zeros((size // min(SEGMENT, size), min(SEGMENT, size)), np.uint8)
    for segment, own in zip(found["segment"].to_pylist(), found["levels"].to_pylist(), strict=True):
        levels[segment] = np.frombuffer(own, np.uint8)
    return levels.reshape(-1)


def ordered(text: str | None, n: int, levels: np.ndarray) -> np.ndarray:
    """A text's n-grams as numbers, rarest bin first; a number is a rarity and 56 bits of the hash."""
    hashes = ngrams(text, n)
    return np.sort(levels[(hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8))


def indexed(df: DataFrame, id_col: str, text_col: str, n: int, per_cent: int, levels: np.ndarray) -> DataFrame:
    """id, n_shingles, key (of the whole set), prefix (the indexed n-grams), a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, prefixes = [], [], []
            for text in batch.column(1):
                own = ordered(text.as_py(), n, levels)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                prefixes.append(own[: len(own) - -(-per_cent * len(own) // 100) + 2 + len(own) // DEPTH].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n_shingles", "key", "prefix"])

    return df.select(id_col, text_col).mapInArrow(run, "id long, n_shingles long, key binary, prefix array<long>")


class Verifier:
    """Compares pairs of documents by their whole sets, made once from the texts of the documents with the given ids."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, ids: DataFrame, n: int, per_cent: int, levels: np.ndarray):
        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ordered(t.as_py(), n, levels).tobytes() for t in batch.column(1)], pa.binary())], ["id", "own"])

        texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        own = lookup(texts, ids, ["id"], "inner", hot=False).select("id", "text").mapInArrow(sets, "id long, own binary")
        self.own, self.per_cent = materialize(own, "sets"), per_cent

    def _both(self, pairs: DataFrame) -> DataFrame:
        of = lambda c: self.own.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "own_a", "own_b")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""
        per_cent = self.per_cent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * shared >= per_cent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"])

        return self._both(pairs).mapInArrow(run, "a long, b long")

    def near(self, pairs: DataFrame) -> DataFrame:
        """id, f and delta (n-grams of one of them only) of the pairs (a, b) that differ by no more than half of b."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep, deltas = [], []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    delta = np.setxor1d(x, y, assume_unique=True)
                    keep.append(2 * len(delta) <= len(y))
                    if keep[-1]:
                        deltas.append(delta.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))), pa.array(deltas, pa.list_(pa.int64()))], ["id", "f", "delta"])

        return self._both(pairs).mapInArrow(run, "id long, f long, delta array<long>")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, per_cent: int = 85) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (least id that links reach)."""
    # A row of a pair holds two whole sets.
    with small_batches(df.sparkSession, 100), scratch():
        levels = rarities(df, text_col, n)
        rows = materialize(indexed(df, id_col, text_col, n, per_cent, levels), "indexed")
        known = rows.where("id is not null and key is not null")
        copies = materialize(known.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("key", "rep"), "copies")
        rep = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
        members = materialize(lookup(rows.select("id", "n_shingles", "key"), copies, ["key"]).select("id", "n_shingles", rep.alias("rep")), "members", outer=True)
        firsts = lookup(known.where("n_shingles > 0"), copies, ["key"]).where("rep is null or rep = id")
        index = _shared(firsts.select("id", F.col("n_shingles").alias("size"), F.explode("prefix").alias("token")))
        # A document that shares too few indexed n-grams with all others together links with none of them.
        enough = index.groupBy("id", "size").agg(F.count("*").alias("n")).where(F.col("n") >= _needed(F.ceil(F.col("size") * per_cent / 100), per_cent)).select("id")
        enough = materialize(enough, "enough")
        index = materialize(index.join(enough, "id"), "index")
        verify = Verifier(df, id_col, text_col, enough, n, per_cent, levels)
        joined = materialize(_joined(verify, index, per_cent), "joined", outer=True)
    found = lookup(members, joined.withColumnRenamed("node", "rep"), ["rep"])
    return found.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def _shared(index: DataFrame) -> DataFrame:
    """The rows of the index whose n-gram two documents have: no other can make a pair."""
    found = []
    for k in range(SLICES):
        own = index.where(F.shiftright("token", 20).bitwiseAND(F.lit(SLICES - 1)) == k)
        tokens = own.groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("token")
        found.append(materialize(own.join(tokens, "token"), "shared"))
    return reduce(DataFrame.union, found)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of df but those whose group has a lesser id; of repeated rows of one id one stays. Rows without id or words stay."""
    found = materialize(groups(df, id_col, text_col, n, per_cent), "groups")
    more = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct().withColumn("goes", F.lit(True))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    rows = lookup(rows, more, ["id"], hot=False).where("goes is null")
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if not repeated.isEmpty():
        rows = rows.where("id is null").unionByName(rows.where("id is not null").dropDuplicates(["id"]))
    return rows.select("row.*")


def _joined(verify: Verifier, index: DataFrame, per_cent: int) -> DataFrame:
    """node, component of every document of the index (id, size, token) that links with another one."""
    links, current = [], index.withColumn("g", F.col("id"))
    for k in range(ROUNDS):
        with scratch():
            # N-grams of one group only can't join groups any more: they leave the index for good.
            pivot = F.min(F.struct(F.xxhash64("g", F.lit(k)), F.xxhash64("id", F.lit(k)), "id", "size", "g"))
            pivots = current.groupBy("token").agg(pivot.alias("p"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi")
            pivots = pivots.select("token", F.col("p.id").alias("pivot"), F.col("p.size").alias("other"), F.col("p.g").alias("pg"))
            mixed = materialize(current.join(pivots, "token"), "mixed")
            pairs = mixed.where("g <> pg").where(_fits(per_cent)).groupBy(F.col("id").alias("a"), F.col("pivot").alias("b"), "size", "other").agg(F.count("*").alias("n"))
            pairs = materialize(pairs.where(F.col("n") >= _needed(F.least("size", "other"), per_cent)).select("a", "b"), "pairs")
            new = materialize(verify.linked(pairs), "verified", outer=True)
            left, found = mixed.select("id").distinct().count(), new.count()
            if found:
                links.append(new)
                joined = materialize(components(reduce(DataFrame.union, links)), "joined")
                mixed = lookup(mixed.drop("g"), joined.withColumnRenamed("node", "id"), ["id"], hot=False).withColumn("g", F.coalesce("component", "id"))
            current = materialize(mixed.select("id", "size", "token", "g"), "current", outer=True)
        # What is left is compared in full in any case; another round pays while it joins many.
        if found * WORTH < left:
            break
    with scratch():
        cells, near = _families(verify, current, per_cent)
        links.append(materialize(near.union(verify.linked(_opened(current, cells, per_cent))), "verified", outer=True))
    return components(reduce(DataFrame.union, links))


def _fits(per_cent: int) -> Column:
    """Length filter."""
    return 100 * F.least("size", "other") >= per_cent * F.greatest("size", "other")


def _depth(size: Column) -> Column:
    """Indexed n-grams that a document shares with any similar one, at least."""
    return 2 + F.floor(size / DEPTH)


def _needed(size: Column, per_cent: int) -> Column:
    """Indexed n-grams that documents must share, of which the smaller has this size."""
    return F.least(_depth(size), F.ceil(size * per_cent / 100))


def _bound(n: Column, m: Column, per_cent: int) -> Column:
    """Indexed n-grams that documents of these sizes must share.

    What two sets share lies in both prefixes, or behind the prefix that ends first: they share no more than the
    prefixes do and what is behind the one or the other. The bound rises in m up to n and falls beyond it.
    """
    behind = lambda x: F.greatest(F.lit(0), F.ceil(x * per_cent / 100) - _depth(x))
    return F.ceil((n + m) * per_cent / (100 + per_cent)) - F.greatest(behind(n), behind(m))


def _families(verify: Verifier, current: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """id, f (its family) of documents near another one, and links (a, b) that join all documents of a family that links join.

    With d n-grams of difference from any third set, n n-grams in all and v = (100 + per_cent) d - (100 - per_cent) n, two
    documents link if their differences share (v + v') / (2 (100 + per_cent)) n-grams or more. Where that is 0 or less, both
    link with the document of the least v; all other pairs share an n-gram of the first few that this bound leaves.
    """
    whole = 2 * (100 + per_cent)
    # Near copies agree on a pivot, as all take the first of those they know in one order.
    pivots = current.groupBy("token").agg(F.min(F.struct(F.xxhash64("id").alias("rank"), "id", "size")).alias("p"))
    pivots = pivots.select("token", F.struct("p.rank", "p.id").alias("pivot"), F.col("p.size").alias("other"))
    known = current.join(pivots, "token").where("id <> pivot.id").groupBy("id", "size", "pivot", "other").agg(F.count("*").alias("n"))
    known = known.where(F.col("n") >= _needed(F.least("size", "other"), per_cent)).groupBy("id").agg(F.min("pivot").alias("pivot"))
    near = materialize(verify.near(known.select(F.col("id").alias("a"), F.col("pivot.id").alias("b"))), "near")
    heads = near.select(F.col("f").alias("id")).distinct()
    members = near.join(heads, "id", "left_anti").union(heads.select("id", F.col("id").alias("f"), F.array().cast("array<long>").alias("delta")))
    members = materialize(members.join(current.select("id", "size", "g").distinct(), "id"), "members")
    families = members.groupBy("f").agg(F.count("*").alias("n"), F.min("g").alias("lo"), F.max("g").alias("hi"), F.max(F.when(F.col("id") == F.col("f"), F.col("size"))).alias("base"))
    step = F.greatest(F.lit(whole), F.floor(F.col("base") * (100 - per_cent) / LEVELS))
    cells, members = members.select("id", "f"), lookup(members, families.where("lo <> hi").select("f", F.col("n").alias("of"), step.alias("step")), ["f"], "inner")
    members = materialize(members, "mixed")
    # N-grams that most differ in from the head are those that the head differs in from the middle.
    counts = members.select("f", "of", F.explode("delta").alias("token")).groupBy("f", "token").agg(F.count("*").alias("n"), F.max("of").alias("of"))
    most = counts.where("2 * n > of").groupBy("f").agg(F.collect_list("token").alias("most"))
    turned = F.when(F.col("most").isNull(), F.col("delta")).otherwise(F.array_union(F.array_except("delta", "most"), F.array_except("most", "delta")))
    members = lookup(members, most, ["f"]).withColumn("delta", turned).drop("most").withColumn("d", F.size("delta").cast("long"))
    members = members.withColumn("v", (100 + per_cent) * F.col("d") - (100 - per_cent) * F.col("size"))
    members = materialize(members.withColumn("level", F.floor(F.col("v") / F.col("step"))), "members")
    middles = members.groupBy("f").agg(F.min(F.struct("v", "id")).alias("m"), F.collect_set("level").alias("levels"))
    members = materialize(lookup(members, middles, ["f"]).withColumn("sure", F.col("v") + F.col("m.v") <= 0), "members")
    sure = members.where("sure and id <> m.id").select(F.col("id").alias("a"), F.col("m.id").alias("b"))
    # N-grams of one group only make no pair that is not joined. Of two documents, the head and the other, the middle tells all.
    line = ["f", "id", "g", "size", "d", "v", "level", "step", "sure"]
    each = materialize(members.where("of > 2").select(*line, F.explode("delta").alias("token")), "each")
    counts = each.groupBy("f", "token").agg(F.count("*").alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("f", "token", "c")
    each = lookup(each, counts, ["f", "token"], hot=False)
    each = each.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "token", F.col("c").isNotNull().alias("met")))).alias("own"))
    each = lookup(each, members.select("f", "levels").dropDuplicates(["f"]), ["f"]).withColumn("asked", F.explode("levels")).where("(level + asked + 2) * step > 0")
    least = lambda v: F.greatest(F.lit(1), F.ceil(v / whole)).cast("long")
    prefix = F.greatest(F.lit(0), F.col("d") - least(F.col("v") + F.col("asked") * F.col("step")) + 1).cast("int")
    index = each.select(*line, "asked", F.posexplode(F.slice("own", F.lit(1), prefix)).alias("p", "x")).where("x.met")
    index = materialize(index.select(*line, "asked", "p", F.col("x.token").alias("token")), "deltas")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    same = (a("f") == b("f")) & (a("token") == b("token")) & (a("level") == b("asked")) & (a("asked") == b("level"))
    other = (a("g") != b("g")) & ~(a("sure") & b("sure")) & ((a("level") < b("level")) | (a("id") < b("id")))
    lengths = 100 * F.least(a("size"), b("size")) >= per_cent * F.greatest(a("size"), b("size"))
    places = 1 + F.least(a("p"), b("p")) + F.least(a("d") - a("p"), b("d") - b("p")) - 1 >= least(a("v") + b("v"))
    pairs = index.where("level <= asked").alias("a").join(index.where("level >= asked").alias("b"), same & other & lengths & places)
    pairs = materialize(pairs.select(a("id").alias("a"), b("id").alias("b")).distinct(), "pairs")
    return cells, sure.union(verify.linked(pairs))


def _enough(rows: DataFrame, per_cent: int) -> DataFrame:
    """id, c, h of documents (of a family c) whose overlap with the union of the family h is enough; rows: an n-gram that both hold."""
    bound = rows.groupBy("id", "size", "c", "h").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # Sizes that can't be similar don't count; of those between, the ends have the lowest bound, but for rounding.
    lo, hi = F.greatest("lo", F.ceil(F.col("size") * per_cent / 100)), F.least("hi", F.floor(F.col("size") * 100 / per_cent))
    least = F.least(_bound(F.col("size"), lo, per_cent), _bound(F.col("size"), hi, per_cent)) - 2
    return bound.where((F.col("n") >= least) & (F.col("n") >= _needed(F.ceil(F.col("size") * per_cent / 100), per_cent))).select("id", "c", "h")


def _opened(current: DataFrame, cells: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of documents of different groups and families that share enough, where either's overlap with the union of the other's family is enough."""
    # A document without a family is with those of its group, which need no comparison either.
    cell = F.when(F.col("f").isNotNull(), F.xxhash64(F.lit("f"), F.col("f"))).otherwise(F.xxhash64(F.lit("g"), F.col("g")))
    current = materialize(lookup(current, cells, ["id"], hot=False).select("id", "size", "token", "g", cell.alias("c")), "cells")
    mixed = current.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("c").alias("x"), F.max("c").alias("y")).where("lo <> hi and x <> y").select("token")
    current = materialize(current.join(materialize(mixed, "tokens"), "token"), "mixed")
    # A row of the matrix also knows the least and greatest size of the family's documents that hold the n-gram.
    matrix = current.groupBy("token", "c").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    weights = current.groupBy("c").agg(F.count("*").alias("w"))
    matrix = materialize(lookup(matrix, weights, ["c"]), "matrix")
    fits = (100 * F.col("hi") >= per_cent * F.col("size")) & (100 * F.col("size") >= per_cent * F.col("lo"))
    # First documents are held against larger families, then the documents of these against those that are left.
    larger = matrix.select("token", F.col("c").alias("h"), "lo", "hi", F.col("w").alias("v"))
    asks = lookup(current, weights, ["c"]).join(larger, "token").where((F.col("w") < F.col("v")) | (F.col("w") == F.col("v")) & (F.col("c") < F.col("h"))).where(fits)
    first = materialize(_enough(asks, per_cent), "qualify")
    smaller = matrix.select("token", F.col("c").alias("h"), "lo", "hi").join(first.select(F.col("c").alias("h"), F.col("h").alias("c")).distinct(), "h")
    second = materialize(_enough(current.join(smaller, ["token", "c"]).where(fits), per_cent), "qualify")
    first = first.join(second.select(F.col("c").alias("h"), F.col("h").alias("c")).distinct(), ["c", "h"], "left_semi")
    qualify = materialize(first.union(second.select(*first.columns)).select("id", "h"), "qualify")
    left = current.join(qualify, "id").select(F.col("id").alias("a"), "size", "g", F.col("c").alias("ca"), "h", "token")
    # Both ends must qualify with the other's family; the lesser id asks.
    right = current.join(qualify, "id").select(F.col("id").alias("b"), F.col("size").alias("other"), F.col("g").alias("gb"), F.col("c").alias("cb"), F.col("h").alias("hb"), "token")
    pairs = left.join(right, (left["token"] == right["token"]) & (left["h"] == right["cb"]) & (left["ca"] == right["hb"])).where("a < b and g <> gb").where(_fits(per_cent))
    enough = (F.col("n") >= _needed(F.least("size", "other"), per_cent)) & (F.col("n") >= _bound(F.col("size"), F.col("other"), per_cent))
    return pairs.groupBy("a", "b", "size", "other").agg(F.count("*").alias("n")).where(enough).select("a", "b")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT DISTINCT a, a AS r FROM links UNION SELECT l.b, r FROM reach JOIN links l ON l.a = reach.a WHERE r < l.b),
component AS (SELECT a, min(r) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component ON a = d.doc_id
"""
