"""Helpers that the corpus operators share: cutting lineage, checked lookups, hashing into folds."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side is broadcast only below so many rows (each row a few dozen bytes); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: Copies of each lookup row when the join is shuffled, so that a hot key is spread over so many tasks.
SALTS = 16
#: A lookup side with arrays is broadcast only below so many elements, too.
BROADCAST_ELEMENTS = 2_000_000
#: White space of the word contracts, 0x09 to 0x0D, beside the blank.
SPACES = "\t\n\x0b\x0c\r"
#: Shuffle files of a finished query go at once; without it they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a batch that goes to a Python worker.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Share of its largest heap that the driver's JVM may hold before a table is written; beyond it, garbage goes first.
HEAP = 0.5

Tables = list[tuple[SparkSession, str]]
_process: Tables = []


class _Written(threading.local):
    """Tables that materialize() wrote in this thread; each list belongs to a collected() block, the first to the process."""

    def __init__(self) -> None:
        self.lists: list[Tables] = [_process]


_written = _Written()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir where it is set, else one of our own (local runs and tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


def materialize(df: DataFrame, name: str = "cut", outer: bool = False, **options: str | int) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing.

    outer: the table outlives the innermost scratch() block. options: of the writer.
    """
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_dir(spark)}/leafgrove/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before else spark.conf.unset(CLEANUP)
    _written.lists[-2 if outer else -1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Plans, broadcasts and task records of finished tables leave the driver, and its heap shrinks, once it has grown beyond HEAP.

    Left to itself the heap grows to its limit over a few hundred small jobs, as what is behind them is seldom looked at.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        jvm.java.lang.System.gc()


@contextmanager
def collected() -> Iterator[Tables]:
    """Collects the tables that are written inside, for release() once nothing reads them any more."""
    _written.lists.append([])
    try:
        yield _written.lists[-1]
    finally:
        _written.lists.pop()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What runs inside sends Python workers so many rows at once: a batch is held whole by the executor and by the worker."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are written inside go at the end; what is returned must be materialized as outer."""
    with collected() as tables:
        yield
    release(tables)


def release(tables: Tables) -> None:
    """Delete tables that materialize() wrote; results that still read them must have been written out."""
    while tables:
        spark, path = tables.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: its folder goes with it
            return


def at_exit(tables: Tables) -> None:
    """Tables that are deleted with the process."""
    _process.extend(tables)


atexit.register(release, _process)


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", hot: bool = True) -> DataFrame:
    """Join big with a lookup table that has one row for each key.

    The lookup side is written out and counted: up to BROADCAST_ROWS rows, and BROADCAST_ELEMENTS elements of its arrays,
    it is broadcast. Beyond that both sides are shuffled on the keys and, where a key can be hot, a salt, so that a key
    with a third of all rows is spread over SALTS tasks. All ways give the same rows. Null keys find nothing.
    """
    small = materialize(small, "lookup")
    arrays = [F.size(F.col(f.name)) for f in small.schema.fields if f.dataType.typeName() == "array"]
    elements = F.coalesce(F.sum(sum(arrays, F.lit(0))), F.lit(0))
    rows, elements = small.agg(F.count("*"), elements).first()
    if rows <= BROADCAST_ROWS and elements <= BROADCAST_ELEMENTS:
        return big.join(F.broadcast(small), keys, how)
    if not hot:
        return big.join(small, keys, how)
    salt = "_salt"
    while salt in big.columns + small.columns:
        salt += "_"
    salted = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if not _odd(big, c)]), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, salt], how).drop(salt)


def _odd(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, to bound what a Python worker holds at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blanks(text: Column, spaces: str = SPACES) -> Column:
    """White space as blanks. Far cheaper than a pattern, as is a cut at one character."""
    for c in spaces:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as an array; null has none."""
    return F.array_remove(F.split(blanks(F.coalesce(text, F.lit(""))), " "), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
