"""Tables of the engine: typed JSON and text sources, keyed upserts, run registry, catalog, exports.

All is DataFrame in, DataFrame out; folders are any that Spark's readers open.
"""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafgrove.functions import text as T


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder named by spark.checkpoint.dir; one of our own only where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        spark.sparkContext.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def read_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good files (path, document_id, text with \\n line ends) and rejected ones (path, reason): not UTF-8, or no Markdown suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.col("content").cast("string")
    rows = files.withColumn("text", text).withColumn("kind", T.source_kind(F.col("path")))
    reason = F.when(F.coalesce(F.col("kind") != "markdown", F.lit(True)), "unsupported source kind").when(F.col("text").isNull(), "not UTF-8")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select("path", F.sha2("content", 256).alias("document_id"), F.regexp_replace("text", "\r\n?", "\n").alias("text"))
    return good, rows.where("reason is not null").select("path", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, gzip too."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def upsert(old: DataFrame | None, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows by key; of several the one with the greatest version stays, so repeating an upsert changes nothing."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    order = W.partitionBy(*key).orderBy(F.desc(version), F.xxhash64(*[c for c in both.columns if both.schema[c].dataType.typeName() not in ("map", "variant")]))
    return both.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def artifacts(df: DataFrame, run_type: str, run_id: str, document_id: str = "document_id", path: str = "path") -> DataFrame:
    """Artifact rows (run_type, run_id, document_id, path, kind, content) of rows with a content column of text, bytes or a struct."""
    kind = df.schema["content"].dataType.typeName()
    content = F.to_json("content") if kind == "struct" else F.base64("content") if kind == "binary" else F.col("content").cast("string")
    name = "json" if kind == "struct" else "binary" if kind == "binary" else "text"
    return df.select(F.lit(run_type).alias("run_type"), F.lit(run_id).alias("run_id"), F.col(document_id).cast("string").alias("document_id"), F.col(path).alias("path"), F.lit(name).alias("kind"), content.alias("content"))


def artifact(table: DataFrame, run_type: str, run_id: str, document_id: str, path: str) -> DataFrame:
    """The artifact of a key: at most one row; the key's parts reach the scan."""
    return table.where((F.col("run_type") == run_type) & (F.col("run_id") == run_id) & (F.col("document_id") == document_id) & (F.col("path") == path))


def write_keyed(new: DataFrame, folder: str, key: list[str], version: str) -> DataFrame:
    """A keyed table in a folder of generations: upserts new and returns the table.

    Each call writes a new generation beside the last; readers take the latest that is complete, so a call that breaks
    off, or is repeated, changes nothing that others see.
    """
    spark = new.sparkSession
    last = _generation(spark, folder)
    table = upsert(None if last is None else spark.read.parquet(f"{folder}/{last:06d}"), new, key, version)
    table.write.parquet(f"{folder}/{0 if last is None else last + 1:06d}")
    return read_keyed(spark, folder)


def read_keyed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{_generation(spark, folder):06d}")


def _generation(spark: SparkSession, folder: str) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")) if fs.exists(path) else []
    return max((int(f.getPath().getParent().getName()) for f in done), default=None)


def merge_catalog(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Catalog entries of both sides; what the new side leaves null keeps its old value."""
    fresh = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    joined = old.join(fresh, key, "full")
    return joined.select(key, *((F.coalesce(f"_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in old.columns if c != key))


def settings_digest(settings: dict) -> str:
    """SHA-256 of the settings as canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()).hexdigest()


def identity_matches(payload: dict, expected: dict, aliases: dict[str, str] | None = None) -> bool:
    """Whether a stored run has the expected identity; a key may be stored under its alias."""
    return all(payload.get(k, payload.get((aliases or {}).get(k, k))) == v for k, v in expected.items())


class RunRegistry:
    """Runs by (run_type, run_id) as one small JSON file each, made only if absent: a run is reserved once, and reused or refused after."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda run_type, run_id: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{run_type}/{run_id}.json")
        self._fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def reserve(self, run_type: str, run_id: str, document_id: str, identity: dict) -> tuple[bool, dict]:
        """(whether it is new, its record). A run of another identity is a conflict."""
        path = self._path(run_type, run_id)
        record = {"run_type": run_type, "run_id": run_id, "document_id": document_id, "status": "reserved", "identity": identity, "manifest_ref": None}
        try:
            out = self._fs.create(path, False)
        except Exception:
            found = self.read(run_type, run_id)
            if found is None:
                raise
            if not identity_matches(found["identity"], identity):
                raise ValueError(f"run {run_type}/{run_id} exists with another identity") from None
            return False, found
        self._put(out, record)
        return True, record

    def complete(self, run_type: str, run_id: str, manifest_ref: str) -> dict:
        record = self.read(run_type, run_id) | {"status": "completed", "manifest_ref": manifest_ref}
        self._put(self._fs.create(self._path(run_type, run_id), True), record)
        return record

    def read(self, run_type: str, run_id: str) -> dict | None:
        path = self._path(run_type, run_id)
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(path), "UTF-8")) if self._fs.exists(path) else None

    @staticmethod
    def _put(out, record: dict) -> None:
        out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        out.close()


def split_outcomes(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successful rows and failed ones of a batch (error_type null: success)."""
    return results.where("error_type is null").drop("error_type", "error_message"), results.where("error_type is not null").select("item_index", "error_type", "error_message")


def export_documents(nodes: DataFrame, summaries: DataFrame, text_name: str = "page_content") -> DataFrame:
    """Nodes for retrieval frameworks: content (summary, else title) and metadata; text_name is the target's name of the content."""
    own = nodes.join(summaries.select("document_id", "node_id", "summary"), ["document_id", "node_id"], "left")
    meta = F.struct("document_id", "node_id", "parent_id", "title", "level", "path", "start_page", "end_page")
    return own.select(F.col("node_id").alias("id"), F.coalesce("summary", "title").alias(text_name), F.to_json(meta).alias("metadata"))
