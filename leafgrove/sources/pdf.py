"""PDF pages. Needs the pypdf library on the executors; without it every file gives a row that says so."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all PDF files of a folder; Spark reads the bytes, so any store will do. Files that can't be read give one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for where, content in zip(batch.path, batch.content, strict=True) for row in pages(where, bytes(content))]
            yield pd.DataFrame(rows, columns=["document_id", "path", "page_index", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "document_id string, path string, page_index int, text string, error string")


def pages(path: str, content: bytes) -> Iterator[tuple]:
    document = hashlib.sha256(content).hexdigest()
    try:
        import pypdf

        for k, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages):
            yield document, path, k, page.extract_text() or "", None
    except ImportError:
        yield document, path, None, None, "the pypdf library is missing"
    except Exception as e:  # a broken file must not stop the others
        yield document, path, None, None, f"{type(e).__name__}: {e}"
