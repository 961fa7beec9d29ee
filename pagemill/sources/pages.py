"""Page text from files and tables. PDF and OCR engines are optional: a function of the file's bytes is given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "document_id bigint, page_number int, raw_text string, error string"
MOST_BYTES = 250 * 1024 * 1024


def from_text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One document for each file; form feeds part pages."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).withColumn("file", F.input_file_name())
    each = files.select(F.xxhash64("file").alias("document_id"), "file", F.posexplode(F.split("value", "\f")).alias("n", "raw_text"))
    return each.select("document_id", (F.col("n") + 1).alias("page_number"), "raw_text", F.lit(None).cast("string").alias("error"), "file")


def from_binary(spark: SparkSession, path: str, read: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """Pages of binary files by a reader of one file's bytes; a file that fails, is too large or has no pages has one page with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    # The bytes of files that are too large are not read.
    large = files.where(F.col("length") > MOST_BYTES).select(F.xxhash64("path").alias("document_id"), F.lit(1).alias("page_number"), F.lit("").alias("raw_text"), F.format_string(f"%d bytes, more than {MOST_BYTES}", "length").alias("error"))
    files = files.where(F.col("length") <= MOST_BYTES)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for key, content in zip(f["document_id"], f["content"], strict=True):
                try:
                    rows = [(key, i + 1, t, None) for i, t in enumerate(read(content))] or [(key, 1, "", "no pages")]
                except Exception as e:  # the page says why; the job goes on
                    rows = [(key, 1, "", repr(e))]
                yield pd.DataFrame(rows, columns=["document_id", "page_number", "raw_text", "error"])

    return files.select(F.xxhash64("path").alias("document_id"), "content").mapInPandas(run, PAGES).unionByName(large)


def checked(paths: list[str], suffix: str = ".pdf") -> list[tuple[str, str | None]]:
    """(path, why it is refused or None) of local files offered for import."""
    out = []
    for p in paths:
        f = Path(p)
        why = "no such file" if not f.is_file() else f"not a {suffix} file" if f.suffix.lower() != suffix else f"larger than {MOST_BYTES} bytes" if f.stat().st_size > MOST_BYTES else None
        out.append((p, why))
    return out


def from_table(texts: DataFrame, key: str, text: str, by_line: bool = False) -> DataFrame:
    """Stored pages from a table: a row is a document of one page, or of a page for each line."""
    if by_line:
        each = texts.select(F.col(key).alias("document_id"), F.posexplode(F.split(text, "\n")).alias("n", "raw_text")).withColumn("page_number", F.col("n") + 1)
    else:
        each = texts.select(F.col(key).alias("document_id"), F.lit(1).alias("page_number"), F.col(text).alias("raw_text"))
    return each.select("document_id", "page_number", "raw_text", F.lit(None).cast("string").alias("processed_text"))


def tables(spark: SparkSession, root: str, name: str, document_id=None) -> DataFrame:
    """A stored table, whole or of one document, in key order."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    if document_id is not None:
        df = df.where(F.col("document_id") == document_id)
    return df.orderBy("id") if "id" in df.columns else df
