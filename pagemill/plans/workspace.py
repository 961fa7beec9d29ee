"""A workspace: tables in buckets of documents, and one manifest for all of them.

A table's rows lie in folders by version and by bucket of their document. The manifest says which versions make up each
bucket of each table; a change writes new versions of the buckets that it touches, and counts as a whole, over several tables, when
the next manifest is written, which either is there completely or is not. What no manifest names is left over from a
change that did not end; recover() removes it. Rows of tables without document_id lie in one bucket.

The search index is brought up to date after the tables: documents whose turn it is are in the table `pending` meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import storage
from ..operators import fulltext, postings, relational
from . import ingest

BUCKETS = 64
_MANIFESTS, _INDEX = "_manifests", "_index"


class Conflict(RuntimeError):
    """Another change was committed first."""


class Change:
    """New versions of parts of tables, which count together once commit() has ended."""

    def __init__(self, workspace: Workspace) -> None:
        self.workspace = workspace
        self.number, self.state = workspace._state()

    def _write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """The version of each bucket that rows have rows for, written."""
        w, version = self.workspace, uuid.uuid4().hex
        at = f"{w.root}/{name}/version={version}"
        parted = rows.withColumn("bucket", self._bucket(rows))
        # Large buckets are written in parts, small ones are not split.
        parted.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(at)
        fs, path = storage.filesystem(w.spark, at)
        found = [f.getPath().getName() for f in fs.listStatus(path(at))]
        return {f.removeprefix("bucket="): [version] for f in found if f.startswith("bucket=")}

    def _bucket(self, rows: DataFrame) -> Column:
        if "document_id" not in rows.columns:
            return F.lit(0)
        return F.coalesce(F.pmod(F.col("document_id").cast("long"), F.lit(self.state["buckets"])), F.lit(0)).cast("int")

    def _table(self, name: str, schema: StructType) -> dict:
        """The table's entry, with the columns that schema adds."""
        own = self.state["tables"].setdefault(name, {"schema": {"type": "struct", "fields": []}, "parts": {}})
        known = {f["name"]: f for f in own["schema"]["fields"]}
        for f in json.loads(schema.json())["fields"]:
            f = f | {"nullable": True}
            if f["name"] not in known:
                own["schema"]["fields"].append(f)
            elif known[f["name"]]["type"] != f["type"]:
                raise ValueError(f"column {f['name']} of {name} has another type")
        return own

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table's rows are these; they may be read from the table itself."""
        parts = self._write(name, rows)
        self.state["tables"].pop(name, None)
        self._table(name, rows.schema)["parts"] = parts

    def append(self, name: str, rows: DataFrame) -> None:
        own = self._table(name, rows.schema)
        for b, versions in self._write(name, rows).items():
            own["parts"].setdefault(b, []).extend(versions)

    def rewrite(self, name: str, documents: Iterable[int] | DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """The buckets of these documents become change(their rows); change must keep rows of other documents as they are
        and give no rows of documents of other buckets. No other file is read or written."""
        buckets = self.buckets_of(documents)
        rows = change(self.workspace._rows(self.state, name, buckets))
        parts = self._write(name, rows)
        own = self._table(name, rows.schema)
        own["parts"] = {b: v for b, v in own["parts"].items() if int(b) not in buckets} | parts

    def buckets_of(self, documents: Iterable[int] | DataFrame) -> set[int]:
        if isinstance(documents, DataFrame):
            return {r[0] for r in documents.select(self._bucket(documents)).distinct().collect()}  # as many as there are buckets
        return {d % self.state["buckets"] for d in documents}

    def commit(self) -> None:
        """Writes the next manifest; if another change has, this one does not count."""
        w = self.workspace
        at = f"{w.root}/{_MANIFESTS}/{self.number + 1:012d}"
        fs, path = storage.filesystem(w.spark, at)
        draft = path(f"{w.root}/{_MANIFESTS}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        # A name that is there already is not taken over by a rename in the file systems that Spark writes to.
        if fs.exists(path(at)) or not fs.rename(draft, path(at)):
            fs.delete(draft, False)
            raise Conflict(f"manifest {self.number + 1} was written by another change")
        self.number += 1


class Workspace:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self):
        return storage.filesystem(self.spark, self.root)

    def _manifests(self) -> list[str]:
        fs, path = self._fs()
        top = path(f"{self.root}/{_MANIFESTS}")
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in names if n.isdigit())

    def _state(self) -> tuple[int, dict]:
        """Number and contents of the newest manifest."""
        found = self._manifests()
        if not found:
            return 0, {"buckets": self.buckets, "tables": {}}
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/{_MANIFESTS}/{found[-1]}"))
        try:
            return int(found[-1]), json.loads(text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def number(self) -> int:
        """That of the newest manifest: it rises with each change."""
        return int((self._manifests() or ["0"])[-1])

    def tables(self) -> list[str]:
        return sorted(self._state()[1]["tables"])

    def exists(self, name: str) -> bool:
        return name in self._state()[1]["tables"]

    def _rows(self, state: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        own = state["tables"][name]
        schema = StructType.fromJson(own["schema"])
        paths = [f"{self.root}/{name}/version={v}/bucket={b}" for b, versions in sorted(own["parts"].items()) if buckets is None or int(b) in buckets for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*[F.col(f"`{c}`") for c in schema.names])

    def table(self, name: str, documents: Iterable[int] | DataFrame | None = None) -> DataFrame:
        """A table; with documents, the buckets that hold theirs, and of these their rows."""
        change = Change(self)
        if documents is None:
            return self._rows(change.state, name)
        if isinstance(documents, DataFrame):
            return self._rows(change.state, name, change.buckets_of(documents)).join(documents.select("document_id"), "document_id", "left_semi")
        return self._rows(change.state, name, change.buckets_of(documents)).where(F.col("document_id").isin(*documents))

    def append(self, name: str, rows: DataFrame) -> None:
        change = Change(self)
        change.append(name, rows)
        change.commit()

    def replace(self, name: str, rows: DataFrame) -> None:
        change = Change(self)
        change.replace(name, rows)
        change.commit()

    def recover(self) -> list[str]:
        """Removes what changes that did not end have left, and what no manifest but older ones names; then brings the index up to date.

        For times when nothing is being changed. Gives the names of the folders removed."""
        fs, path = self._fs()
        _, state = self._state()
        gone = []
        for old in self._manifests()[:-1]:
            fs.delete(path(f"{self.root}/{_MANIFESTS}/{old}"), False)
        for f in fs.listStatus(path(self.root)) if fs.exists(path(self.root)) else []:
            name = f.getPath().getName()
            if not f.isDirectory() or name.startswith("_"):
                continue
            named = {v for versions in state["tables"].get(name, {"parts": {}})["parts"].values() for v in versions}
            for d in fs.listStatus(f.getPath()):
                if d.getPath().getName().removeprefix("version=") not in named:
                    fs.delete(d.getPath(), True)
                    gone.append(f"{name}/{d.getPath().getName()}")
        self.reindex()
        return sorted(gone)

    # ---- the index

    @property
    def index(self) -> postings.Index:
        return postings.Index(self.spark, f"{self.root}/{_INDEX}")

    def reindex(self) -> None:
        """A generation of the index for the documents in `pending`, which are none afterwards."""
        if not self.exists("pending") or not self.exists("records") or not (own := self.table("pending")).limit(1).count():
            return
        own = own.distinct()
        pages = self.table("pages", own) if self.exists("pages") else self.spark.createDataFrame([], "document_id bigint, page_number int, raw_text string, processed_text string")
        categories = self.table("categories") if self.exists("categories") else self.spark.createDataFrame([], "id bigint, name string")
        entries = fulltext.build(self.table("records", own), pages, categories)
        self.index.write(entries, own)
        self.replace("pending", own.limit(0))

    # ---- documents in and out

    def ingest(self, pages: DataFrame, mode: str = "auto") -> None:
        """Adds documents; those that are there already are replaced, so a second run changes nothing."""
        at = storage.scratch(self.spark, "ingest")
        pages.write.parquet(at)  # read once, whatever the source costs
        pages = self.spark.read.parquet(at)
        found = ingest.run(pages, mode)
        documents = pages.select("document_id").distinct()
        change = Change(self)
        for name, rows in ({"pages": pages} | {k: v for k, v in found.items() if k != "index"}).items():
            if name in change.state["tables"]:
                change.rewrite(name, documents, lambda old, rows=rows: old.join(documents, "document_id", "left_anti").unionByName(rows, allowMissingColumns=True))
            else:
                change.replace(name, rows)
        change.append("pending", documents)
        change.commit()
        self.reindex()
        storage.remove(self.spark, at)

    def delete_documents(self, ids: list[int]) -> None:
        """Documents and all that belongs to them, in one change; only their buckets are written."""
        change = Change(self)
        gone = self.spark.createDataFrame([(i,) for i in ids], "document_id bigint")
        lost = self.table("records", ids).select(F.col("id").alias("record_id")) if self.exists("records") else None
        for name, own in list(change.state["tables"].items()):
            columns = {f["name"] for f in own["schema"]["fields"]}
            if name == "pending":
                continue
            if "document_id" in columns:
                change.rewrite(name, ids, lambda old: relational.delete(old, gone, "document_id"))
            elif "record_id" in columns and lost is not None:
                change.replace(name, relational.delete(self.table(name), lost, "record_id"))
        change.append("pending", gone)
        change.commit()
        self.reindex()

    def edit(self, documents: Iterable[int], **changes: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the documents' buckets of each table named, all in one change, and their part of the index."""
        documents, change = list(documents), Change(self)
        for name, f in changes.items():
            change.rewrite(name, documents, f)
        change.append("pending", self.spark.createDataFrame([(d,) for d in documents], "document_id bigint"))
        change.commit()
        self.reindex()
