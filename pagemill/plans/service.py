"""The calls of a search and records service over a workspace, and a small HTTP server for them.

Every call is a plan over the workspace's tables whose result is bounded (a page, a search's limit, one document's
records page by page); what is returned can be written as JSON.
"""

from __future__ import annotations

import json
import re
import tempfile
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import postings, relational, search
from ..sinks import export
from ..sources import pages as sources
from .workspace import Workspace

#: Records of one call, at most.
MOST_ROWS = 1_000
MARKER = "pagemill.json"
#: What the options of an import stand for.
OPTIONS = {"auto": "auto", "voter list": "voter_list", "table": "table", "form": "form"}


class NotFound(LookupError):
    pass


class Service:
    """Calls over one workspace. reader turns a file's bytes into the texts of its pages; without one only text files are read."""

    def __init__(self, workspace: Workspace, reader: Callable[[bytes], list[str]] | None = None) -> None:
        self.workspace, self.reader, self._job, self._imported, self._fields = workspace, reader, None, None, (None, [])
        self.progress = {"state": "idle", "percent": 0, "message": ""}

    # ---- the project

    @staticmethod
    def create(spark, root: str) -> Workspace:
        """A new workspace with its marker; one that is there already is opened."""
        w = Workspace(spark, root)
        fs, path = w._fs()
        w.recover()
        if not fs.exists(path(f"{w.root}/{MARKER}")):
            out = fs.create(path(f"{w.root}/{MARKER}"))
            out.write(bytearray(json.dumps({"version": 1}).encode()))
            out.close()
        return w

    @staticmethod
    def is_workspace(spark, root: str) -> bool:
        w = Workspace(spark, root)
        fs, path = w._fs()
        return fs.exists(path(f"{w.root}/{MARKER}"))

    def _table(self, name: str, like: str) -> DataFrame:
        w = self.workspace
        return w.table(name) if w.exists(name) else w.spark.createDataFrame([], like)

    @property
    def pages(self) -> DataFrame:
        return self._table("pages", "document_id bigint, page_number int, raw_text string, processed_text string, error string")

    @property
    def records(self) -> DataFrame:
        return self._table("records", "document_id bigint, page_number int, data map<string,string>, source_text string, origin string, id bigint, category_id bigint")

    @property
    def categories(self) -> DataFrame:
        return self._table("categories", "id bigint, document_id bigint, name string")

    @property
    def index(self) -> postings.Index | None:
        return self.workspace.index if self.workspace.index.generations() else None

    # ---- import

    def add(self, path: str, layout: str = "auto") -> dict:
        """Imports a file or folder that all executors can read; counts of its pages, and why the failed ones failed."""
        spark, mode = self.workspace.spark, OPTIONS.get(layout.lower(), layout)
        self.progress = {"state": "reading", "percent": 5, "message": path}
        if self.reader is None:
            found = sources.from_text_files(spark, path).drop("file")
        else:
            found = sources.from_binary(spark, path, self.reader, "*")
        found = found.withColumn("processed_text", F.lit(None).cast("string"))
        spark.sparkContext.setJobGroup("import", path, True)
        self.progress = {"state": "extracting", "percent": 15, "message": path}
        self.workspace.ingest(found, mode)
        self._imported = found.select("document_id").distinct()
        outcome = self.outcomes()
        self.progress = {"state": "complete", "percent": 100, "message": "; ".join(o["message"] for o in outcome["documents"]) + "; ..." * (outcome["next"] is not None)}
        return outcome

    def outcomes(self, after: int | None = None) -> dict:
        """Outcomes of the last import's documents, by id; next is the id to go on after, None at the end."""
        if self._imported is None:
            return {"documents": [], "next": None}
        own = relational.page_outcomes(self.pages.join(self._imported, "document_id", "left_semi"))
        rows, more = self._after(own, "document_id", after)
        return {"documents": [r.asDict() for r in rows], "next": more}

    @staticmethod
    def _after(rows: DataFrame, key: str, after) -> tuple[list, object]:
        """The next MOST_ROWS rows by a key, and the key to go on after (None at the end)."""
        if after is not None:
            rows = rows.where(F.col(key) > after)
        found = rows.orderBy(key).limit(MOST_ROWS + 1).collect()
        return found[:MOST_ROWS], found[MOST_ROWS - 1][key] if len(found) > MOST_ROWS else None

    def add_later(self, path: str, layout: str = "auto", done: Callable[[dict | None, Exception | None], None] | None = None) -> threading.Thread:
        """add() on a thread of its own; done gets its result or what went wrong."""

        def run() -> None:
            try:
                result, error = self.add(path, layout), None
            except Exception as e:  # handed to the caller
                result, error = None, e
                self.progress = {"state": "failed", "percent": 100, "message": repr(e)}
            if done:
                done(result, error)

        self._job = threading.Thread(target=run, daemon=True)
        self._job.start()
        return self._job

    def cancel(self) -> None:
        self.workspace.spark.sparkContext.cancelJobGroup("import")
        self.progress = self.progress | {"state": "cancelled"}

    def failed_pages(self, document_id: int) -> list[int]:
        if "error" not in self.pages.columns:
            return []
        # One document's page numbers.
        return [r[0] for r in self.pages.where((F.col("document_id") == document_id) & F.col("error").isNotNull()).select("page_number").orderBy("page_number").collect()]

    # ---- reading

    def status(self) -> dict:
        counts = {r.what: r.n for r in relational.statistics(self.pages.select("document_id").distinct(), self.pages, self.records).collect()}
        return counts | {"categories": self.categories.count(), "progress": self.progress}

    def document(self, document_id: int, after: int | None = None) -> dict:
        """A document and its pages, MOST_ROWS at a time; next is the page to go on after, None at the end."""
        own = self.pages.where(F.col("document_id") == document_id)
        if not own.limit(1).count():
            raise NotFound(f"no document {document_id}")
        rows, more = self._after(own.select("page_number", (F.trim(F.coalesce("raw_text", F.lit(""))) != "").alias("has_text")), "page_number", after)
        records = self.records.where(F.col("document_id") == document_id).count()
        return {"id": document_id, "page_count": own.count(), "record_count": records, "pages": [r.asDict() for r in rows], "next": more}

    def page_text(self, document_id: int, number: int) -> dict:
        row = relational.page(self.pages, document_id, number).first()
        if row is None:
            raise NotFound(f"no page {number} of document {document_id}")
        return {"page_number": number, "raw_text": row.raw_text or "", "processed_text": row.processed_text or ""}

    def search(self, document_id: int, query: str, scope: str = "all") -> dict:
        if not query.strip():
            return {"query": "", "total_matches": 0, "page_counts": {}, "results": []}
        hits = search.find(self.records, self.pages, self.categories, query, document_id=document_id, scope=scope, index=self.index)
        return search.envelope(hits, query, scope)

    def suggestions(self, document_id: int, query: str, limit: int = 5) -> list[str]:
        hits = search.find(self.records, self.pages, self.categories, query, document_id=document_id, limit=limit, index=self.index)
        return [r[0] for r in search.suggestions(hits, limit).collect()]

    def highlights(self, document_id: int, number: int, query: str) -> dict:
        if not query.strip():
            return {"boxes": []}
        own = (F.col("document_id") == document_id) & (F.col("page_number") == number)
        boxes = self._table("boxes", "document_id bigint, page_number int, text string, x0 double, y0 double, x1 double, y1 double, block_type string").where(own)
        records = self.records.where(own)
        if "bbox" not in records.columns:
            records = records.withColumn("bbox", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"))
        found = search.highlight_boxes(boxes, records, query).orderBy("y0", "x0").collect()  # of one page
        return {"boxes": [[r.x0, r.y0, r.x1, r.y1] for r in found]}

    def records_of(self, document_id: int | None = None, category_id: int | None = None, offset: int = 0) -> dict:
        rows = relational.of_document(self.records, document_id, category_id, limit=MOST_ROWS, offset=offset)
        named = relational.with_category(rows, self.categories).orderBy("page_number", "id").select("id", "page_number", "category_id", "category_name", "data").collect()
        if self._fields[0] != self.workspace.number:  # worked out once for each state of the tables
            self._fields = self.workspace.number, export.fields(self.records)
        return {"records": [r.asDict() for r in named], "fields": self._fields[1]}

    # ---- changing

    def update_record(self, record_id: int, changes: dict) -> dict:
        """Puts the given fields over a record's."""
        found = self.records.where(F.col("id") == record_id).select("document_id").first()
        if found is None:
            raise NotFound(f"no record {record_id}")
        payload = self.workspace.spark.createDataFrame([(record_id, {k: str(v) for k, v in changes.items()})], "id bigint, payload map<string,string>")
        self.workspace.edit([found[0]], records=lambda old: relational.overlay(old, payload).select(*old.columns))
        return {"success": True, "id": record_id}

    def export(self, kind: str, path: str | None = None) -> str:
        """A file of all records; without a path a temporary one of the driver's."""
        path = path or str(Path(tempfile.mkdtemp()) / f"records.{kind}")
        return export.export(self.records, self.categories, path, kind)


_ROUTES = [
    ("GET", r"/api/status", lambda s, m, q, body: s.status()),
    ("POST", r"/api/upload", lambda s, m, q, body: s.add(body["path"], body.get("layout", "auto"))),
    ("GET", r"/api/documents/(-?\d+)", lambda s, m, q, body: s.document(int(m[1]), int(q["after"]) if q.get("after") else None)),
    ("GET", r"/api/documents/(-?\d+)/pages/(\d+)/text", lambda s, m, q, body: s.page_text(int(m[1]), int(m[2]))),
    ("GET", r"/api/documents/(-?\d+)/pages/(\d+)/highlights", lambda s, m, q, body: s.highlights(int(m[1]), int(m[2]), q.get("q", ""))),
    ("GET", r"/api/documents/(-?\d+)/search", lambda s, m, q, body: s.search(int(m[1]), q.get("q", "").strip(), q.get("scope", "all"))),
    ("GET", r"/api/documents/(-?\d+)/suggestions", lambda s, m, q, body: s.suggestions(int(m[1]), q.get("q", ""))),
    ("GET", r"/api/documents/(-?\d+)/records", lambda s, m, q, body: s.records_of(int(m[1]), int(q["category_id"]) if q.get("category_id") else None, int(q.get("offset", 0)))),
    ("POST", r"/api/records/(-?\d+)", lambda s, m, q, body: s.update_record(int(m[1]), body)),
    ("GET", r"/api/documents/(-?\d+)/export/(\w+)", lambda s, m, q, body: Path(s.export(m[2]))),
]


def answer(service: Service, method: str, target: str, body: dict | None = None) -> tuple[int, dict | Path]:
    """Status and result of one request: a JSON object, or a file to send."""
    parts = urlsplit(target)
    asked = {k: v[0] for k, v in parse_qs(parts.query).items()}
    for own, pattern, call in _ROUTES:
        if own == method and (m := re.fullmatch(pattern, unquote(parts.path))):
            try:
                return 200, call(service, m, asked, body or {})
            except NotFound as e:
                return 404, {"error": str(e)}
            except (ValueError, KeyError) as e:
                return 400, {"error": str(e)}
    return 404, {"error": "no such call"}


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server on a thread of its own; port 0 takes a free one (server_address tells which)."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, method: str) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            if n > sources.MOST_BYTES:
                code, result = 413, {"error": "too large"}
            elif method == "GET" and urlsplit(self.path).path == "/":
                code, result = 200, {"calls": [f"{m} {p}" for m, p, _ in _ROUTES]}
            else:
                try:
                    body = json.loads(self.rfile.read(n)) if n else {}
                except ValueError:
                    body = None
                code, result = answer(service, method, self.path, body) if isinstance(body, dict) else (400, {"error": "a JSON object is expected"})
            data = result.read_bytes() if isinstance(result, Path) else json.dumps(result, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/octet-stream" if isinstance(result, Path) else "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._send("GET")

        def do_POST(self) -> None:
            self._send("POST")

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
