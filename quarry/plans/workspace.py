"""A directory under analysis: its tables, keyword index and vectors in a folder, opened, ingested, changed and cleared as a whole; a new process finds what the last one left."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..operators import catalog, ingest
from ..operators import retrieval as r
from ..operators.chunking import with_keys
from ..operators.keyword import KeywordIndex
from ..operators.names import NameIndex
from ..operators.vectors import VectorIndex
from ..schemas import CHUNKS, INDEXED_DOCUMENTS
from ..session import stored
from ..sources import files, office, readers
from ..sources.ledger import BUCKETS, Change, Ledger, Snapshot
from ..streaming import events, stateful
from .engine import Corpus
from .history import Summaries

DOCUMENTS = ", ".join(c for c in INDEXED_DOCUMENTS.split(", ") if not c.startswith("last_processed"))
SCHEMAS = {"documents": DOCUMENTS, "chunks": f"{CHUNKS}, chunk_key string"}
#: Paths of a micro-batch that are opened one by one; for more the directory is listed.
LISTED = 1_000


class Outside(ValueError):
    """A path that is not in the workspace's directory."""


@dataclass
class Workspace:
    """Tables of one directory in the ledger of `folder` (a folder that all machines share).

    Every change is one commit of all it touches: documents, chunks, names, postings and vectors. It rewrites only the buckets of the files it is about; index segments are added. Two
    workspaces on one folder, in one process or two, see each other's commits and never overwrite them.
    """

    spark: SparkSession
    folder: str
    readers: dict[str, readers.Reader] = field(default_factory=dict)
    ocr: readers.Reader | None = None
    taxonomy: tuple[str, ...] = ()
    embed: Callable[[DataFrame], DataFrame] = r.hashed_vectors
    buckets: int = BUCKETS
    opening: bool = False
    stream: object = None

    def __post_init__(self):
        self.ledger = Ledger(self.spark, self.folder, self.buckets)
        self.keywords, self.vectors, self.names = KeywordIndex(self.ledger), VectorIndex(self.ledger), NameIndex(self.ledger)

    @property
    def directory(self) -> str | None:
        return self.ledger.snapshot().properties.get("directory")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.ledger.snapshot(version).table(name, SCHEMAS[name])

    def open(self, directory: str, as_of: str, resume: bool = True) -> str:
        """opened, or why not: busy (being opened already), same (the directory is open and has files), empty (no file to accept)."""
        if self.opening:
            return "busy"
        directory = posixpath.normpath(directory)
        if resume and directory == self.directory and not self.table("documents").isEmpty():
            return "same"
        self.opening = True
        try:
            if directory != self.directory:
                self.clear()
                self.ledger.change("open", lambda c: c.properties.update(directory=directory))
            scan = files.scan(self.spark, directory)
            if scan.filter("reject_reason is null").isEmpty():
                return "empty"

            def noted(change: Change) -> None:
                known = change.table("documents", DOCUMENTS)
                docs = stored(files.scan_and_upsert(known, scan.drop("content"), as_of, resume)[0], "documents")
                change.replace("documents", docs)
                self.named(change, docs, known)

            self.ledger.change("scan", noted)
            self.ingest(scan, as_of)
            return "opened"
        finally:
            self.opening = False

    def ingest(self, scan: DataFrame, as_of: str, force: bool = False) -> Snapshot:
        return self.apply("ingest", as_of, scan=scan, force=force)

    def apply(self, operation: str, as_of: str | None = None, scan: DataFrame | None = None, gone: DataFrame | None = None, force: bool = False) -> Snapshot:
        """One commit: files that are gone (file_path) leave all tables, new and changed files of a scan are read, chunked and indexed. Nothing to do is no commit.

        What has to be read is opened and hashed once and stored, so that a repeated attempt and all that is derived see the same bytes.
        """
        nothing = self.spark.createDataFrame([], "file_path string")
        gone = nothing if gone is None else gone.select("file_path").distinct()
        work = None
        if scan is not None:
            good, done = scan.filter("reject_reason is null"), self.table("documents").filter("processing_status in ('indexed', 'error')").select("file_path", "file_hash")
            work = stored(good if force else good.join(done.join(gone, "file_path", "left_anti"), ["file_path", "file_hash"], "left_anti"), "work")

        def run(change: Change) -> None:
            paths = (gone if work is None else gone.unionByName(work.select("file_path"))).distinct()
            buckets = change.touched(paths)
            if not buckets:
                return
            tables = ingest.removed({n: change.table(n, kind, buckets) for n, kind in SCHEMAS.items()}, gone)
            docs, chunks = tables["documents"], tables["chunks"]
            if work is not None:
                docs, chunks = ingest.run(docs, chunks, work, lambda rows: readers.texts(rows, self.readers, self.ocr), as_of, office.sheets, self.taxonomy, True)
            self.write(change, docs, chunks, paths, buckets)

        after = self.ledger.change(operation, run)
        self.keywords.tidy()
        return after

    def write(self, change: Change, docs: DataFrame, chunks: DataFrame, paths: DataFrame, buckets: list[str]) -> None:
        """New rows of some buckets, and what the files at `paths` have in them now instead of what they had, in the indexes."""
        chunks, docs = stored(chunks, "chunks"), stored(docs, "documents")
        change.replace("documents", docs, buckets=buckets)
        change.replace("chunks", chunks, buckets=buckets)
        of = lambda t: t.join(paths, "file_path", "left_semi").select("chunk_key", "text")
        old, new = of(change.table("chunks", SCHEMAS["chunks"], buckets)), of(chunks)
        self.keywords.update(change, new, old)
        self.vectors.update(change, self.embed(new), old)
        of = lambda t: t.join(paths, "file_path", "left_semi")
        self.named(change, of(docs), of(change.table("documents", DOCUMENTS, buckets)))

    def named(self, change: Change, docs: DataFrame, before: DataFrame) -> None:
        """The index of names after some documents have come and gone."""
        self.names.update(change, *(a.select("file_path").join(b.select("file_path"), "file_path", "left_anti") for a, b in ((docs, before), (before, docs))))

    def corpus(self, **more) -> Corpus:
        """Questions to the latest snapshot, by the stored indexes."""
        return Corpus(self.table("documents"), self.table("chunks"), self.embed, **{"taxonomy": self.taxonomy, "keywords": self.keywords, "vectors": self.vectors, "summaries": Summaries(self.ledger), **more})

    def inside(self, path: str) -> str:
        """The path, if it is in the directory."""
        path = posixpath.normpath(path)
        if self.directory is None or not path.startswith(self.directory.rstrip("/") + "/"):
            raise Outside(path)
        return path

    def remove(self, path: str) -> None:
        self.apply("remove", gone=self.spark.createDataFrame([(self.inside(path),)], "file_path string"))

    def rename(self, old: str, new: str) -> None:
        old, new = self.inside(old), self.inside(new)

        def run(change: Change) -> None:
            before = F.col("file_path") == old
            moved = change.base.table("documents", DOCUMENTS).select("file_path").filter(before | F.col("file_path").startswith(old.rstrip("/") + "/"))
            paths = moved.unionByName(ingest.rename(moved, old, new))
            if not (buckets := change.touched(paths)):
                return
            docs, chunks = (ingest.rename(change.table(n, SCHEMAS[n], buckets), old, new) for n in SCHEMAS)
            self.write(change, docs, with_keys(chunks.drop("chunk_key")), paths, buckets)

        self.ledger.change("rename", run)

    def clear(self) -> None:
        def run(change: Change) -> None:
            for name in SCHEMAS:
                if change.base.parts(name):
                    change.drop(name)
            if change.written:
                self.keywords.clear(change)
                self.vectors.clear(change)
                self.names.clear(change)

        self.ledger.change("clear", run)

    def document(self, path: str) -> DataFrame:
        return catalog.by_path(self.table("documents"), path)

    def history(self) -> DataFrame:
        return self.ledger.history()

    def autocomplete(self, prefix: str, most: int = 10) -> DataFrame:
        return self.names.autocomplete(prefix, most)

    def find(self, prefix: str, file_type: str | None = None) -> DataFrame:
        """Paths of the files whose name starts like prefix."""
        return self.names.search(prefix, file_type)

    def apply_changes(self, upserts: DataFrame, deletions: DataFrame, as_of: str) -> None:
        """A micro-batch of file events in one commit: deleted files go, others are scanned and ingested. Only the batch's files are opened (if they are more than LISTED, the directory is listed)."""
        wanted = upserts.select("file_path").distinct()
        some = [x[0] for x in wanted.filter(suffix(F.col("file_path")).isin(*ingest.EXTENSIONS)).limit(LISTED + 1).collect()]
        place = self.ledger._path
        here = [p for p in some if place(p).getFileSystem(self.ledger._conf).exists(place(p))] if len(some) <= LISTED else [self.directory]
        scan = files.scan(self.spark, here).join(wanted, "file_path", "left_semi") if here else None
        self.apply("events", as_of, scan=scan, gone=deletions)

    def watch(self, changes: DataFrame, checkpoint: str, now: Callable[[], str], once: bool = False, quiet_ms: int | None = None):
        """Starts applying a stream of file events; a running one is stopped first. With quiet_ms a path is acted on once nothing has come for so long."""
        self.stop()
        changes = events.accepted(changes)
        if quiet_ms is not None:
            changes = stateful.debounced(changes, quiet_ms).withColumnRenamed("last_ts", "ts")
        self.stream = events.ingest_stream(changes, lambda up, down: self.apply_changes(up, down, now()), checkpoint, once)
        return self.stream

    def stop(self) -> None:
        if self.stream is not None:
            self.stream.stop()
            self.stream = None

    def status(self) -> dict:
        """Readiness, progress and what the monitor does."""
        progress = catalog.progress(self.table("documents")).first().asDict()
        return {"directory": self.directory, "ready": self.directory is not None and not self.opening, "extensions": list(ingest.EXTENSIONS), "watching": self.stream is not None and self.stream.isActive, "batches": self.stream.lastProgress["batchId"] + 1 if self.stream is not None and self.stream.lastProgress else 0, **progress}

    def chunks_of(self, path: str) -> DataFrame:
        return self.table("chunks").filter(F.col("file_path") == path).orderBy("chunk_id")
