"""The sentences table on disk: batches in folders of their own, and a ledger that says which of them count.

    table/schema.json        columns the table was made with
    table/data/<folder>/      files of one batch
    table/ledger/            rows of LEDGER; the last one of a batch holds
    table/rejects/           documents that were refused, with reasons
    table/claims/            one empty file for each split number that a writer took, so no two take one
    table/staged/<folder>/    documents of a batch that is being added
    table/index/<folder>/     postings of a batch's sentences, where the table is indexed

A batch counts once its ledger row is there, and the row is written after its files: a run that dies leaves a folder that no
reader sees. A batch is known by a hash of its documents, so the same one is never taken twice.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..errors import EngineError, InvalidDocument, SchemaMismatch
from ..functions.arrow import bounded_reads
from ..functions.numbering import numbered
from ..schema import LEDGER, SENTENCES, ddl, strict
from ..operators import postings
from . import annotated

BATCH_DOCS = 67_000
SPLIT_SENTENCES = 500_000
GRACE_S, STAGED_GRACE_S = 120, 24 * 3600
KEPT_ERRORS = 100
#: Documents whose sums are hashed together, and paths of a batch that are broadcast at most.
HASHED, BROADCAST_PATHS = 1 << 17, 1 << 20


@dataclass
class IngestStats:
    documents: int = 0
    sentences: int = 0
    rejected: int = 0
    batches: int = 0
    known_batches: int = 0
    empty_batches: int = 0
    indexed_batches: int = 0
    splits: int = 0
    lanes: int = 0
    stopped: int = 0
    read_s: float = 0.0
    write_s: float = 0.0
    index_s: float = 0.0
    commit_s: float = 0.0
    total_s: float = 0.0
    errors: list[tuple[str, str]] = field(default_factory=list)

    def absorb(self, other: IngestStats) -> None:
        for f in fields(self):
            mine, new = getattr(self, f.name), getattr(other, f.name)
            setattr(self, f.name, max(mine, new) if f.name in ("lanes", "stopped") else mine + new)
        del self.errors[KEPT_ERRORS:]


@dataclass(frozen=True)
class Summary:
    splits: int
    sentences: int
    bytes: int


@dataclass(frozen=True)
class GcReport:
    removed: tuple[str, ...]
    bytes: int
    dry_run: bool


def batch_hash(docs: DataFrame, order: str, value: str = "value", sums: str | None = None) -> str:
    """Identity of a batch of documents in order: SHA-256 of their SHA-256 sums, its first 32 digits; sums: a column that has these.

    Where order is a number from 0 on, sums of HASHED documents meet in a row; the hash of a larger batch is that of the hashes of its parts.
    """
    part = F.floor(F.col(order) / HASHED) if isinstance(docs.schema[order].dataType, T.LongType) else F.lit(0)
    each = docs.select(part.alias("part"), F.struct(F.col(order), (F.sha2(F.col(value), 256) if sums is None else F.col(sums)).alias("sum")).alias("s"))
    parts = each.groupBy("part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["sum"]), ","), 256).alias("sum"))
    got = [r["sum"] for r in sorted(parts.collect(), key=lambda r: r["part"])]
    if not got:  # of no documents
        got = [hashlib.sha256(b"").hexdigest()]
    return f"sha256-{(got[0] if len(got) == 1 else hashlib.sha256(','.join(got).encode()).hexdigest())[:32]}"


class Store:
    """A sentences table in a folder. index: fields whose postings are written with each batch."""

    def __init__(self, spark: SparkSession, path: str, index: tuple[str, ...] = ()):
        self.spark, self.path, self.index = spark, path.rstrip("/"), tuple(index)

    # ---- files

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _exists(self, name: str) -> bool:
        fs, at = self._fs(f"{self.path}/{name}")
        return fs.exists(at)

    def _folders(self) -> list[tuple[str, float, int]]:
        """Name, time of change in seconds, and bytes of each batch folder."""
        fs, at = self._fs(f"{self.path}/data")
        if not fs.exists(at):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000, fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(at)]

    # ---- table

    def ensure(self) -> None:
        """Make the table, or see that it is one of ours."""
        fs, at = self._fs(f"{self.path}/schema.json")
        if not fs.exists(at):
            try:
                out = fs.create(at, False)
                out.write(bytearray(ddl().encode()))
                out.close()
                return
            except Exception:  # another run made it just now; its columns are compared below
                if not fs.exists(at):
                    raise
        there = self.spark.read.option("wholetext", True).text(f"{self.path}/schema.json").first()[0]
        if there != ddl():
            raise SchemaMismatch(f"{self.path} was made with other columns")

    def exists(self) -> bool:
        return self._exists("schema.json")

    def drop(self) -> bool:
        """Whether there was a table to drop."""
        if not self.exists():
            return False
        fs, at = self._fs(self.path)
        return bool(fs.delete(at, True))

    def ledger(self) -> DataFrame:
        """The last row of each batch."""
        if not self._exists("ledger"):
            return self.spark.createDataFrame([], LEDGER + ", folder string")
        rows = self.spark.read.schema(LEDGER + ", folder string").option("recursiveFileLookup", "true").parquet(f"{self.path}/ledger")
        last = Window.partitionBy("batch_hash").orderBy(F.col("committed").desc())
        return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")

    def _record(self, rows: list[tuple]) -> None:
        """Append to the ledger: batch_hash, status, documents, sentences, rejected, split_id, folder. All rows are one file, there or not, in a folder of its own, so that writers don't meet."""
        names = "batch_hash string, status string, documents long, sentences long, rejected long, split_id long, folder string"
        df = self.spark.createDataFrame(rows, names).withColumn("committed", F.current_timestamp())
        df.select(*[c.split()[0] for c in LEDGER.split(", ")], "folder").coalesce(1).write.parquet(f"{self.path}/ledger/{uuid.uuid4().hex}")

    def _live(self) -> list:
        return self.ledger().where("status = 'committed'").orderBy("split_id").collect()

    def splits(self) -> list[str]:
        """Folders of the batches that count, in page order."""
        return [f"{self.path}/data/{r.folder}" for r in self._live() if r.sentences]

    def sentences(self) -> DataFrame:
        """The table as it is now. Another call sees what was added since."""
        paths = self.splits()
        return self.spark.read.schema(SENTENCES).parquet(*paths) if paths else self.spark.createDataFrame([], SENTENCES)

    def summary(self) -> Summary:
        live = {r.folder: r for r in self._live()}
        size = sum(b for name, _, b in self._folders() if name in live)
        return Summary(len(live), sum(r.sentences for r in live.values()), size)

    # ---- writing

    def _next_split(self) -> int:
        """A split number that no batch has and no other writer can take: making a file that must not be there yet claims it."""
        n = (self.ledger().agg(F.max("split_id")).first()[0] or 0) + 1
        while not self._claim(n):
            n += 1
        return n

    def _claim(self, split: int) -> bool:
        fs, at = self._fs(f"{self.path}/claims/{split}")
        try:
            fs.create(at, False).close()
            return True
        except Exception:
            if fs.exists(at):
                return False
            raise

    def _index(self, folder: str) -> None:
        """Write the postings of a batch's sentences: sorted by field and term, with bloom filters, before the batch counts."""
        rows = self.spark.read.schema(SENTENCES).parquet(f"{self.path}/data/{folder}")
        postings.write(postings.build(rows, self.index), f"{self.path}/index/{folder}")

    def build_index(self) -> int:
        """Index the batches that count and have no postings yet (made by compaction, or before the table was indexed); how many they were."""
        missing = [r.folder for r in self._live() if r.sentences and not self._exists(f"index/{r.folder}/_SUCCESS")]
        for folder in missing:
            self._index(folder)
        return len(missing)

    def postings(self) -> DataFrame | None:
        """Postings of the whole table; None if some batch has none."""
        folders = [r.folder for r in self._live() if r.sentences]
        if not folders or not all(self._exists(f"index/{f}/_SUCCESS") for f in folders):
            return None
        return self.spark.read.schema(postings.DDL).parquet(*[f"{self.path}/index/{f}" for f in folders])

    def _write(self, df: DataFrame, split_id: int) -> tuple[str, int]:
        folder = uuid.uuid4().hex
        ordered = strict(df.withColumn("split_id", F.lit(split_id).cast("long"))).sortWithinPartitions("sent_ord")
        ordered.write.option("maxRecordsPerFile", SPLIT_SENTENCES).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        return folder, self.spark.read.schema(SENTENCES).parquet(f"{self.path}/data/{folder}").count()

    def add_sentences(self, df: DataFrame, batch: str | None = None) -> IngestStats:
        """Add rows that are sentences already; none is a no-op. batch: a name under which they are taken once. Columns that the table lacks are left out."""
        self.ensure()
        if df.isEmpty():
            return IngestStats()
        if batch and self.ledger().where((F.col("batch_hash") == batch) & (F.col("status") != "deleted")).count():
            return IngestStats(known_batches=1)
        folder, n = self._write(df, split := self._next_split())
        if self.index:
            self._index(folder)
        self._record([(batch or f"rows-{folder}", "committed", 0, n, 0, split, folder)])
        return IngestStats(sentences=n, batches=1, splits=1, indexed_batches=int(bool(self.index)))

    def add_documents(self, files: DataFrame, policy: str = "fail", split: int | None = None) -> IngestStats:
        """Add one batch of files (path, value; paths are distinct). policy: fail at the first unsound document, or skip those and keep them in rejects.

        The documents are read once, into a folder of the table that goes when the batch is done; paths and sums alone are sorted and numbered.
        """
        if policy not in ("fail", "skip"):
            raise EngineError(f"unknown policy {policy!r}")
        self.ensure()
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            return self._add_staged(files, policy, split, staged)
        finally:
            fs, at = self._fs(staged)
            fs.delete(at, True)

    def _add_staged(self, files: DataFrame, policy: str, split: int | None, staged: str) -> IngestStats:
        stats, began = IngestStats(), time.monotonic()
        bounded_reads(self.spark)
        files.select("path", "value", F.sha2(F.col("value"), 256).alias("sum")).write.option("compression", "zstd").parquet(f"{staged}/documents")
        documents = self.spark.read.schema("path string, value string, sum string").parquet(f"{staged}/documents")
        places, n = numbered(documents.select("path", "sum"), ("path",), f"{staged}/places")
        if not n:
            return IngestStats(empty_batches=1)
        if not places.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            raise EngineError("two documents of a batch have one path")
        name = batch_hash(places, "place", sums="sum")
        if self.ledger().where((F.col("batch_hash") == name) & (F.col("status") != "deleted")).count():
            return IngestStats(known_batches=1)
        own = places.select("path", "place")
        placed = documents.select("path", "value").join(F.broadcast(own) if n <= BROADCAST_PATHS else own, "path")
        checked = annotated.validate(annotated.decode(placed))
        bad = annotated.rejects(checked)
        stats.errors = [tuple(r) for r in bad.orderBy("path").limit(KEPT_ERRORS).collect()]
        if stats.errors and policy == "fail":
            raise InvalidDocument(f"{stats.errors[0][0]}: {stats.errors[0][1]}")
        stats.rejected = bad.count() if stats.errors else 0
        stats.read_s = time.monotonic() - began
        began = time.monotonic()
        split = self._next_split() if split is None else split
        folder, stats.sentences = self._write(annotated.flatten(checked, split, "place"), split)
        if stats.errors:
            bad.write.parquet(f"{self.path}/rejects/batch={folder}")
        stats.write_s = time.monotonic() - began
        began = time.monotonic()
        if self.index and stats.sentences:
            self._index(folder)
            stats.indexed_batches, stats.index_s = 1, time.monotonic() - began
        began = time.monotonic()
        self._record([(name, "committed", n - stats.rejected, stats.sentences, stats.rejected, split, folder)])
        stats.commit_s = time.monotonic() - began
        stats.documents, stats.batches, stats.splits, stats.total_s = n - stats.rejected, 1, 1, stats.read_s + stats.write_s + stats.index_s + stats.commit_s
        return stats

    def add_batches(self, batches: Iterable[Callable[[], DataFrame]], policy: str = "fail", lanes: int = 1, stop=lambda: False) -> IngestStats:
        """Add batches, lanes of them at a time; each is made when a lane takes it, so no more than lanes are open.

        Split numbers are claimed in the batches' order, so pages don't depend on which lane is faster. Batches that an earlier run has
        committed are known by their documents, so a run that was stopped or died is resumed by running it again. stop() is asked before
        each batch. The first error stops the lanes after the batches that they are in, and is raised then.
        """
        self.ensure()
        stats, failed = IngestStats(lanes=lanes), []

        def lane(batch: Callable[[], DataFrame], split: int) -> IngestStats:
            if failed or stop():
                return IngestStats(stopped=1)
            try:
                return self.add_documents(batch(), policy, split)
            except Exception as e:
                failed.append(e)
                raise

        with ThreadPoolExecutor(lanes) as pool:
            running = []
            for batch in batches:
                while len(running) >= lanes:
                    stats.absorb(running.pop(0).result())
                if failed or stop():
                    stats.stopped = 1
                    break
                running.append(pool.submit(lane, batch, self._next_split()))
            for r in running:
                stats.absorb(r.result())
        return stats

    def add_folder(self, folder: str, limit: int | None = None, batch_docs: int = BATCH_DOCS, policy: str = "fail", stop=lambda: False, lanes: int = 1) -> IngestStats:
        """Add all documents under folder in batches of batch_docs files, in order of path, lanes of them at a time."""
        paths = annotated.list_files(self.spark, folder, limit)
        batch = lambda at: lambda: annotated.read_files(self.spark, paths[at : at + batch_docs])
        return self.add_batches([batch(at) for at in range(0, len(paths), batch_docs)], policy, lanes, stop)

    # ---- upkeep

    def compact(self, target: int = SPLIT_SENTENCES) -> int:
        """Rewrite batches of fewer than target sentences into splits of about that many, in page order; how many batches went in.

        The new splits and the end of the old batches are one entry in the ledger. Old batches stay known, so they aren't taken again.
        """
        small = [r for r in self._live() if r.sentences < target]
        if len(small) < 2:
            return 0
        rows, group, size = [], [], 0
        for r in [*small, None]:
            if r is None or size + r.sentences > target and group:
                if len(group) > 1:
                    rows += self._merge(group)
                group, size = [], 0
            if r is not None:
                group.append(r)
                size += r.sentences
        if rows:
            self._record(rows)
        return sum(x[1] == "replaced" for x in rows)

    def _merge(self, group: list) -> list[tuple]:
        split, n = group[0].split_id, sum(r.sentences for r in group)
        paths = [f"{self.path}/data/{r.folder}" for r in group if r.sentences]
        folder = uuid.uuid4().hex
        merged = self.spark.read.schema(SENTENCES).parquet(*paths) if paths else self.spark.createDataFrame([], SENTENCES)
        # Places go on in page order: those of a split come after the last one of the splits before it.
        last = {r["split_id"]: r["last"] for r in merged.groupBy("split_id").agg(F.max("sent_ord").alias("last")).collect()}
        base, before = {}, 0
        for r in sorted(group, key=lambda r: r.split_id):
            base[r.split_id], before = before, before + last.get(r.split_id, -1) + 1
        offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in base.items() for x in pair]), F.col("split_id"))
        merged = merged.withColumn("sent_ord", offset + F.col("sent_ord")).withColumn("split_id", F.lit(split).cast("long"))
        # Small files are read together, and each task's rows become sorted files: rows are never shuffled, which would take several times the table's size.
        merged.sortWithinPartitions("sent_ord").write.option("maxRecordsPerFile", SPLIT_SENTENCES).option("compression", "zstd").parquet(f"{self.path}/data/{folder}")
        if self.index:
            self._index(folder)
        return [(f"merged-{folder}", "committed", sum(r.documents for r in group), n, 0, split, folder), *[(r.batch_hash, "replaced", r.documents, r.sentences, r.rejected, r.split_id, r.folder) for r in group]]

    def collect_garbage(self, grace_s: float = GRACE_S, staged_grace_s: float = STAGED_GRACE_S, dry_run: bool = False) -> GcReport:
        """Remove folders of replaced batches older than grace_s, and of runs that never committed older than staged_grace_s."""
        known = {r.folder: r.status for r in self.ledger().collect()}
        now = time.time()
        gone = [(name, size) for name, changed, size in self._folders() if known.get(name) != "committed" and now - changed > (grace_s if name in known else staged_grace_s)]
        for name, _ in [] if dry_run else gone:
            for part in ("data", "index"):
                fs, at = self._fs(f"{self.path}/{part}/{name}")
                fs.delete(at, True)
        return GcReport(tuple(name for name, _ in gone), sum(s for _, s in gone), dry_run)

