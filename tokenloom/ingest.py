"""python -m tokenloom.ingest FOLDER TABLE: annotated documents into a sentences table.

Exit codes: 0 done, 1 an error, 2 done but some documents were refused, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .sources.store import BATCH_DOCS, GRACE_S, Store


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tokenloom.ingest", description="Annotated documents into a sentences table.")
    p.add_argument("folder")
    p.add_argument("table")
    p.add_argument("--limit", type=int, help="at most so many files, in order of path")
    p.add_argument("--batch-docs", type=int, default=BATCH_DOCS)
    p.add_argument("--skip-invalid", action="store_true", help="keep refused documents apart and go on")
    p.add_argument("--recreate", action="store_true", help="drop the table first")
    p.add_argument("--compact", action="store_true", help="merge small splits afterwards")
    p.add_argument("--gc", action="store_true", help="remove files that no longer count")
    p.add_argument("--gc-grace", type=float, default=GRACE_S)
    p.add_argument("--dry-run", action="store_true", help="with --gc: only say what would go")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    try:
        spark = spark or SparkSession.builder.appName("tokenloom-ingest").getOrCreate()
        store = Store(spark, a.table)
        if a.recreate:
            store.drop()
        stats = store.add_folder(a.folder, a.limit, a.batch_docs, "skip" if a.skip_invalid else "fail")
        print(f"{stats.documents} documents, {stats.sentences} sentences, {stats.rejected} refused, {stats.batches} batches, {stats.known_batches} known before")
        for path, error in stats.errors:
            print(f"refused {path}: {error}", file=sys.stderr)
        if a.compact:
            print(f"{store.compact()} splits merged")
        if a.gc:
            report = store.collect_garbage(a.gc_grace, dry_run=a.dry_run)
            print(f"{len(report.removed)} folders, {report.bytes} bytes {'would go' if report.dry_run else 'removed'}")
        return 2 if stats.rejected else 0
    except KeyboardInterrupt:
        return 130
    except (EngineError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
