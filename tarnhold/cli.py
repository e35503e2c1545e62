"""Command line: ``python -m tarnhold extract|list|audit ARCHIVE``.  Exit 0: done, 1: failed or high risk, 2: bad usage, 130: interrupted."""

from __future__ import annotations

import argparse
import json
import re
import sys

from . import api
from . import errors as E
from . import __version__

_KNOWN = re.compile(r"\.(zip|tar|tar\.gz|tgz|tar\.bz2|tbz2?|tar\.zst|tzst)\Z", re.I)


def default_output(archive: str) -> str:
    """The archive's name without its known extension, else ``output``."""
    name = archive.rsplit("/", 1)[-1]
    return _KNOWN.sub("", name) if _KNOWN.search(name) and _KNOWN.sub("", name) else "output"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tarnhold", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=__version__)
    p.add_argument("command", choices=["extract", "list", "audit"])
    p.add_argument("archive")
    p.add_argument("output", nargs="?")
    p.add_argument("-s", "--strip", type=int, default=0)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--duplicates", choices=["error", "skip", "overwrite"], default="error")
    p.add_argument("--allow-symlinks", action="store_true")
    p.add_argument("--allow-hardlinks", action="store_true")
    p.add_argument("--preserve-permissions", action="store_true")
    p.add_argument("--concurrency", type=int, default=8)
    for name in ("max-files", "max-depth"):
        p.add_argument(f"--{name}", type=int)
    for name in ("max-archive-size", "max-total-size", "max-entry-size"):
        p.add_argument(f"--{name}")
    p.add_argument("--max-compression-ratio", type=float)
    p.add_argument("--pretty", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    limits = {k: v for k, v in vars(a).items() if k.startswith("max_") and v is not None}
    show = lambda x: print(json.dumps(x, default=str, ensure_ascii=False, indent=2 if a.pretty else None))
    try:
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tarnhold").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        if a.command == "list":
            if limits.keys() - {"max_files", "max_archive_size"}:
                raise E.InvalidInputError("a listing has the limits max-files and max-archive-size alone")
            rows = api.list_archive(spark, a.archive, on_warning=lambda w: print(json.dumps(w), file=sys.stderr), **limits)
            show([r.asDict() for r in rows.orderBy("archive_id", "entry_index").toLocalIterator()])
            return 0
        if a.command == "audit":
            reports = api.audit_archive(spark, a.archive, allow_symlinks=a.allow_symlinks, allow_hardlinks=a.allow_hardlinks, **limits).as_dicts()
            show(reports)
            return int(any(r["risk_level"] in ("high", "critical") for r in reports))
        out = a.output or default_output(a.archive)
        got = api.extract(spark, a.archive, out, overwrite=a.overwrite, strip=a.strip, duplicates=a.duplicates, allow_symlinks=a.allow_symlinks, allow_hardlinks=a.allow_hardlinks, preserve_permissions=a.preserve_permissions, concurrency=a.concurrency, **limits)
        print(f"{got.entries.count()} entries, {got.total_bytes} bytes in {out}", file=sys.stderr)
        return 0
    except KeyboardInterrupt:
        return 130
    except E.InvalidInputError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    except E.ArchiveError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
