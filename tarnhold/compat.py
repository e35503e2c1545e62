"""The older call shape: ``expand(archive, folder, **options)`` gives rows with a link's name and the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def legacy_rows(rows: DataFrame) -> DataFrame:
    """Rows as the older interface names them; a missing time is the epoch."""
    body = F.col("body") if "body" in rows.columns else F.lit(None).cast("binary")
    return rows.select("archive_id", "entry_index", "path", "type", "mode", F.coalesce("mtime", F.timestamp_seconds(F.lit(0))).alias("mtime"), "size", F.col("link_target").alias("linkname"), body.alias("data"))


def expand(spark: SparkSession, archive: str | bytes, folder: str | None = None, *, strip: int = 0, filter=None, map=None, max_in_memory: int | str = "256mib", on_entry=None, **more) -> list[dict]:
    """Extracts one archive and gives its rows with their data; written below ``folder`` if there is one.

    ``filter`` and ``map`` are columns, or functions over those rows: they see a file's bytes and may replace them.  The
    archive is read once; what is written are the rows in memory, through all checks again.  The ratio of compression is
    not limited here, the bytes in memory are.
    """
    from . import api
    from . import errors as E
    from .functions.limits import parse_size
    from .sources.plugins import Plugin

    called = [f for f in (filter, map) if callable(f) and not isinstance(f, Column)]
    columns = {k: f for k, f in (("filter", filter), ("map", map)) if f is not None and f not in called}
    lifted = {"max_compression_ratio": 1e300, **more}
    rows, _ = api.extract_rows(spark, archive, strip=strip, with_body=True, keep_bodies=True, **columns, **lifted)
    total = rows.agg(F.sum(F.when(F.col("type") == "file", F.length("body")))).first()[0] or 0
    if total > parse_size(max_in_memory):
        raise E.TotalSizeExceededError(f"{total} bytes in memory, {max_in_memory} allowed")
    shown = [r.asDict() for r in legacy_rows(rows).orderBy("entry_index").collect()]
    try:
        if filter in called:
            shown = [r for r in shown if filter(r)]
        if map in called:
            shown = [map(dict(r)) for r in shown]
    except Exception as e:
        raise E.UserFunctionError(f"{type(e).__name__}: {e}") from e
    if folder is not None:
        kept = {k: v for k, v in lifted.items() if k not in ("plugins", "legacy_plugins", "max_archive_size")}
        again = [{"path": r["path"], "type": r["type"], "size": len(r["data"] or b"") if r["type"] == "file" else 0, "mode": r["mode"], "mtime": r["mtime"], "link_target": r["linkname"], "source_format": "replay", "body": bytes(r["data"] or b"") if r["type"] == "file" else None} for r in shown]
        api.extract(spark, b"replay", folder, plugins=[Plugin("replay", lambda data, warn: again)], **kept)
    for r in shown:
        on_entry and on_entry(r)
    return shown
