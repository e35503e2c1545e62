"""Sinks: a tree of files, all or nothing, and tables."""

from __future__ import annotations

import errno
import os
import shutil
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import errors as E

_PREFIX = ".tarnhold-"


def check_output(folder: str, overwrite: bool) -> None:
    """A folder that is there must be empty unless it may be replaced; a link or a file never may."""
    if os.path.islink(folder):
        raise E.OutputIsSymlinkError(f"output is a link: {folder}")
    if os.path.isfile(folder):
        raise E.OutputIsFileError(f"output is a file: {folder}")
    if os.path.isdir(folder) and os.listdir(folder) and not overwrite:
        raise E.OutputExistsError(f"output is not empty: {folder}")


def _write_rows(rows, staging: str) -> None:
    """Regular files of a partition, each made new, never through a link."""
    for r in rows:
        target = os.path.join(staging, *r.normalized.split("/"))
        os.makedirs(os.path.dirname(target), mode=0o755, exist_ok=True)
        if os.path.lexists(target):  # a task that ran before, perhaps on an executor that was lost
            os.unlink(target)
        fd = os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL | getattr(os, "O_NOFOLLOW", 0), 0o600)
        with os.fdopen(fd, "wb") as f:
            f.write(r.body or b"")
        os.chmod(target, r.mode)
        if r.mtime is not None:
            os.utime(target, (r.mtime.timestamp(),) * 2)


def _drop(staging: str) -> None:
    if os.path.basename(staging).startswith(_PREFIX) and not os.path.islink(staging):
        shutil.rmtree(staging, ignore_errors=True)


def _held(staging: str, folder: str, target: str) -> None:
    """Raises if a target that is there lies, after all links on its way, outside the tree."""
    if os.path.exists(target):
        real, root = os.path.realpath(target), os.path.realpath(staging)
        if real != root and not real.startswith(root + os.sep):
            raise E.LinkEscapeError(f"link leaves {folder}: {os.path.relpath(target, staging)}")


def _put_symlink(staging: str, folder: str, row, fallback: str, said: list[dict]) -> None:
    at = os.path.join(staging, *row.normalized.split("/"))
    os.makedirs(os.path.dirname(at), mode=0o755, exist_ok=True)
    target = os.path.join(os.path.dirname(at), row.link_target)
    _held(staging, folder, target)
    try:
        os.symlink(row.link_target, at)
    except PermissionError:
        if fallback == "error":
            raise
        if fallback == "hardlink":
            os.link(target, at)
        said.append({"entry_index": row.entry_index, "code": f"symlink_fallback_{fallback}", "entry_path": row.normalized})
    else:
        if row.mtime is not None:
            os.utime(at, (row.mtime.timestamp(),) * 2, follow_symlinks=False)


def write_tree(rows: DataFrame, folder: str, overwrite: bool = False, concurrency: int = 8, symlink_fallback: str = "error", before_commit=None) -> list[dict]:
    """Writes rows of one archive (path, normalized, type, mode, mtime, link_target, body) below ``folder``.

    Executors write into a folder beside the output, which both must share; it is renamed when everything is there, so
    the output has all or nothing.  Of equal paths the last entry counts.  A link's target must stay inside also after
    the links on its way.  Where the system refuses symlinks, ``symlink_fallback`` makes hardlinks or skips them; the
    warnings of that are returned.  ``before_commit`` is called when everything is written and may raise.
    """
    if symlink_fallback not in ("error", "hardlink", "skip"):
        raise E.InvalidInputError("symlink_fallback must be error, hardlink or skip")
    said: list[dict] = []
    folder = os.path.abspath(folder)
    check_output(folder, overwrite)
    staging = os.path.join(os.path.dirname(folder), f"{_PREFIX}{uuid.uuid4().hex}.tmp")
    os.makedirs(staging, mode=0o700)
    try:
        last = rows.groupBy("normalized").agg(F.max_by(F.struct("type", "mode", "mtime", "link_target", "body", "entry_index"), "entry_index").alias("e")).select("normalized", "e.*")
        files = last.where("type = 'file'").repartition(concurrency, "normalized")
        files.foreachPartition(lambda part: _write_rows(part, staging))
        dirs = last.where("type = 'directory'").select("normalized", "mode", "mtime")
        for r in dirs.toLocalIterator():
            os.makedirs(os.path.join(staging, *r.normalized.split("/")), mode=0o755, exist_ok=True)
        links = last.where("type IN ('symlink', 'hardlink')").select("normalized", "type", "link_target", "mtime", "entry_index").orderBy("entry_index")
        waiting = []
        for r in links.toLocalIterator():
            if r.type == "symlink":
                _put_symlink(staging, folder, r, symlink_fallback, said)
            else:
                at = os.path.join(staging, *r.normalized.split("/"))
                os.makedirs(os.path.dirname(at), mode=0o755, exist_ok=True)
                waiting.append((os.path.join(staging, *r.link_target.split("/")), at))
        while waiting:  # a link may lead to another one
            ready = [(a, b) for a, b in waiting if os.path.lexists(a)]
            if not ready:
                raise E.HardlinkTargetMissingError(f"hardlink without target: {waiting[0][1]}")
            for a, b in ready:
                _held(staging, folder, a)
                os.link(a, b, follow_symlinks=False)
            waiting = [w for w in waiting if w not in ready]
        deepest = F.size(F.split("normalized", "/"))
        for r in dirs.orderBy(deepest.desc(), "normalized").toLocalIterator():  # the deepest first
            at = os.path.join(staging, *r.normalized.split("/"))
            if r.mtime is not None:
                os.utime(at, (r.mtime.timestamp(),) * 2)
            os.chmod(at, r.mode)
        os.chmod(staging, 0o755)
        if before_commit:
            before_commit()
        _commit(staging, folder)
        return said
    finally:
        _drop(staging)


def _commit(staging: str, folder: str) -> None:
    """Puts the tree in place; what was there comes back if that fails."""
    backup = None
    try:
        if os.path.isdir(folder):
            backup = os.path.join(os.path.dirname(folder), f"{_PREFIX}{uuid.uuid4().hex}.old")
            os.rename(folder, backup)
        os.rename(staging, folder)
    except OSError as e:
        if backup and not os.path.exists(folder):
            os.rename(backup, folder)
            backup = None
        kind = E.CrossDeviceRenameError if e.errno == errno.EXDEV else E.AtomicityError
        raise kind(f"could not put {folder} in place: {e}") from e
    finally:
        if backup:
            _drop(backup)


def write_table(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Any relation as Parquet; the commit protocol makes it all or nothing."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(folder)


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "body"])).alias("value"))
