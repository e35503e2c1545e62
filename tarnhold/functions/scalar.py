"""The same rules for single values, in plain Python: the public helpers, and the model that tests compare plans with."""

from __future__ import annotations

import re
import sys
import unicodedata

from .. import errors as E
from .limits import DEFAULT_LIMITS, Limits

WINDOWS_DEVICE_RE = re.compile(r"(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|\Z)", re.I)
WINDOWS_ADS_RE = re.compile(r":[^/\\]")
_SPACE = "\t\n\x0b\x0c\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def detect_platform() -> str:
    return "windows" if sys.platform == "win32" else "posix"


def _segments(path: str) -> list[str]:
    return re.split(r"[\\/]", path)


def strip_dot_segments(path: str) -> str:
    parts = _segments(path)
    return "/".join(s for s in parts if s != ".") if "." in parts else path


def path_error_code(path: str, limits: Limits = DEFAULT_LIMITS, platform: str = "posix") -> str | None:
    p = path if "\\" in path else strip_dot_segments(path)
    if "\0" in path:
        return "PATH_NUL_BYTE"
    if not p.strip(_SPACE) or any(ord(c) < 32 for c in p) or "%" in p:
        return "PATH_POLICY_VIOLATION"
    if p[:1] == "/" or re.match("[A-Za-z]:", p) or p[:2] == "\\\\":
        return "PATH_ABSOLUTE"
    if WINDOWS_ADS_RE.search(p):
        return "PATH_WINDOWS_ADS"
    parts = _segments(p)
    for s in parts:
        if re.search(r'[<>"|?*]', s):
            return "PATH_POLICY_VIOLATION"
        if WINDOWS_DEVICE_RE.match(s):
            return "PATH_WINDOWS_DEVICE"
    if ".." in parts:
        return "PATH_TRAVERSAL"
    if any(s.endswith((".", " ")) for s in parts):
        return "PATH_WINDOWS_TRAILING_DOTS"
    if "/" in p and "\\" in p or platform == "posix" and "\\" in p or "//" in p or "\\\\" in p or p.endswith(("/", "\\")):
        return "PATH_POLICY_VIOLATION"
    if len(parts) > limits.max_depth:
        return "LIMIT_DEPTH"
    return "PATH_POLICY_VIOLATION" if len(p.encode("utf-16-le", "surrogatepass")) // 2 > 4096 else None


def validate_path(path: str, limits: Limits = DEFAULT_LIMITS, platform: str = "posix") -> None:
    if code := path_error_code(path, limits, platform):
        raise E.from_code(code, f"unsafe path {path!r}", entry_path=path)


def normalize_path(path: str) -> str:
    stack: list[str] = []
    for s in unicodedata.normalize("NFC", path).replace("\\", "/").split("/"):
        if s == "..":
            if not stack:
                raise E.PathTraversalError(f"path climbs out: {path!r}", entry_path=path)
            stack.pop()
        elif s not in ("", "."):
            stack.append(s)
    if not stack:
        raise E.PathPolicyError(f"nothing left of path {path!r}", entry_path=path)
    return "/".join(stack)


def is_inside_output(target: str, root: str) -> bool:
    import posixpath

    return posixpath.commonpath([posixpath.abspath(target), posixpath.abspath(root)]) == posixpath.abspath(root)


def check_duplicate(seen: set[str], normalized: str, policy: str = "error") -> str:
    """new, skip or overwrite; raises under ``error``."""
    if normalized not in seen:
        seen.add(normalized)
        return "new"
    if policy == "error":
        raise E.DuplicatePathError(f"path occurs twice: {normalized!r}", entry_path=normalized)
    return policy


def check_case_collision(folded: dict[str, str], normalized: str, case_insensitive: bool, policy: str = "error") -> str:
    """As ``check_duplicate``, against the first spelling of the same letters."""
    if not case_insensitive:
        return "new"
    first = folded.setdefault(normalized.lower(), normalized)
    if first == normalized:
        return "new"
    if policy == "error":
        raise E.CaseCollisionError(f"{normalized!r} and {first!r} differ in case alone", entry_path=normalized)
    return policy


def sanitize_mode(mode: int | None, kind: str, preserve: bool = False, umask: int = 0o022) -> int:
    given = (0o755 if kind == "directory" else 0o644) if mode is None else mode
    low = given & 0o777
    if not preserve:
        low &= 0o755 if kind == "directory" or given & 0o111 else 0o644
    return low & ~umask & 0o777


def link_escapes(path: str, target: str, kind: str) -> bool:
    if "\0" in target or target[:1] in ("/", "\\") or re.match("[A-Za-z]:", target):
        return True
    at = ["output"]
    parent = path.replace("\\", "/").split("/")[:-1] if kind == "symlink" else []
    for s in parent + target.replace("\\", "/").split("/"):
        if s == "..":
            at = at[:-1]
        elif s not in ("", "."):
            at.append(s)
    return at[:1] != ["output"]


def validate_symlink_target(path: str, target: str, allowed: bool) -> None:
    if not allowed:
        raise E.SymlinkRefusedError(f"symlinks are refused: {path!r}", entry_path=path)
    if link_escapes(path, target, "symlink"):
        raise E.LinkEscapeError(f"symlink leaves the output: {path!r}", entry_path=path)


def validate_hardlink_target(path: str, target: str, allowed: bool, existing: set[str]) -> None:
    if not allowed:
        raise E.HardlinkRefusedError(f"hardlinks are refused: {path!r}", entry_path=path)
    if link_escapes(path, target, "hardlink"):
        raise E.LinkEscapeError(f"hardlink leaves the output: {path!r}", entry_path=path)
    if normalize_path(target) not in existing:
        raise E.HardlinkTargetMissingError(f"hardlink without target: {path!r}", entry_path=path)


TYPES = ("file", "directory", "symlink", "hardlink")


def _whole(v, top: int) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= top


def entry_error(entry) -> str | None:
    """What is wrong with a record of a source, else None.  Absent keys are allowed where a value is optional."""
    import datetime

    if not isinstance(entry, dict):
        return "not a record"
    for name in ("path", "source_format"):
        if not isinstance(entry.get(name), str) or not entry[name]:
            return f"{name} is not a text"
    if entry.get("type") not in TYPES:
        return "unknown type"
    for name, top in (("size", 2**53 - 1), ("mode", 0o17777)):
        if entry.get(name) is not None and not _whole(entry[name], top):
            return f"{name} is out of range"
    if entry.get("mtime") is not None and not isinstance(entry["mtime"], datetime.datetime):
        return "mtime is not a time"
    target = entry.get("link_target")
    if target is not None and not isinstance(target, str) or entry["type"] in ("symlink", "hardlink") and not target:
        return "link without target"
    if entry.get("body") is not None and not isinstance(entry["body"], (bytes, bytearray)) and not callable(entry["body"]):
        return "body is not bytes"
    if entry.get("metadata") is not None and not isinstance(entry["metadata"], dict):
        return "metadata is not a record"
    return None


def validate_archive_entry(entry, index: int = 0) -> None:
    if what := entry_error(entry):
        raise E.PluginInvalidEntryError(f"entry {index}: {what}", entry_index=index)


def validate_mapped_entry(entry) -> None:
    """A record after the caller's map: path, type, size and mode; a null link target is allowed."""
    if not isinstance(entry, dict) or not isinstance(entry.get("path"), str) or not entry["path"] or entry.get("type") not in TYPES or not _whole(entry.get("size"), 2**53 - 1) or not _whole(entry.get("mode"), 0o17777):
        raise E.PluginInvalidEntryError("the mapped record is invalid")
