"""Limits and sizes: option values, checked when a plan is built."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields

from .. import errors as E

MAX_SAFE = 2**53 - 1
_UNITS = {"": 1, "b": 1} | {u: 1000**k for k, u in enumerate(("kb", "mb", "gb", "tb"), 1)} | {u: 1024**k for k, u in enumerate(("kib", "mib", "gib", "tib"), 1)}


def parse_size(value: int | float | str) -> int:
    """Bytes of a number or of a text as ``1.5 kib``; decimal units count 1000, binary ones 1024 (tib is 2 ** 40)."""
    if isinstance(value, str):
        got = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)", value.strip(), re.I) if len(value) <= 64 else None
        if not got or got[2].lower() not in _UNITS:
            raise E.InvalidInputError(f"not a size: {value[:64]!r}")
        value = float(got[1]) * _UNITS[got[2].lower()] if "." in got[1] else int(got[1]) * _UNITS[got[2].lower()]
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        raise E.InvalidInputError(f"not a size: {value!r}")
    size = math.floor(value)
    if size > MAX_SAFE:
        raise E.InvalidInputError(f"size {size} is too large")
    return size


@dataclass(frozen=True)
class Limits:
    """Ceilings; a value may reach its ceiling, not exceed it."""

    max_archive_size: int = 512 * 2**20
    max_files: int = 10_000
    max_total_size: int = 2 * 2**30
    max_entry_size: int = 512 * 2**20
    max_depth: int = 128
    max_compression_ratio: float = 100.0

    def __post_init__(self) -> None:
        for name in ("max_files", "max_depth"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int) or v < 0:
                raise E.InvalidInputError(f"{name} must be a whole number of at least 0")
        ratio = self.max_compression_ratio
        if isinstance(ratio, bool) or not isinstance(ratio, (int, float)) or not math.isfinite(ratio) or ratio <= 0:
            raise E.InvalidInputError("max_compression_ratio must be a finite number above 0")


DEFAULT_LIMITS = Limits()


def resolve_limits(**given) -> Limits:
    """Limits from options; sizes may be texts, None keeps the default."""
    known = {f.name for f in fields(Limits)}
    if unknown := set(given) - known:
        raise E.InvalidInputError(f"unknown limits: {sorted(unknown)}")
    return Limits(**{k: parse_size(v) if k.endswith("_size") else v for k, v in given.items() if v is not None})


def check_file_count(count: int, limits: Limits) -> None:
    if count > limits.max_files:
        raise E.FileCountExceededError(f"{count} entries, {limits.max_files} allowed")


def check_entry_size(path: str, size: int, limits: Limits) -> None:
    if size > limits.max_entry_size:
        raise E.EntrySizeExceededError(f"{size} bytes, {limits.max_entry_size} allowed", entry_path=path)


def check_total_size(total: int, limits: Limits) -> None:
    if total > limits.max_total_size:
        raise E.TotalSizeExceededError(f"{total} bytes in all, {limits.max_total_size} allowed")


def check_compression_ratio(total: int, archive_size: int, limits: Limits) -> None:
    if archive_size > 0 and total / archive_size > limits.max_compression_ratio:
        raise E.CompressionRatioExceededError(f"ratio {total / archive_size:.1f}, {limits.max_compression_ratio} allowed")
