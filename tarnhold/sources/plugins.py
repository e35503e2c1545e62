"""Sources that a caller adds: a callable from bytes to records, wrapped in the same reader as the known formats."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from .. import errors as E


@dataclass(frozen=True)
class Plugin:
    """``parse(data, warn)`` gives records (dicts with path, type, source_format ...); ``detect(peek)`` claims an archive."""

    name: str
    parse: Callable[[bytes, Callable[[str, str], None]], Iterable[dict]]
    formats: tuple[str, ...] = ()
    detect: Callable[[bytes], bool] | None = None
    legacy: bool = False


def _claims(plugin: Plugin, peek: bytes) -> bool:
    try:
        return bool(plugin.detect and plugin.detect(peek))
    except Exception:  # a detector that fails does not claim
        return False


def pick(plugins: list[Plugin], fmt: str | None, peek: bytes, legacy_allowed: bool = False) -> Plugin | None:
    """The plugin for an archive: the first that claims it, else the first of its format, else the only one, whatever it
    names; None if there is none or several and none fits."""
    if any(p.legacy for p in plugins) and not legacy_allowed:
        raise E.LegacyPluginNotEnabledError("a legacy plugin must be allowed")
    for p in plugins:
        if _claims(p, peek):
            return p
    for p in plugins:
        if fmt and fmt in p.formats:
            return p
    return plugins[0] if len(plugins) == 1 else None


def legacy(name: str, unpack: Callable[[bytes], list[dict]], **more) -> Plugin:
    """An older plugin: it gives all files at once (path, type, mode, mtime, linkname, data); unknown types are files."""
    kinds = {"file": "file", "directory": "directory", "symlink": "symlink", "link": "hardlink"}

    def parse(data: bytes, warn: Callable[[str, str], None]) -> Iterable[dict]:
        warn("legacy_plugin_used", f"plugin {name} has the older interface")
        for f in unpack(data):
            body = f.get("data")
            yield {"path": f.get("path"), "type": kinds.get(f.get("type"), "file"), "mode": f.get("mode") or 0, "mtime": f.get("mtime"), "link_target": f.get("linkname"), "size": len(body) if body is not None else 0, "body": body, "source_format": name}

    return Plugin(name, parse, legacy=True, **more)
