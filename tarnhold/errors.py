"""Stable error codes and the exceptions that carry them."""

from __future__ import annotations

#: Name of the exception's kind: its code.
CODES = {
    "InvalidInput": "INVALID_INPUT", "ArchiveNotFound": "ARCHIVE_NOT_FOUND", "UnknownFormat": "UNKNOWN_FORMAT", "CorruptArchive": "CORRUPT_ARCHIVE",
    "TruncatedArchive": "TRUNCATED_ARCHIVE", "PathPolicy": "PATH_POLICY_VIOLATION", "PathTraversal": "PATH_TRAVERSAL", "WindowsPath": "PATH_WINDOWS",
    "AbsolutePath": "PATH_ABSOLUTE", "NulByte": "PATH_NUL_BYTE", "WindowsDevice": "PATH_WINDOWS_DEVICE", "WindowsAds": "PATH_WINDOWS_ADS",
    "WindowsTrailingDots": "PATH_WINDOWS_TRAILING_DOTS", "DuplicatePath": "DUPLICATE_PATH", "CaseCollision": "CASE_COLLISION", "LinkPolicy": "LINK_POLICY_VIOLATION",
    "LinkEscape": "LINK_ESCAPE", "SymlinkRefused": "LINK_SYMLINK_REFUSED", "HardlinkRefused": "LINK_HARDLINK_REFUSED", "LinkThroughSymlink": "LINK_THROUGH_SYMLINK",
    "HardlinkTargetMissing": "HARDLINK_TARGET_MISSING", "PermissionPolicy": "PERMISSION_POLICY_VIOLATION", "LimitExceeded": "LIMIT_EXCEEDED",
    "ArchiveSizeExceeded": "LIMIT_ARCHIVE_SIZE", "FileCountExceeded": "LIMIT_FILE_COUNT", "TotalSizeExceeded": "LIMIT_TOTAL_SIZE", "EntrySizeExceeded": "LIMIT_ENTRY_SIZE",
    "DepthExceeded": "LIMIT_DEPTH", "CompressionRatioExceeded": "LIMIT_COMPRESSION_RATIO", "Atomicity": "ATOMICITY", "OutputExists": "ATOMIC_OUTPUT_EXISTS",
    "OutputIsSymlink": "ATOMIC_OUTPUT_IS_SYMLINK", "OutputIsFile": "ATOMIC_OUTPUT_IS_FILE", "TempDirCleanup": "ATOMIC_CLEANUP_FAILED", "CrossDeviceRename": "ATOMIC_EXDEV",
    "Abort": "ABORTED", "Plugin": "PLUGIN_ERROR", "PluginInvalidEntry": "PLUGIN_INVALID_ENTRY", "LegacyPluginNotEnabled": "LEGACY_PLUGIN_NOT_ENABLED",
    "UnsupportedFormat": "UNSUPPORTED_FORMAT", "UserFunction": "USER_FUNCTION_ERROR", "NotADirectory": "NOT_A_DIRECTORY",
}


class ArchiveError(Exception):
    """Base of all errors of this library; ``code`` is stable, the message is not."""

    code = "INVALID_INPUT"

    def __init__(self, message: str, *, entry_path: str | None = None, entry_index: int | None = None, details: dict | None = None) -> None:
        super().__init__(message)
        self.message, self.entry_path, self.entry_index, self.details = message, entry_path, entry_index, details

    def to_json(self) -> dict:
        cause = self.__cause__
        out = {"name": type(self).__name__, "code": self.code, "message": self.message, "entry_path": self.entry_path, "entry_index": self.entry_index, "cause": {"name": type(cause).__name__, "message": str(cause)} if cause else None, "details": self.details}
        return {k: v for k, v in out.items() if v is not None}


_FAMILY = {
    "PathPolicy": ["PathTraversal", "WindowsPath", "AbsolutePath", "NulByte", "DuplicatePath", "CaseCollision", "NotADirectory"],
    "WindowsPath": ["WindowsDevice", "WindowsAds", "WindowsTrailingDots"],
    "LinkPolicy": ["LinkEscape", "SymlinkRefused", "HardlinkRefused", "LinkThroughSymlink", "HardlinkTargetMissing"],
    "LimitExceeded": ["ArchiveSizeExceeded", "FileCountExceeded", "TotalSizeExceeded", "EntrySizeExceeded", "DepthExceeded", "CompressionRatioExceeded"],
    "Atomicity": ["OutputExists", "OutputIsSymlink", "OutputIsFile", "TempDirCleanup", "CrossDeviceRename"],
    "Plugin": ["PluginInvalidEntry", "LegacyPluginNotEnabled"],
}
_PARENT = {child: parent for parent, children in _FAMILY.items() for child in children}
KINDS: dict[str, type[ArchiveError]] = {}


def _kind(name: str) -> type[ArchiveError]:
    if name not in KINDS:
        base = _kind(_PARENT[name]) if name in _PARENT else ArchiveError
        KINDS[name] = type(f"{name}Error", (base,), {"code": CODES[name], "__module__": __name__})
    return KINDS[name]


for _name in CODES:
    globals()[f"{_name}Error"] = _kind(_name)
_BY_CODE = {code: KINDS[name] for name, code in CODES.items()}


def from_code(code: str, message: str, **more) -> ArchiveError:
    """The exception of a code, as violations of a plan have it."""
    return _BY_CODE.get(code, ArchiveError)(message, **more)
