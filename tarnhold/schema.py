"""Schemas of the relations.  ``entry_index`` is the archive order from 0 on and comes from the reader."""

ENTRIES = "archive_id string, entry_index bigint, path string, type string, size bigint, mode int, mtime timestamp, link_target string, source_format string, compressed_size bigint, actual_bytes bigint, body binary"
ARCHIVES = "archive_id string, archive_size bigint, peek binary, content binary, detected string"
VIOLATIONS = "archive_id string, entry_index bigint, stage int, error_code string"
WARNINGS = "archive_id string, entry_index bigint, code string, entry_path string"
ENTRY_COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]
#: What policy operators need of an entry.
CORE = ["archive_id", "entry_index", "path", "type", "size", "mode", "link_target", "source_format"]
