"""The registered queries as DuckDB SQL, built from the same rules as the plans but in another engine's terms."""

from __future__ import annotations

from .derived import ARCHIVES, sql

SEG = r"'[\\/]'"
DEVICE = r"'^(?i:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\.|$)'"


def segments(p: str) -> str:
    return f"string_split_regex({p}, {SEG})"


def stripped(p: str) -> str:
    return f"CASE WHEN list_contains({segments(p)}, '.') THEN array_to_string(list_filter({segments(p)}, lambda s: s <> '.'), '/') ELSE {p} END"


def _fold(parts: str, start: str, up: str, dead: str) -> str:
    """Folds segments onto a stack; ``up`` is the stack after ``..``."""
    return f"list_reduce(list_prepend({start}, list_transform({parts}, lambda s: [s])), lambda a, x: CASE WHEN {dead} THEN a WHEN x[1] = '' OR x[1] = '.' THEN a WHEN x[1] = '..' THEN {up} ELSE list_concat(a, x) END)"


def normalized(p: str) -> str:
    stack = _fold(f"string_split(replace(nfc_normalize({p}), chr(92), '/'), '/')", "['^']", "CASE WHEN len(a) = 1 THEN ['!'] ELSE a[1:-2] END", "a[1] = '!'")
    return f"CASE WHEN ({stack})[1] = '!' OR len({stack}) = 1 THEN NULL ELSE array_to_string(({stack})[2:], '/') END"


def escapes(path: str, target: str, kind: str) -> str:
    parts = f"list_concat(CASE WHEN {kind} = 'symlink' THEN string_split(replace({path}, chr(92), '/'), '/')[1:-2] ELSE CAST([] AS VARCHAR[]) END, string_split(replace({target}, chr(92), '/'), '/'))"
    at = _fold(parts, "['output']", "a[1:-2]", "false")
    return f"CASE WHEN {target} IS NULL THEN NULL ELSE starts_with({target}, '/') OR starts_with({target}, chr(92)) OR regexp_matches({target}, '^[A-Za-z]:') OR coalesce(({at})[1], '') <> 'output' END"


def path_error(p: str) -> str:
    """The ordered rules; the path's dots are dropped first unless it has a backslash."""
    q = f"(CASE WHEN contains({p}, chr(92)) THEN {p} ELSE {stripped(p)} END)"
    marks = f"list_filter(list_transform({segments(q)}, lambda s: CASE WHEN regexp_matches(s, '[<>\"|?*]') THEN 'PATH_POLICY_VIOLATION' WHEN regexp_matches(s, {DEVICE}) THEN 'PATH_WINDOWS_DEVICE' END), lambda m: m IS NOT NULL)[1]"
    v = "'PATH_POLICY_VIOLATION'"
    return f"""CASE WHEN trim({q}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) = '' THEN {v}
 WHEN regexp_matches({q}, '[\\x01-\\x1F]') THEN {v} WHEN contains({q}, '%') THEN {v}
 WHEN starts_with({q}, '/') OR regexp_matches({q}, '^[A-Za-z]:') OR starts_with({q}, concat(chr(92), chr(92))) THEN 'PATH_ABSOLUTE'
 WHEN regexp_matches({q}, ':[^/\\\\]') THEN 'PATH_WINDOWS_ADS' WHEN {marks} IS NOT NULL THEN {marks}
 WHEN list_contains({segments(q)}, '..') THEN 'PATH_TRAVERSAL'
 WHEN len(list_filter({segments(q)}, lambda s: ends_with(s, '.') OR ends_with(s, ' '))) > 0 THEN 'PATH_WINDOWS_TRAILING_DOTS'
 WHEN contains({q}, chr(92)) THEN {v} WHEN contains({q}, '//') THEN {v} WHEN ends_with({q}, '/') THEN {v}
 WHEN len({segments(q)}) > 128 THEN 'LIMIT_DEPTH' WHEN length({q}) > 4096 THEN {v} END"""


def sanitized(mode: str, kind: str) -> str:
    given = f"coalesce({mode}, CASE WHEN {kind} = 'directory' THEN 493 ELSE 420 END)"
    return f"CAST(({given} & 511) & CASE WHEN {kind} = 'directory' OR ({given} & 73) <> 0 THEN 493 ELSE 420 END & 493 AS INTEGER)"


def relation(name: str = "doc_entries", tables: dict[str, str] | None = None) -> str:
    """The relations every oracle starts from: entries, archives and, in steps, what the operators add."""
    base = {
        "entries": sql(name),
        "archives": ARCHIVES,
        "norm": f"SELECT *, {normalized('path')} AS normalized, {path_error('path')} AS error_code FROM entries",
        "marked": "SELECT *, normalized IS NOT NULL AND row_number() OVER (PARTITION BY archive_id, normalized ORDER BY entry_index) > 1 AS duplicate, normalized IS NOT NULL AND first_value(normalized) OVER (PARTITION BY archive_id, lower(normalized) ORDER BY entry_index) <> normalized AS case_collision FROM norm",
        "running": "SELECT *, sum(CAST(coalesce(size, 0) AS DECIMAL(38, 0))) OVER (PARTITION BY archive_id ORDER BY entry_index) AS running_size FROM norm JOIN archives USING (archive_id)",
    }
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in (base | (tables or {})).items()) + " "


def entry_findings() -> str:
    error = {"PATH_ABSOLUTE": ("absolute_path", "critical"), "PATH_TRAVERSAL": ("path_traversal", "critical"), "PATH_WINDOWS_DEVICE": ("windows_reserved_name", "high"), "PATH_WINDOWS_ADS": ("windows_ads_path", "high"), "PATH_WINDOWS_TRAILING_DOTS": ("trailing_dots_spaces", "high"), "PATH_NUL_BYTE": ("path_traversal", "medium"), "LIMIT_DEPTH": ("excessive_depth", "medium"), "PATH_POLICY_VIOLATION": ("path_policy_violation", "medium")}
    rules = [(c, s, f"error_code = '{e}'") for e, (c, s) in error.items()]
    escaped = escapes("path", "link_target", "type")
    rules += [
        ("duplicate_path", "medium", "duplicate"), ("case_collision", "medium", "case_collision"),
        ("windows_drive_absolute", "critical", "regexp_matches(path, '^[A-Za-z]:')"), ("windows_unc_path", "critical", "starts_with(path, concat(chr(92), chr(92))) OR starts_with(path, '//')"),
        ("windows_ads_path", "high", "regexp_matches(path, ':[^/\\\\]') AND error_code IS DISTINCT FROM 'PATH_WINDOWS_ADS'"),
        ("windows_reserved_name", "high", f"len(list_filter({segments('path')}, lambda s: regexp_matches(s, {DEVICE}))) > 0 AND error_code IS DISTINCT FROM 'PATH_WINDOWS_DEVICE'"),
        ("symlink_present", "medium", "type = 'symlink'"), ("symlink_escape", "critical", f"type = 'symlink' AND {escaped}"), ("hardlink_present", "medium", "type = 'hardlink'"), ("hardlink_escape", "critical", f"type = 'hardlink' AND {escaped}"),
        ("setuid_bit", "high", "(mode & 2048) <> 0"), ("setgid_bit", "high", "(mode & 1024) <> 0"), ("sticky_bit", "medium", "(mode & 512) <> 0"), ("excessive_entry_size", "high", "size > 536870912"),
        ("excessive_depth", "medium", f"len({segments('path')}) > 128 AND error_code IS DISTINCT FROM 'LIMIT_DEPTH'"),
    ]
    items = ", ".join(f"CASE WHEN {w} THEN {{'code': '{c}', 'severity': '{s}'}} END" for c, s, w in rules)
    return f"SELECT archive_id, entry_index, path, list_filter([{items}], lambda f: f IS NOT NULL) AS fs FROM marked"


FINDINGS = {"listed": entry_findings(), "findings": "SELECT archive_id, entry_index, CAST(k - 1 AS INTEGER) AS finding_index, fs[k].code AS code, fs[k].severity AS severity, path FROM (SELECT *, unnest(range(1, len(fs) + 1)) AS k FROM listed)"}


def sums(files: int = 10_000, total: int = 2147483648, ratio: int = 100) -> dict[str, str]:
    return {
        "sums": f"SELECT a.archive_id, archive_size, coalesce(n, 0) AS entry_count, coalesce(total, 0) AS total_size, CASE WHEN archive_size > 0 THEN coalesce(total, 0) / archive_size ELSE 0.0 END AS compression_ratio FROM archives a LEFT JOIN (SELECT archive_id, least(count(*), {files + 1}) AS n, CAST(max(running_size) FILTER (entry_index < {files}) AS BIGINT) AS total FROM running GROUP BY archive_id) USING (archive_id)",
        "whole": f"SELECT archive_id, 'excessive_total_size' AS code, 'high' AS severity FROM sums WHERE total_size > {total} UNION ALL SELECT archive_id, 'excessive_compression_ratio', 'high' FROM sums WHERE archive_size > 0 AND compression_ratio > {ratio} UNION ALL SELECT archive_id, 'high_entry_count', 'low' FROM sums WHERE entry_count > 1000 UNION ALL SELECT archive_id, 'excessive_entry_count', 'high' FROM sums WHERE entry_count > {files}",
    }


SUMS = sums() | {
    "every": "SELECT archive_id, code, severity FROM findings UNION ALL SELECT archive_id, code, severity FROM whole",
    "worst": "SELECT archive_id, max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END) AS r, count(*) AS n FROM every GROUP BY archive_id",
}
REPORT = "SELECT s.archive_id, CASE coalesce(r, 2) WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS risk_level, total_size, compression_ratio, entry_count, coalesce(n, 0) AS n_findings FROM sums s LEFT JOIN worst USING (archive_id)"
STRUCTURE = "CASE WHEN path IS NULL OR path = '' THEN 'path' WHEN source_format IS NULL OR source_format = '' THEN 'source_format' WHEN type IS NULL OR type NOT IN ('file', 'directory', 'symlink', 'hardlink') THEN 'type' WHEN size < 0 OR size > 9007199254740991 THEN 'size' WHEN mode < 0 OR mode > 8191 THEN 'mode' WHEN type IN ('symlink', 'hardlink') AND (link_target IS NULL OR link_target = '') THEN 'link_target' END"
#: What the derived entries look like with a broken record now and then.
BROKEN = {"path": "CASE WHEN entry_index % 11 = 1 THEN '' ELSE path END", "type": "CASE WHEN entry_index % 11 = 2 THEN 'fifo' ELSE type END", "size": "CASE WHEN entry_index % 11 = 3 THEN -1 WHEN entry_index % 11 = 4 THEN 9007199254740992 ELSE size END", "mode": "CAST(CASE WHEN entry_index % 11 = 5 THEN 8192 ELSE mode END AS INT)", "link_target": "CASE WHEN entry_index % 11 = 6 THEN NULL ELSE link_target END"}
LIMITED = "CASE WHEN entry_index >= {files} THEN 'LIMIT_FILE_COUNT' WHEN size > {entry} THEN 'LIMIT_ENTRY_SIZE' WHEN size IS NOT NULL AND running_size > {total} THEN 'LIMIT_TOTAL_SIZE' WHEN size IS NOT NULL AND archive_size > 0 AND CAST(running_size AS DOUBLE) / archive_size > {ratio} THEN 'LIMIT_COMPRESSION_RATIO' END"
TIGHT = {"files": 6, "entry": 45_000, "total": 120_000, "ratio": 45}

LINKED = {
    "hard": f"SELECT archive_id, entry_index, normalized, {normalized('link_target')} AS target FROM norm WHERE type = 'hardlink'",
    "chain": "SELECT h.archive_id, h.entry_index, h.normalized, 1 AS depth FROM hard h WHERE EXISTS (SELECT 1 FROM norm n WHERE n.type <> 'hardlink' AND n.archive_id = h.archive_id AND n.normalized = h.target) UNION SELECT h.archive_id, h.entry_index, h.normalized, c.depth + 1 FROM hard h JOIN chain c ON c.archive_id = h.archive_id AND c.normalized = h.target AND c.depth < 50",
    "above": "SELECT archive_id, entry_index, array_to_string(string_split(normalized, '/')[1:k], '/') AS ancestor FROM (SELECT archive_id, entry_index, normalized, unnest(range(1, len(string_split(normalized, '/')))) AS k FROM norm WHERE normalized IS NOT NULL)",
}


def _below(kind: str) -> str:
    return f"SELECT a.archive_id, a.entry_index, arg_min(a.ancestor, n.entry_index) AS ancestor FROM above a JOIN norm n ON n.archive_id = a.archive_id AND n.normalized = a.ancestor AND n.type = '{kind}' AND n.entry_index < a.entry_index GROUP BY ALL"


#: Extraction of derived documents: stripped of nothing, later duplicates left out.
EXTRACT = {
    "checked": f"SELECT *, {LIMITED.format(files=10000, entry=536870912, total=2147483648, ratio=100)} AS budget FROM running",
    "good": "SELECT * FROM checked WHERE budget IS NULL AND error_code IS NULL",
    "landed": f"SELECT *, {stripped('path')} AS landing, {normalized('path')} AS normalized FROM good",
    "firsts": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_id, normalized ORDER BY entry_index) AS rn FROM landed)",
    "written": "SELECT * FROM firsts WHERE rn = 1",
}
