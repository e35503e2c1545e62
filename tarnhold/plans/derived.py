"""Relations of archive entries derived from the given tables, as SQL that Spark and DuckDB read alike.

A document, line item, part, page or event stands for an entry of an archive; the shapes of document paths hold every
hostile form that the path rules know.  Backslashes are ``chr(92)``, as the two parsers read escapes differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_K = "(CAST(floor(doc_id / 20) AS BIGINT) % 32)"
_B = "chr(92)"
_T = "(CAST(floor(doc_id / 640) AS BIGINT) % 7)"
_PATHS = {
    0: "concat('../evil_', doc_id, '.txt')", 1: "concat('a/../b_', doc_id)", 2: "concat('/etc/passwd_', doc_id)",
    3: f"concat('C:', {_B}, 'Windows', {_B}, 'evil_', doc_id, '.dll')", 4: "concat('C:evil_', doc_id, '.txt')", 5: f"concat({_B}, {_B}, 'server', {_B}, 'share', {_B}, doc_id)",
    6: "concat('file_', doc_id, '.txt:Zone.Identifier')", 7: "'CON.txt'", 8: "'dir/COM1'", 9: "concat('file_', doc_id, '.txt.')", 10: "concat('file_', doc_id, '.txt ')",
    11: "concat('a//b_', doc_id)", 12: "concat('a_', doc_id, '/')", 13: f"concat('foo/bar', {_B}, 'baz_', doc_id)", 14: "concat('.%2e/.%2e/etc_', doc_id)", 15: "concat('a<b>_', doc_id, '.txt')",
    16: "concat('a', chr(9), 'b_', doc_id)", 17: f"concat('./docs/./a_', {_T}, '.txt')", 18: f"concat('docs/a_', {_T}, '.txt')", 19: f"concat('Docs/A_', {_T}, '.TXT')",
    20: "concat(repeat('d/', 129), 'f_', doc_id)", 21: "concat('././', repeat('d/', 126), 'f_', doc_id)", 22: "concat('nested/link_', doc_id)", 23: "concat('nested/link_', doc_id)",
    24: "concat('hard_', doc_id)", 25: "concat('hard_', doc_id)", 26: "concat('nested/link_', doc_id - 60, '/f.txt')", 27: "concat('link_', doc_id)", 28: "concat('bin/tool_', doc_id)", 29: "concat('link_', doc_id)",
    30: "concat('hard_', doc_id)", 31: f"concat('docs/a_', {_T}, '.txt/f_', doc_id)",
}
_case = lambda of, rest: "CASE " + " ".join(f"WHEN {_K} = {k} THEN {v}" for k, v in of.items()) + f" ELSE {rest} END"

#: Relation: (table, columns).
ENTRIES = {
    "doc_entries": ("documents", {
        "archive_id": "source",
        "entry_index": "CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT)",
        "path": _case(_PATHS, "concat(lang, '/doc_', doc_id, '.txt')"),
        "type": _case({22: "'symlink'", 23: "'symlink'", 27: "'symlink'", 29: "'symlink'", 24: "'hardlink'", 25: "'hardlink'", 30: "'hardlink'", 12: "'directory'"}, "'file'"),
        "size": _case({11: "CAST(NULL AS BIGINT)"}, "n_chars"),
        "mode": f"CAST({_case({28: '2541', 29: '1517', 31: '1023', 5: 'NULL', 12: '511'}, '420')} AS INT)",
        "link_target": _case({22: "'../../outside.txt'", 23: "concat('target_', doc_id)", 27: "'/etc'", 29: "'../output/x'", 24: "'docs/a_0.txt'", 25: "'../secret.txt'", 30: "concat('hard_', doc_id - 120)"}, "CAST(NULL AS VARCHAR(9999))"),
        "source_format": "'tar'",
    }),
    "line_entries": ("lineitem", {
        "archive_id": "CAST(l_orderkey AS VARCHAR(99))",
        "entry_index": "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS BIGINT)",
        "path": "concat('p/', l_partkey, '_', l_suppkey)", "type": "'file'", "size": "CAST(l_quantity * 1000 AS BIGINT)", "mode": "420", "link_target": "CAST(NULL AS VARCHAR(9999))", "source_format": "'zip'",
    }),
    "part_entries": ("part", {
        "archive_id": "p_brand", "entry_index": "CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT)",
        "path": "CASE WHEN p_partkey % 3 = 0 THEN upper(concat(p_type, '/', p_name)) ELSE concat(p_type, '/', p_name) END",
        "type": "'file'", "size": "CAST(p_size AS BIGINT)", "mode": "420", "link_target": "CAST(NULL AS VARCHAR(9999))", "source_format": "'zip'",
    }),
    "url_entries": ("pages", {
        "archive_id": "split_part(url, '/', 3)", "entry_index": "CAST(row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1 AS BIGINT)",
        "path": "CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^[a-z]+://[^/]*/', '') END",
        "type": "'file'", "size": "CAST(length(html) AS BIGINT)", "mode": "420", "link_target": "CAST(NULL AS VARCHAR(9999))", "source_format": "'tar.gz'",
    }),
    "event_entries": ("events", {
        "archive_id": "CAST(user_id AS VARCHAR(99))", "entry_index": "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT)",
        "path": "concat(event_type, '/state.json')", "type": "'file'", "size": "CAST(length(props) AS BIGINT)", "mode": "493", "link_target": "CAST(NULL AS VARCHAR(9999))", "source_format": "'tar'", "body": "props",
    }),
}


#: Relations of small archives: the number that names an archive, in the window over its rows.
_KEYED = {"line_entries": "l_orderkey", "event_entries": "user_id"}
#: Relations whose archives may hold a large part of a table: what numbers their entries, a whole number.
_NUMBERED = {"doc_entries": "doc_id", "part_entries": "p_partkey", "url_entries": "page_id"}
STRETCH = 4096


def numbered(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """Places from 0 on in the order of a whole number, by stretches of it: only sums per stretch are in a group's window.

    Rows of a group with equal numbers have neighbouring places in no set order.
    """
    rows = df.withColumns({"__group": F.expr(group), "__stretch": F.floor(F.col(order) / STRETCH)})
    sums = rows.groupBy(F.col("__group").alias("__of"), F.col("__stretch").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__of").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__of", "__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__group", "__stretch").orderBy(order)) - 1
    rows = rows.withColumn("__within", within).join(sums, F.col("__group").eqNullSafe(F.col("__of")) & F.col("__stretch").eqNullSafe(F.col("__at")))
    return rows.withColumn(out, (F.col("__before") + F.col("__within")).cast("bigint"))


def entries(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = ENTRIES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in _NUMBERED:
        rows = numbered(rows, columns["archive_id"], _NUMBERED[name], "__place")
        columns = {**columns, "entry_index": "__place"}
    elif name in _KEYED:
        # dealt by the archive's name, rows lie as the steps on archives want them and are shuffled once
        rows = rows.withColumn("archive_id", F.expr(columns["archive_id"]))
        columns = {**columns, "archive_id": "archive_id", "entry_index": columns["entry_index"].replace(f"PARTITION BY {_KEYED[name]} ", "PARTITION BY archive_id ")}
    return rows.selectExpr(*[k if k == v else f"{v} AS {k}" for k, v in columns.items()])  # under another name it would be dealt anew


def sql(name: str) -> str:
    table, columns = ENTRIES[name]
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {table}"


def archives(df: DataFrame) -> DataFrame:
    """An archive of each id: a fiftieth of its entries' sizes, every third without a size."""
    return df.groupBy("archive_id").agg({"size": "sum"}).selectExpr("archive_id", "CAST(CASE WHEN length(archive_id) % 3 = 0 THEN 0 ELSE floor(coalesce(`sum(size)`, 0) / 50) END AS BIGINT) AS archive_size")


ARCHIVES = "SELECT archive_id, CAST(CASE WHEN length(archive_id) % 3 = 0 THEN 0 ELSE floor(coalesce(sum(size), 0) / 50) END AS BIGINT) AS archive_size FROM entries GROUP BY archive_id"
