"""Helpers shared by the training-data operators.

Conventions of every operator here:

* An operator reads only the columns it names (``doc_id``, ``text`` ...), so
  extra columns, whatever their names, never clash with its own.
* A null text counts as the empty text unless the docstring says otherwise.
* Intermediate tables that are used more than once are written to the folder
  the cluster names in ``spark.checkpoint.dir``: they survive the loss of an
  executor, and no lineage is recomputed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cuts import root

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters of text that a Python operator works on at once.
CHUNK_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; an error where a cluster names none."""
    return root(spark)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder; removed by ``discard`` or when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnhold/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, where = _folder(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnhold_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tarnhold_path", None)
        if path:
            system, where = _folder(df.sparkSession, path)
            system.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def remainder(divisor: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null for a null id)."""
    return F.crc32(F.col(name).cast("string")) % divisor


def chunks(batches: Iterable[pa.RecordBatch], text: str, budget: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``budget`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def by_chunk(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, text: str = "text") -> DataFrame:
    """``fn`` over pieces of bounded size; it returns columns by name in the order of ``schema``."""
    import pyspark.sql.pandas.types as pt
    from pyspark.sql.types import _parse_datatype_string

    fields = pt.to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text):
            got = fn(piece)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in fields], names=fields.names)

    return df.mapInArrow(run, schema)
