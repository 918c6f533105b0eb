"""What the operators of this subpackage share.

Ids are whole numbers: operators that hand them to Python read them as such (an id of another type is cast, one that is no
number counts as null).
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamstage.storage import checkpoint_dir, cut  # noqa: F401  for the operators

#: Rows of text that a Python operator handles at once: so many bytes, or a single longer text.
CHUNK_BYTES = 8 << 20


def sweep(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints deleted that nothing refers to any more. Spark does so whenever the
    driver's memory is cleaned, which on a large driver may be long after the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder, for files that an operator writes itself."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder that ``new_folder`` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path on it) of a URI or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def salts_of(salt: str) -> Column:
    """An aggregate: which salts (0 to 63) a group has, a bit for each. Of fixed size, unlike a set."""
    return F.expr(f"bit_or(shiftleft(1L, {salt}))")


def each_salt(bits: str) -> Column:
    """A row for each salt of salts_of."""
    return F.explode(F.expr(f"filter(sequence(0, 63), s -> (shiftright({bits}, s) & 1) = 1)"))


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of column ``text`` (or one longer row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    _give_back()


def _give_back() -> None:
    """Hand memory that a worker has freed back to the machine: workers live on, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of a short DDL string with the types used here."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])
