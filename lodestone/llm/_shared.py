"""What every operator here needs: the shared folder, Arrow plumbing, folds.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, since
driver and executors share nothing else; a lost executor then costs a retried
task and never a lost table.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_own: list[str] = []
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where none is named and all runs on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """How many intermediate tables there are: a mark for ``drop_staged``."""
    return len(_staged)


def drop_staged(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Deletes the tables made after the mark ``since``, but for the last ``but``, once no result needs them."""
    jvm, gone = spark.sparkContext._jvm, _staged[since : len(_staged) - but]
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    del _staged[since : len(_staged) - but]
    return len(gone)


def write_files(rows: DataFrame, root: str, name: str, data: str, tail: bytes = b"\n") -> None:
    """Each row's bytes as a file ``root/<name>=<its name>/part-...``, followed by ``tail``.

    Spark's text sink does the writing, a row a file, so that any store that Spark
    writes will do and a lost task is written again. Names are unique; ``tail`` takes
    the place of the line's end, so a format with a fixed end needs nothing added.
    """
    held = rows.select(F.col(name), F.col(data).cast("string").alias("value"))
    held.write.partitionBy(name).option("encoding", "ISO-8859-1").option("lineSep", tail.decode("latin-1")).option("maxRecordsPerFile", 1).option("compression", "none").text(root)


def read_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(name, path, data) of what ``write_files`` wrote."""
    return spark.read.schema(f"path string, modificationTime timestamp, length long, content binary, {name} string").format("binaryFile").load(root).select(name, "path", F.col("content").alias("data"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, dropped with the staged tables."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


class RangeReader:
    """Reads parts of a file through the Hadoop file system; counts the bytes it asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.asked = spark.sparkContext._jvm, 0
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.size = self.store.getFileStatus(self.path).getLen()

    def __call__(self, at: int, n: int) -> bytes:
        stream = self.store.open(self.path)
        try:
            stream.seek(at)
            self.asked += n
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text, mod n: the same on every engine and at every size."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def with_fields(schema: T.StructType, *added: T.StructField) -> T.StructType:
    """The schema plus fields; an input column of the same name is replaced."""
    names = {f.name for f in added}
    return T.StructType([f for f in schema.fields if f.name not in names] + list(added))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object]]],
    *added: T.StructField,
    keep: list[str] | None = None,
    rows: int = 512,
) -> DataFrame:
    """``df`` with columns computed from whole Arrow batches.

    ``make`` runs once a task and returns a function from a batch to the added
    columns; kept input columns pass through unchanged. Batches are worked on in
    parts of ``rows``, so that memory doesn't follow Arrow's batch size.
    """
    names = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for batch in slices(whole, rows):
                made = step(batch)
                cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                cols += [
                    v if isinstance(v, pa.Array) else pa.array(v, arrow.field(f.name).type)
                    for f in added
                    for v in [made[f.name]]
                ]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(trimmed(run), schema)


def trim() -> None:
    """Gives freed memory back to the system: an idle Python worker holds what its last task used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A batch function that trims memory when its task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows, for steps whose memory follows the text."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
