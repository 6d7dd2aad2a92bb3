"""What the corpus operators share: the scratch area, written intermediates, and files written by tasks."""

from __future__ import annotations

import atexit
import itertools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Tasks cut the text they handle at once into pieces of about this size, so that memory does not follow the Arrow batch.
CHUNK_BYTES = 2 << 20
#: Encoders look each distinct fragment of a chunk up once, so theirs are larger.
ENCODER_BYTES = 4 << 20
#: Spark hands texts to Python in batches of about this size, whatever their number of rows.
BATCH_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset and the master is local (tests), it is a folder in the warehouse. On a cluster no other folder is
    known to be shared, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; it is removed when the driver ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by now; the folder is then left for the cluster's own cleaning
        return


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded by bytes; plans made from now on follow."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and a lost executor costs no recomputation."""
    spark = bounded(df).sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later plan reads, and let go of shuffle files that nothing holds."""
    for df in frames:
        _remove(df.sparkSession, df._written_to)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()  # Spark drops shuffle files when their plans are collected


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    names = (f"_{i}" for i in itertools.count())
    return list(itertools.islice((x for x in names if x not in taken), n))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_scheme(path: str) -> str:
    return path if "://" in path else (path.replace("file:", "file://", 1) if path.startswith("file:/") else f"file://{os.path.abspath(path)}")


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write one file from a task and return its path.

    The name gets a random part: a retried or speculative attempt never writes over another attempt's file, and only
    files named by the rows that a successful attempt returns are ever read.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(with_scheme(folder))
    system.create_dir(base, recursive=True)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}.part") as out:
        out.write(data)
    system.move(f"{path}.part", path)
    return f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"


def read_file(path: str) -> bytes:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(with_scheme(path))
    with system.open_input_file(base) as source:
        return source.read()


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``limit`` bytes of column ``text`` (one row at least)."""
    import numpy as np

    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = _offsets(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def _offsets(column: pa.Array):
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array):
    """(buffer as uint8, row offsets into it) of a string column; a null counts as empty."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = _offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` whose per-task state is made on the executor by ``make``."""

    def run(batches):
        yield from make()(batches)

    return df.mapInArrow(run, schema)
