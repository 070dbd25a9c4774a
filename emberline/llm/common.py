"""What several operators share: table access, checked broadcasts, files of the shared folder."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.session import drop_path, reliable_cut, scratch_path, shared_folder  # noqa: F401

# A side of a join is broadcast only if it was counted and has at most this many slim rows (some 16 MB).
BROADCAST_ROWS = 500_000
ARROW_KEY, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is, for a shuffled join. Count is an action: pass a
    stored table of few columns."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def without(docs: DataFrame, id_col: str, value: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and ``value`` are not in ``gone`` (a stored table doc_id, h); nulls are values like others."""
    mark, gone_id, gone_h = (fresh_name(docs.columns, n) for n in ("__h", "__doc_id", "__gone_h"))
    gone = small(gone.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)).distinct())
    marked = docs.withColumn(mark, value)
    kept = marked.join(
        gone, marked[id_col].cast("long").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_h)), "left_anti"
    )
    return kept.drop(mark)


def importable(df: DataFrame) -> DataFrame:
    """``df``, made ready for Python tasks: workers on machines that share this folder can import the package from it, and, unless the
    session says otherwise, texts come in batches of ARROW_ROWS rows instead of the default of 10,000, which long texts make large."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_KEY) == "10000":
        conf.set(ARROW_KEY, str(ARROW_ROWS))
    environment = df.sparkSession.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, environment.get("PYTHONPATH")]))
    return df


def give_back() -> None:
    """Hand memory that is free in this Python process back to the system, where the C library can do so."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, after which its worker keeps no free memory: workers live on, and two tasks' peaks need not come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def fresh_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until none of ``columns`` has it, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``fn`` turns the columns of a batch, as lists, into output columns; rows may be fewer or more than came in."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    @freed
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                made = fn({name: part.column(name).to_pylist() for name in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return importable(df).mapInArrow(task, schema)


def cut(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that a task's Python objects stay few at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``path`` within it: local, HDFS or an object store, by its scheme."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


class AtomicFile:
    """A file of the shared folder, under a name of its own attempt.

    A task that is run twice writes two files; only the one whose name gets into the committed manifest (a Parquet table) is
    ever read, so lost executors and doubled attempts do no harm.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        import uuid

        self.path = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        fs, inner = open_fs(self.path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self._out, self.at = fs.open_output_stream(inner, compression=None), 0

    def write(self, data: bytes) -> int:
        """The offset at which ``data`` begins."""
        begins = self.at
        self._out.write(data)
        self.at += len(data)
        return begins

    def close(self) -> None:
        self._out.close()


def open_input(path: str, mapped: bool = False):
    fs, inner = open_fs(path)
    if mapped and isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(inner)
    return fs.open_input_file(inner)
