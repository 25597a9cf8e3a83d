"""Shared folder, staging tables and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one is made where it is unset, on one machine only."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: these operators need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root else f"file://{root.rstrip('/')}" if root.startswith("/") else root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/vecloom/{label}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of this session hold at most so many rows: whole texts can be long, and a batch is in memory twice."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


#: Innermost last: the owners that take what stage() writes.
_OWNERS: list["Temporary"] = []


class Temporary:
    """Owns the tables staged inside its `with` block and deletes them at its end, but for those it was told to keep.

    What is kept goes to the next owner outside.  Without an owner a table stays until discard_all() or the end of
    the interpreter: results are lazy, so only the caller knows when nothing reads it any more.
    """

    def __init__(self):
        self.staged: dict[str, SparkSession] = {}

    def __enter__(self) -> "Temporary":
        _OWNERS.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        spark = self.staged.pop(df._staged_path)
        at = _OWNERS.index(self)
        (_OWNERS[at - 1] if at else _LASTING).staged[df._staged_path] = spark
        return df

    def __exit__(self, *_) -> None:
        _OWNERS.remove(self)
        self.discard()

    def discard(self) -> None:
        for path, spark in self.staged.items():
            _delete(spark, path)
        self.staged.clear()


_LASTING = Temporary()


def discard_all() -> None:
    """Delete every table that was staged and is still there; results that read them can't be read any more."""
    _LASTING.discard()


@atexit.register
def _at_exit() -> None:
    from pyspark import SparkContext

    if SparkContext._active_spark_context is not None:
        with contextlib.suppress(Exception):
            discard_all()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    In a folder of the operating system (file:) the Python workers write.  Hadoop's local file system sets the
    permissions of every file by starting `chmod`, three processes a file, each of which shares the executor's whole
    memory until it has started; whoever measures memory at that moment sees the executor twice.  Any other store is
    written by Spark's own committer.
    """
    path = new_path(df.sparkSession, label)
    (_OWNERS[-1] if _OWNERS else _LASTING).staged[path] = df.sparkSession
    if path.startswith("file:"):
        _write_by_workers(df, path)
    else:
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _write_by_workers(df: DataFrame, path: str, group_bytes: int = 32 << 20) -> None:
    """One file a task, under a name no other attempt uses; files of attempts that did not count are deleted at the end."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)

    def write(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet

        def loose(kind):
            """The type with every field nullable: a null struct has null fields."""
            if pa.types.is_struct(kind):
                return pa.struct([pa.field(f.name, loose(f.type)) for f in kind])
            if pa.types.is_map(kind):
                return pa.map_(loose(kind.key_type), loose(kind.item_type))
            return pa.list_(pa.field("element", loose(kind.value_type))) if pa.types.is_list(kind) else kind

        out, held, n = None, [], 0
        name = f"part-{uuid.uuid4().hex}.parquet"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                schema = pa.schema([pa.field(f.name, loose(f.type)) for f in b.schema])
                sink = store.open_output_stream(f"{at}/{name}")
                out = pyarrow.parquet.ParquetWriter(sink, schema, compression="zstd", use_dictionary=False)
            held.append(b)
            n += b.nbytes
            if n >= group_bytes:
                out.write_table(pa.Table.from_batches(held).cast(schema))
                held, n = [], 0
        if out is not None:
            if held:
                out.write_table(pa.Table.from_batches(held).cast(schema))
            out.close()
            sink.close()
            held = None
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if not any(t in k for _, k in df.dtypes for t in ("string", "binary", "array", "map", "struct")):
        spark.conf.set(key, "20000")  # rows of numbers only
    try:
        wrote = {r.name for r in df.mapInArrow(write, "name string").collect()}  # a name a task
    finally:
        spark.conf.set(key, before)
    for s in fs.listStatus(folder):
        if s.getPath().getName() not in wrote:
            fs.delete(s.getPath(), False)


def discard(df: DataFrame) -> None:
    """Delete what stage() wrote, once nothing reads it any more."""
    for owner in (*_OWNERS, _LASTING):
        owner.staged.pop(df._staged_path, None)
    _delete(df.sparkSession, df._staged_path)


def sent(df: DataFrame, most: int) -> DataFrame:
    """df with a hint by its counted rows: broadcast up to `most` of them, a sort-merge join beyond."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on, and their memory is the executor's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(slot: str, version, make):
    """An object that lives as long as the Python worker, over all its tasks; a slot keeps its latest version only.

    A worker that makes a new one drops those that earlier tasks made: a later operator has no use for them.
    """
    import sys

    from pyspark import TaskContext

    store = sys.__dict__.setdefault("_vecloom_cache", {})
    if slot not in store or store[slot][0] != version:
        task = TaskContext.get()
        task = task.taskAttemptId() if task is not None else None
        gone = [k for k, x in store.items() if k == slot or x[2] != task]
        for k in gone:
            del store[k]
        if gone:
            trim()
        store[slot] = version, make(), task
    return store[slot][1]
