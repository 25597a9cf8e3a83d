"""Vector files of the TEXMEX form: .fvecs (float32), .ivecs (int32), .bvecs (uint8).

Every vector is a little-endian int32 length and its elements.  All vectors of a file have one length, so a file is
read in ranges of rows by as many tasks as wanted; generated vectors depend on (seed, row) alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: suffix -> (bytes of an element, NumPy type)
KINDS = {"fvecs": (4, "<f4"), "ivecs": (4, "<i4"), "bvecs": (1, "u1")}


def _kind(path: str) -> tuple[int, str]:
    suffix = path.rsplit(".", 1)[-1]
    if suffix not in KINDS:
        raise ValueError(f"{path}: the name must end in .fvecs, .ivecs or .bvecs")
    return KINDS[suffix]


def info(spark: SparkSession, path: str) -> tuple[int, int]:
    """(vectors, dimensions) from the file's length and first four bytes."""
    import struct

    width, _ = _kind(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    if not size:
        return 0, 0
    s = fs.open(p)
    try:
        dims = struct.unpack("<i", bytes(s.read() for _ in range(4)))[0]
    finally:
        s.close()
    row = 4 + dims * width
    if dims < 1 or size % row:
        raise ValueError(f"{path}: {size} bytes are no whole number of vectors of {dims} elements")
    return size // row, dims


def read_vectors(spark: SparkSession, path: str, first: int = 0, limit: int | None = None, id_base: int = 0, rows_per_task: int = 100_000) -> DataFrame:
    """id long, vec array<float>: rows first .. first + limit - 1; tasks open the file with pyarrow.fs and read their range."""
    width, dtype = _kind(path)
    count, dims = info(spark, path)
    stop = count if limit is None else min(count, first + limit)
    uri = path if "://" in path else f"file://{path}"
    ranges = spark.range(first, max(first, stop), rows_per_task, numPartitions=max(1, -(-(stop - first) // rows_per_task)))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.fs

        fs, name = pyarrow.fs.FileSystem.from_uri(uri)
        row = 4 + dims * width
        for b in batches:
            for at in b.column(0).to_pylist():
                n = min(rows_per_task, stop - at)
                with fs.open_input_file(name) as f:
                    f.seek(at * row)
                    raw = np.frombuffer(f.read(n * row), np.uint8).reshape(n, row)
                if (raw[:, :4].copy().view("<i4")[:, 0] != dims).any():
                    raise ValueError(f"{name}: vectors of different lengths")
                vec = np.ascontiguousarray(raw[:, 4:]).view(dtype).astype(np.float32)
                for k in range(0, n, 10_000):
                    part = vec[k : k + 10_000]
                    ids = np.arange(at + k, at + k + len(part)) + id_base
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dims), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "vec"])

    return ranges.mapInArrow(run, "id long, vec array<float>")


def read_ground_truth(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """qid, rank (from 1), id from an .ivecs file of neighbour lists."""
    gt = read_vectors(spark, path).select(F.col("id").alias("qid"), F.posexplode("vec").alias("p", "x"))
    return gt.where(F.col("p") < k).select("qid", (F.col("p") + 1).alias("rank"), F.col("x").cast("long").alias("id"))


def write_vectors(df: DataFrame, path: str) -> int:
    """df(id, vec) in id order as one file (a test fixture's size: rows stream through the driver one partition at a time)."""
    import numpy as np

    _, dtype = _kind(path)
    n = 0
    with open(path.removeprefix("file://"), "wb") as f:
        for r in df.orderBy("id").select("vec").toLocalIterator():
            v = np.array(r.vec, dtype)
            f.write(np.array([len(v)], "<i4").tobytes() + v.tobytes())
            n += 1
    return n


def generate(spark: SparkSession, rows: int, dims: int, seed: int = 1, clusters: int = 1000, spread: float = 0.5, first: int = 0, queries: bool = False) -> DataFrame:
    """id, vec of a Gaussian mixture: centres N(0, 1), rows first .. first + rows - 1 around them.

    Row r is a function of (seed, r), whatever the partitioning, so a table can be made in pieces.  With queries: other
    rows around the same centres.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.Generator(np.random.Philox(key=[seed ^ 0x5EED, 0]))
        centres = rng.standard_normal((clusters, dims)).astype(np.float32)
        key, block = seed ^ (0x9E3779B9 if queries else 0), 256

        def rows_of(at):
            """Rows at * block ... (at + 1) * block - 1, from one generator."""
            rng = np.random.Generator(np.random.Philox(key=[key, at]))
            own = rng.integers(clusters, size=block)
            return centres[own] + np.float32(spread) * rng.standard_normal((block, dims), np.float32)

        for b in batches:
            ids = b.column(0).to_numpy()
            out = np.empty((len(ids), dims), np.float32)
            for at in np.unique(ids // block).tolist():
                mine = ids // block == at
                out[mine] = rows_of(at)[ids[mine] % block]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "vec"])

    return spark.range(first, first + rows).mapInArrow(run, "id long, vec array<float>")


def load_dataset(spark: SparkSession, folder: str, name: str, base: str, query: str | None = None, truth: str | None = None, parts: int = 8) -> dict[str, str]:
    """Load vector files as Parquet tables <name>_base(id, vec, del, ts), _query(qid, qvec), _gt(qid, rank, id)."""
    out = {"base": f"{folder}/{name}_base"}
    rows = read_vectors(spark, base).repartition(parts)
    rows.select("id", "vec", F.lit(False).alias("del"), F.current_timestamp().alias("ts")).write.parquet(out["base"])
    if query:
        out["query"] = f"{folder}/{name}_query"
        read_vectors(spark, query).select(F.col("id").alias("qid"), F.col("vec").alias("qvec")).write.parquet(out["query"])
    if truth:
        out["gt"] = f"{folder}/{name}_gt"
        read_ground_truth(spark, truth, 100).write.parquet(out["gt"])
    return out
