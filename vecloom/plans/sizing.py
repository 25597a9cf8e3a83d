"""Memory and file estimate of an index before it is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MB = 1048576.0


def estimate(vectors: int, dims: int, index_type: str = "flat", quantization: str = "none") -> dict[str, float]:
    """Megabytes of each part of a snapshot; rows are padded to 16 elements, a graph has m = 16."""
    if not 1 <= vectors <= 4294967295:
        raise ValueError("sizing: vectors must be 1 to 4294967295")
    if not 1 <= dims <= 32768:
        raise ValueError("sizing: dims must be 1 to 32768")
    if index_type not in ("flat", "hnsw") or quantization not in ("none", "sq8"):
        raise ValueError("sizing: index_type must be flat or hnsw, quantization none or sq8")
    stride = (dims + 15) // 16 * 16
    out = {
        "vectors_mb": vectors * stride * 4 / MB,
        "ids_mb": vectors * 8 / MB,
        "graph_mb": vectors * (33 * 4 + 5 + 17 * 4 / 15.0) / MB if index_type == "hnsw" else 0.0,
        "sq8_mb": vectors * (stride + 4) / MB if quantization == "sq8" else 0.0,
    }
    out["total_mb"] = sum(out.values())
    return out


def build_mb(vectors: int, dims: int, index_type: str = "flat", quantization: str = "none") -> float:
    """Megabytes a full build writes and sorts: the snapshot and 4 bytes a vector."""
    return estimate(vectors, dims, index_type, quantization)["total_mb"] + vectors * 4 / MB


def sizing(spark: SparkSession, vectors: int, dims: int, index_type: str = "flat", quantization: str = "none") -> DataFrame:
    e = estimate(vectors, dims, index_type, quantization)
    return spark.createDataFrame([(vectors, dims, index_type, quantization, *e.values(), build_mb(vectors, dims, index_type, quantization))], "vectors long, dims long, index_type string, quantization string, " + ", ".join(f"{k} double" for k in [*e, "build_mb"]))
