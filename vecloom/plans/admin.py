"""What an operator of indexes asks: status, info, version, warm-up."""

from __future__ import annotations

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from .catalog import FORMAT_VERSION, Catalog
from .refresh import verify
from .sizing import build_mb, estimate

#: A delta that takes longer to read is warned of.
SLOW_DELTA_MS = 500


def status(catalog: Catalog, name: str) -> DataFrame:
    """(level, message) rows about one index; changes nothing."""
    m = catalog.get(name, "status")
    positions = m.vector_count + m.tombstones
    out = [("notice", f"index {name}: {m.index_type} index, {m.vector_count} live vectors, {m.tombstones} tombstones (tombstone_ratio {m.tombstone_ratio}), refresh_mode {m.refresh_mode}, {m.incremental_count} incremental refreshes since the last full build (rebuild_every {m.rebuild_every or 'never'})")]
    if m.index_type == "hnsw" and m.active_snapshot is not None:
        out.append(("notice", f"index {name}: vectors no search can reach: {'not counted' if m.unreachable is None else m.unreachable} (reachability {m.reachability})"))
    if m.ver_col is not None:
        how = {0: "never (verify_every 0): after a physical UPDATE, DELETE or dropped partition run refresh in mode full", 1: "at every refresh (verify_every 1)"}
        out.append(("notice", f"index {name}: journal digest verified {how.get(m.verify_every, f'every {m.verify_every} refreshes (verify_every {m.verify_every})')}; {m.refreshes_since_verify} refreshes since the last verification or full build"))
    out.append(("notice", f"index {name}: last refresh: {m.refresh_note or 'none yet'}"))
    if m.chain:
        out.append(("notice", f"index {name}: a chain of {len(m.chain)} snapshots from {m.chain[0]}"))
    if m.tombstones > m.tombstone_ratio * positions and m.refresh_mode == "incremental":
        out.append(("warning", f"index {name}: {m.tombstones} of {positions} positions are tombstones; refresh_mode incremental never rebuilds by itself: refresh in mode full"))
    if m.ver_col is not None and m.boundary is not None:
        import time

        began = time.time()
        n = catalog.delta(m).count()
        ms = int((time.time() - began) * 1000)
        if ms > SLOW_DELTA_MS:
            out.append(("warning", f"index {name}: the delta took {ms} ms to read, which every exact query pays: keep the journal's files apart by version, or refresh more often"))
        out.append(("notice", f"index {name}: {n} journal rows in the delta, read in {ms} ms"))
        if n > 100_000:
            out.append(("warning", f"index {name}: the delta holds {n} rows. Every exact query searches them: refresh more often."))
        src = catalog.source(m)
        if dict(src.dtypes)[m.ver_col].startswith("timestamp"):
            late = src.where(F.col(m.ver_col) > F.current_timestamp() + F.expr("INTERVAL 5 MINUTES")).count()
            if late:
                out.append(("warning", f"index {name}: {late} rows have a version in the future; results can be wrong."))
    if m.active_snapshot is None:
        out.append(("notice", f"index {name}: no snapshot yet, no sizing check"))
    else:
        e = estimate(max(positions, 1), m.dims, m.index_type, m.quantization)
        every = sum(estimate(max(x.vector_count + x.tombstones, 1), x.dims, x.index_type, x.quantization)["total_mb"] for x in map(catalog.get, catalog.names()) if x.dims)
        memory, free = memory_mb(catalog.spark), catalog._fs.getStatus(catalog._path(catalog.root)).getRemaining() / 1048576
        build = build_mb(max(positions, 1), m.dims, m.index_type, m.quantization)
        out.append(("notice", f"index {name}: sizing: index {e['total_mb']:.1f} MB, all indexes {every:.1f} MB, build about {build:.1f} MB"))
        if e["total_mb"] > memory / 2:
            out.append(("warning", f"index {name}: {e['total_mb']:.0f} MB are more than half of the {memory:.0f} MB of the executors: quantization sq8 makes it smaller"))
        if build > free:
            out.append(("warning", f"index {name}: a full build needs about {build:.0f} MB, {free:.0f} MB are free under {catalog.root}"))
    return catalog.spark.createDataFrame(out, "level string, message string")


def memory_mb(spark: SparkSession) -> float:
    """Storage and execution memory of all executors."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, total = status.valuesIterator(), 0
    while it.hasNext():
        total += it.next()._1()
    return total / 1048576


def info(catalog: Catalog, name: str | None = None) -> DataFrame:
    """One row per index with the facts of its manifest and files.

    loaded: every file of the snapshot is there; resident_mb: its cached delta; what describes the memory mapping of a
    node (hugepages, swappiness, max_map_count) has no counterpart and is null.
    """
    rows = []
    size = lambda path: int(catalog._fs.getContentSummary(catalog._path(path)).getLength()) if catalog._exists(path) else 0
    free = int(catalog._fs.getStatus(catalog._path(catalog.root)).getRemaining() / 1048576)
    for n in [name] if name else catalog.names():
        m = catalog.get(n, "info")
        top = f"{catalog.root}/snapshots/{n}"
        there = bool(m.chain) and all(catalog._exists(f"{catalog.segment_path(n, s)}/_SUCCESS") for s in m.chain)
        graph = sum(size(catalog.segment_path(n, s, "graph")) for s in m.chain) if m.index_type == "hnsw" else 0
        rows.append((
            catalog.spark.sparkContext.applicationId, n, m.active_snapshot, m.max_ver, m.vector_count, m.dims, m.metric, m.index_type, m.quantization, graph, m.tombstones, m.chain[0] if m.chain else None,
            m.precision_default, m.freshness_default, m.ef_search_default, m.threads_default, top, there, 0, m.vector_count + m.tombstones, size(top), m.unreachable, free, int(memory_mb(catalog.spark)), None, None, None,
        ))
    return catalog.spark.createDataFrame(
        rows,
        "node_name string, index_name string, snapshot_id long, max_ver long, vector_count long, dims long, metric string, index_type string, quantization string, graph_bytes long, tombstones long, base_snapshot long, "
        "precision_default string, freshness_default string, ef_search_default long, threads_default long, cache_file string, loaded boolean, resident_mb long, capacity long, file_bytes long, unreachable long, "
        "cache_free_mb long, mem_available_mb long, hugepages string, swappiness long, max_map_count long",
    )


def version(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(__version__, FORMAT_VERSION, f"spark {pyspark.__version__}")], "library_version string, format_version int, build_flags string")


def warm(catalog: Catalog, name: str | None = None) -> dict[str, int]:
    """Read one or all indexes once and verify them: how many are fine, broken, without snapshot."""
    out = {"fine": 0, "broken": 0, "without_snapshot": 0}
    for n in [name] if name else catalog.names():
        m = catalog.get(n, "warm")
        if m.active_snapshot is None:
            out["without_snapshot"] += 1
            continue
        try:
            out["fine" if all(r.fine for r in verify(catalog, n).collect()) else "broken"] += 1
        except ValueError:
            out["broken"] += 1
    return out
