"""The index catalog: numbered manifests of each index, versioned snapshot folders, a refresh lock.

Everything lives under one root folder, read and written through Hadoop's file system API, so any store Spark can use
will do.  A change writes the manifest with the next number, under another name first, and no file is ever replaced;
the highest number is the current manifest.  So readers see the old or the new one, and a crash leaves the old one.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..sources.journal import JournalSpec, delta, normalise

FORMAT_VERSION = 2
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class Manifest:
    name: str
    source: str
    id_col: str
    vec_col: str
    op_col: str | None
    ver_col: str | None
    ver_margin: int | None
    metric: str
    index_type: str = "hnsw"
    m: int = 16
    ef_construction: int = 200
    quantization: str = "none"
    refresh_mode: str = "auto"
    tombstone_ratio: float = 0.2
    rebuild_every: int | None = None
    memory_mode: str = "ram"
    precision_default: str | None = None
    freshness_default: str | None = None
    ef_search_default: int | None = None
    threads_default: int | None = None
    verify_every: int = 1
    reachability: str = "auto"
    resource_check: str = "strict"
    journal_replica: str = "auto"
    # state
    active_snapshot: int | None = None
    last_snapshot: int = 0
    chain: list[int] = field(default_factory=list)
    boundary: int | None = None
    max_ver: int | None = None
    vector_count: int = 0
    tombstones: int = 0
    dims: int | None = None
    journal_rows: int | None = None
    journal_digest: str | None = None
    built_options: str | None = None
    built_format: int | None = None
    incremental_count: int = 0
    refreshes_since_verify: int = 0
    sq8_offset: float | None = None
    sq8_scale: float | None = None
    checksums: dict = field(default_factory=dict)
    unreachable: int | None = None
    build_seconds: float | None = None
    refresh_note: str | None = None

    @property
    def spec(self) -> JournalSpec:
        return JournalSpec(self.id_col, self.vec_col, self.op_col, self.ver_col)

    @property
    def options(self) -> str:
        """The build options as text; a change of it asks for a full build."""
        graph = f" m={self.m} ef_construction={self.ef_construction}" if self.index_type == "hnsw" else ""
        return f"{self.metric} {self.index_type}{graph} {self.quantization}"

    @property
    def defaults(self) -> dict:
        return {"precision": self.precision_default, "freshness": self.freshness_default, "ef_search": self.ef_search_default, "threads": self.threads_default}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._replicas: dict = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/catalog"))

    # files

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _read(self, path: str) -> str:
        s = self._fs.open(self._path(path))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def _create(self, path: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        try:
            out = self._fs.create(self._path(path), False)
        except Exception:  # noqa: BLE001  py4j wraps the "already exists" of the file system
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._exists(folder) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # manifests

    def names(self) -> list[str]:
        return sorted(n for n in self._names(f"{self.root}/catalog") if self._numbers(n))

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/catalog/{name}") if n.endswith(".json") and n[:-5].isdigit())

    def get(self, name: str, who: str = "search") -> Manifest:
        for _ in range(5):  # a number may be cleared away between the listing and the reading
            numbers = self._numbers(name)
            if not numbers:
                break
            try:
                return Manifest(**json.loads(self._read(f"{self.root}/catalog/{name}/{numbers[-1]}.json")))
            except Py4JJavaError:
                continue
        raise ValueError(f"{who}: index {name} is not registered")

    def put(self, m: Manifest) -> None:
        folder = f"{self.root}/catalog/{m.name}"
        numbers = self._numbers(m.name)
        at = numbers[-1] + 1 if numbers else 1
        new = f"{folder}/{uuid.uuid4().hex}.new"
        self._create(new, json.dumps(asdict(m)))
        if self._exists(f"{folder}/{at}.json") or not self._fs.rename(self._path(new), self._path(f"{folder}/{at}.json")):
            self.delete(new)
            raise RuntimeError(f"index {m.name}: its manifest was changed meanwhile")
        for old in numbers[:-1]:
            self.delete(f"{folder}/{old}.json")

    def remove(self, name: str) -> None:
        self.release(name)
        self.delete(f"{self.root}/catalog/{name}")
        self.delete(f"{self.root}/snapshots/{name}")

    # sources and snapshots

    def source(self, m: Manifest) -> DataFrame:
        return self.spark.read.table(m.source) if "/" not in m.source else self.spark.read.parquet(m.source)

    def journal(self, m: Manifest) -> DataFrame:
        return normalise(self.source(m), m.spec)

    def delta(self, m: Manifest) -> DataFrame:
        """The journal after the boundary; with journal_replica on, one cached copy of it until the boundary moves."""
        d = delta(self.journal(m), m.boundary)
        if m.journal_replica != "on":
            return d
        if self._replicas.get(m.name, (None,))[0] != m.boundary:
            self.release(m.name)
            self._replicas[m.name] = m.boundary, d.cache()
        return self._replicas[m.name][1]

    def release(self, name: str) -> None:
        """Let go of the cached delta of an index."""
        held = self._replicas.pop(name, None)
        if held is not None:
            held[1].unpersist()

    def segment_path(self, name: str, sid: int, part: str = "rows") -> str:
        return f"{self.root}/snapshots/{name}/{sid}/{part}"

    def snapshot(self, m: Manifest) -> DataFrame:
        """All rows of the active snapshot with seg (its snapshot id) and dead (a later segment replaced or deleted it)."""
        if m.active_snapshot is None:
            raise ValueError(f"index {m.name} has no snapshot: refresh it first")
        rows = dead = None
        for sid in m.chain:
            path = self.segment_path(m.name, sid)
            if not self._exists(f"{path}/_SUCCESS"):
                raise ValueError(f"snapshot {sid} of index {m.name} is missing: refresh it in full")
            part = self.spark.read.parquet(path).withColumn("seg", F.lit(sid))
            rows = part if rows is None else rows.unionByName(part)
            gone = self.segment_path(m.name, sid, "dead")
            if sid != m.chain[0]:
                d = self.spark.read.schema("id long").parquet(gone).withColumn("__upto", F.lit(sid))
                dead = d if dead is None else dead.unionByName(d)
        if dead is None:
            return rows.withColumn("dead", F.lit(False))
        last = dead.groupBy("id").agg(F.max("__upto").alias("__upto")).withColumnRenamed("id", "__id")
        joined = rows.join(last, F.col("id") == F.col("__id"), "left")
        return joined.withColumn("dead", F.coalesce(F.col("seg") < F.col("__upto"), F.lit(False))).drop("__id", "__upto")

    def graph(self, m: Manifest) -> DataFrame:
        """The shards of the active snapshot's graphs with seg."""
        out = None
        for sid in m.chain:
            part = self.spark.read.parquet(self.segment_path(m.name, sid, "graph")).withColumn("seg", F.lit(sid))
            out = part if out is None else out.unionByName(part)
        return out

    def live(self, m: Manifest) -> DataFrame:
        return self.snapshot(m).where(~F.col("dead"))

    def make_views(self, m: Manifest) -> None:
        """Temp views of seven columns: <name>_snap (a row with the active snapshot), <name>_delta (the journal after the boundary, and that row)."""
        none = lambda kind: F.lit(None).cast(kind)
        nothing = {"qid": "long", "qvec": "array<float>", "id": "long", "vec": "array<float>", "del": "boolean", "ver": "long"}
        snap = self.spark.range(1).select(*[none(k).alias(c) for c, k in nothing.items()], F.lit(m.active_snapshot).cast("long").alias("snapshot_id"))
        snap.createOrReplaceTempView(f"{m.name}_snap")
        if m.ver_col is not None and m.boundary is not None:
            rows = self.delta(m).select(none("long").alias("qid"), none("array<float>").alias("qvec"), "id", "vec", "del", "ver", none("long").alias("snapshot_id"))
            rows.unionByName(snap).createOrReplaceTempView(f"{m.name}_delta")

    # the refresh lock

    def lock(self, m: Manifest) -> str:
        """Take the lock; returns the owner's name for unlock().  A stale lock is moved away first, which only one can do."""
        path, me = f"{self.root}/catalog/{m.name}.lock", uuid.uuid4().hex
        mine = json.dumps({"by": me, "at": time.time()})
        if self._create(path, mine):
            return me
        held = self._held(path)
        if held and time.time() - held.get("at", 0) < max(21600, 4 * (m.build_seconds or 0)):
            raise RuntimeError(f"index {m.name}: another refresh is running (by {held.get('by')})")
        aside = f"{path}.{me}"
        moved = self._exists(path) and self._fs.rename(self._path(path), self._path(aside))
        if moved and self._held(aside).get("by") != held.get("by"):
            self._fs.rename(self._path(aside), self._path(path))  # someone else had replaced it in between
            moved = False
        self.delete(aside)
        if not moved or not self._create(path, mine):
            raise RuntimeError(f"index {m.name}: another refresh is running")
        return me

    def _held(self, path: str) -> dict:
        try:
            return json.loads(self._read(path) or "{}")
        except (Py4JJavaError, ValueError):
            return {}

    def unlock(self, m: Manifest, owner: str) -> None:
        """Give the lock back, if it is still the owner's."""
        path = f"{self.root}/catalog/{m.name}.lock"
        if self._held(path).get("by") == owner:
            self.delete(path)


def register(
    catalog: Catalog, name: str, source: str, id_col: str, vec_col: str, op_col: str | None = None, ver_col: str | None = None, metric: str = "l2", margin: int | None = None, index_type: str = "hnsw"
) -> Manifest:
    """Check and record an index; the next refresh builds it.  source: a table or view, or a folder of Parquet files."""
    say = lambda text: ValueError(f"register_index: {text}")
    if not name or not re.fullmatch(r"[A-Za-z0-9_]{1,64}", name):
        raise say("index name must be 1 to 64 letters, digits or underscores")
    if any(not IDENT.fullmatch(c or "x") for c in (id_col, vec_col, op_col, ver_col)) or not id_col or not vec_col:
        raise say("column names must be plain identifiers")
    if metric not in METRICS:
        raise say("metric must be l2, cosine, dot or l1")
    if index_type not in ("flat", "hnsw"):
        raise say("index_type must be flat or hnsw")
    if name in catalog.names():
        raise say(f"index {name} is already registered")
    m = Manifest(name, source, id_col, vec_col, op_col, ver_col, None, metric, index_type)
    kinds = dict(catalog.source(m).dtypes)
    for c in (id_col, vec_col, op_col, ver_col):
        if c is not None and c not in kinds:
            raise say(f"column {c} does not exist in {source}")
    whole = ("tinyint", "smallint", "int", "bigint")
    if kinds[id_col] not in whole:
        raise say(f"id_col {id_col} must be INT, not {kinds[id_col]}")
    if not re.fullmatch(r"array<(float|double|tinyint|smallint|int|bigint|decimal\(\d+,\d+\))>", kinds[vec_col]):
        raise say(f"vec_col {vec_col} must be ARRAY[FLOAT], ARRAY[INT] or ARRAY[NUMERIC], not {kinds[vec_col]}")
    if op_col is not None and ver_col is None:
        raise say("op_col needs ver_col: deletes must be ordered against adds")
    if op_col is not None and kinds[op_col] not in ("boolean", *whole):
        raise say(f"op_col {op_col} must be BOOLEAN or INT, not {kinds[op_col]}")
    if ver_col is not None:
        if kinds[ver_col] in ("timestamp", "timestamp_ntz"):
            m.ver_margin = (60 if margin is None else margin) * 1_000_000
        elif kinds[ver_col] in whole:
            if margin is None:
                raise say(f"an INT ver_col needs an explicit margin (units of {ver_col})")
            m.ver_margin = margin
        else:
            raise say(f"ver_col {ver_col} must be TIMESTAMPTZ, TIMESTAMP or INT, not {kinds[ver_col]}")
        if m.ver_margin < 0:
            raise say("margin must not be negative")
    catalog.put(m)
    return m


#: option -> (manifest field, check, what the value must be)
_OPTIONS = {
    "index_type": ("index_type", lambda v: v in ("flat", "hnsw"), "flat or hnsw"),
    "m": ("m", lambda v: 2 <= v <= 256, "2 to 256"),
    "ef_construction": ("ef_construction", lambda v: 1 <= v <= 100000, "1 to 100000"),
    "quantization": ("quantization", lambda v: v in ("none", "sq8"), "none or sq8"),
    "refresh_mode": ("refresh_mode", lambda v: v in ("auto", "incremental", "full"), "auto, incremental or full"),
    "tombstone_ratio": ("tombstone_ratio", lambda v: 0 < v <= 1, "above 0 and at most 1"),
    "rebuild_every": ("rebuild_every", lambda v: v >= 0, "0 (never) or more"),
    "memory_mode": ("memory_mode", lambda v: v in ("ram", "compact"), "ram or compact"),
    "precision_default": ("precision_default", lambda v: v in ("fast", "balanced", "best", "exact", "default"), "fast, balanced, best, exact or default"),
    "freshness_default": ("freshness_default", lambda v: v in ("snapshot", "exact", "default"), "snapshot, exact or default"),
    "ef_search_default": ("ef_search_default", lambda v: 0 <= v <= 100000, "0 (built-in) to 100000"),
    "threads_default": ("threads_default", lambda v: 0 <= v <= 64, "0 (one per core) to 64"),
    "verify_every": ("verify_every", lambda v: v >= 0, "0 (never), 1 (every refresh) or more"),
    "reachability": ("reachability", lambda v: v in ("auto", "on", "off"), "auto, on or off"),
    "resource_check": ("resource_check", lambda v: v in ("strict", "warn", "off"), "strict, warn or off"),
    "journal_replica": ("journal_replica", lambda v: v in ("auto", "on", "off"), "auto, on or off"),
}


def set_options(catalog: Catalog, name: str, **options) -> Manifest:
    """None keeps a value, 'default' or 0 resets a query default; build options apply at the next refresh."""
    m = catalog.get(name, "set_index_options")
    new = {}
    for key, value in options.items():
        if key not in _OPTIONS:
            raise ValueError(f"set_index_options: there is no option {key}")
        if value is None:
            continue
        to, ok, what = _OPTIONS[key]
        if not ok(value):
            raise ValueError(f"set_index_options: {key} must be {what}")
        reset = value == "default" or (value == 0 and key in ("rebuild_every", "ef_search_default", "threads_default"))
        new[to] = None if reset else value
    if new.get("memory_mode", m.memory_mode) == "compact" and new.get("quantization", m.quantization) != "sq8":
        raise ValueError("set_index_options: memory_mode compact needs quantization sq8")
    for k, v in new.items():
        setattr(m, k, v)
    catalog.put(m)
    return m


def unregister(catalog: Catalog, name: str) -> None:
    """Drop the views, the snapshots and the manifest of an index; the journal is not touched."""
    catalog.get(name, "unregister_index")
    for v in (f"{name}_snap", f"{name}_delta"):
        catalog.spark.catalog.dropTempView(v)
    catalog.remove(name)
