"""Line dedup by distinct-site spread.

A line is boilerplate if it stands on at least `min_sites` distinct sites.  A HyperLogLog sketch of the sites is kept
per line hash and merged by the aggregation (map side first, so a line of a third of all rows is one sketch per task);
lines whose estimate lies within `band` of the threshold get an exact distinct count, the others are decided by the
estimate.  The decision then equals the exact one unless a sketch errs by more than `band` (15 times its standard
error at lg_k = 12; up to a few dozen sites the sketch is exact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import Temporary, stage
from .components import components
from .near_copies import text_key


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Hash of a line without outer white space; null for a blank line, which is never boilerplate."""
    t = F.btrim(line, F.lit(" \t\r"))
    return F.when(t != "", F.xxhash64(t, F.length(t)))


def site_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def boilerplate_lines(docs: DataFrame, min_sites: int = 5, band: float = 0.25, lg_k: int = 12) -> tuple[DataFrame, DataFrame]:
    """docs(text, source) -> (boilerplate(line, sites), lines(key, site, line)): hashes of lines, of whole texts.

    sites is the exact count for lines near the threshold, else the rounded estimate.  Null texts and blank lines have
    no part; a null source is a site of its own; a row that stands twice changes nothing.  Empty table: no rows.
    """
    lines = stage(
        docs.select(text_key(F.col("text")).alias("key"), site_of(F.col("source")).alias("site"), F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_key))).alias("line"))
        .where("line is not null"),
        "lines",
    )
    est = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("est")).where(F.col("est") >= min_sites * (1 - band))
    est = stage(est, "line-spread")
    near = est.where(F.col("est") <= min_sites * (1 + band))
    exact = (
        lines.join(near.select("line"), "line", "left_semi").select("line", "site").distinct()
        .groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    )
    sure = est.where(F.col("est") > min_sites * (1 + band)).select("line", F.col("est").alias("sites"))
    return sure.unionByName(exact), lines


def independent_lines(suspects: DataFrame, lines: DataFrame, min_sites: int) -> DataFrame:
    """Bad lines of suspects(key, text, site, bad) that copying doesn't explain: line.

    Near copies among the suspects are one document, which counts for one of its sites; all other documents count for
    their own.  A line stays bad if it then still stands on `min_sites` sites.
    """
    texts = suspects.groupBy("key").agg(F.first("text").alias("text"))
    roots = components(near_copies.links(texts))
    held = suspects.join(roots, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("root"), "site", F.explode("bad").alias("line"))
    held = stage(held.groupBy("line", "site", "root").count(), "suspect-lines")
    inside = held.groupBy("line", "site").agg(F.sum("count").alias("inside"))
    every = lines.join(held.select("line").distinct(), "line", "left_semi").groupBy("line", "site").count()
    carried = stage(every.join(inside, ["line", "site"], "left").where(F.col("count") > F.coalesce("inside", F.lit(0))).select("line", "site"), "carried")
    groups = held.join(carried, ["line", "site"], "left_anti").groupBy("line").agg(F.countDistinct("root").alias("groups"), F.countDistinct("site").alias("more"))
    n = F.coalesce("own", F.lit(0)) + F.coalesce(F.least("groups", "more"), F.lit(0))
    return carried.groupBy("line").agg(F.count("*").alias("own")).join(groups, "line", "full_outer").where(n >= min_sites).select("line")


def hash_of(line: str) -> int | None:
    """line_key() of one line, in Python."""
    from xxhash import xxh64_intdigest

    t = line.strip(" \t\r")
    if not t:
        return None
    h = xxh64_intdigest(len(t).to_bytes(4, "little"), xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42))
    return h - (1 << 64) if h >> 63 else h


def _cleaned(docs: DataFrame, bad, proven, copy_share: float | None) -> DataFrame:
    """docs(text, ...) + n_lines, n_removed, clean_text, __own, __bad; of a document that isn't its own only `proven` lines go.

    bad, proven: sets of line hashes (proven None: leave such documents as they are), or None for bad where each row
    brings those of its lines in a column __hits.
    """
    from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

    sent = docs.sparkSession.sparkContext.broadcast((bad, proven))  # at most `few` numbers each
    extra = [StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("clean_text", StringType()), StructField("__own", BooleanType()), StructField("__bad", ArrayType(LongType()))]
    passed = [f for f in docs.schema.fields if f.name != "__hits"]

    def run(batches):
        import pyarrow as pa

        bad, proven = sent.value

        def clean(text, hits):
            if text is None:
                return 0, 0, None, True, None
            lines, there = text.split("\n"), bad if bad is not None else set(hits or ())
            keys = [hash_of(x) for x in lines] if there else []
            found = [k in there for k in keys]
            if not any(found):
                return len(lines), 0, text, True, None
            kept = [x for x, f in zip(lines, found) if not f]
            if copy_share is not None and sum(map(len, kept)) < (1 - copy_share) * sum(map(len, lines)):
                kept = lines if proven is None else [x for x, k, f in zip(lines, keys, found) if not (f and k in proven)]
                return len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else text, False, sorted({k for k, f in zip(keys, found) if f})
            return len(lines), len(lines) - len(kept), "\n".join(kept), True, None

        for b in batches:
            names = b.schema.names
            hits = b.column(names.index("__hits")).to_pylist() if bad is None else [None] * b.num_rows
            rows = [clean(t, h) for t, h in zip(b.column(names.index("text")).to_pylist(), hits)]
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i, n in enumerate(names) if n != "__hits"), *new], names=[*(f.name for f in passed), *(f.name for f in extra)])

    return docs.mapInArrow(run, StructType([*passed, *extra]))


def remove_boilerplate(docs: DataFrame, min_sites: int = 5, band: float = 0.25, lg_k: int = 12, copy_share: float | None = None, few: int = 500_000) -> DataFrame:
    """docs with the columns n_lines, n_removed, clean_text; text itself is left as it was.

    Every line that stands on `min_sites` sites goes, however much of its document it is.  With `copy_share` a document
    that would lose over that share of its characters is looked at once more, since copies of one document on many
    sites spread all their lines: it loses the lines that reach `min_sites` sites when near copies among such documents
    count as one, and keeps those that only copying spreads.

    Up to `few` such lines are sent to the documents as hashes, so no text is shuffled; more are joined with the texts.

    Null text stays null with no lines; an empty text has one blank line; a document of boilerplate only becomes
    empty.  A null source is a site of its own.  Repeated rows, and rows of equal or null id, are treated alike by their
    text.  Empty table: no rows.  Other columns pass through; clashing names among the three added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "clean_text")
    added = ["n_lines", "n_removed", "clean_text"]

    def with_hits(d: DataFrame, hit: DataFrame) -> DataFrame:
        """d with __hits: the lines of hit(line) that each text has."""
        hits = lines.join(hit, "line").groupBy(F.col("key").alias("__hit")).agg(F.collect_set("line").alias("__hits"))
        hits = mine.keep(stage(hits, "line-hits"))
        return d.withColumn("__row", text_key(F.col("text"))).join(hits, F.col("__row") == F.col("__hit"), "left").drop("__hit", "__row")

    with Temporary() as mine:
        found, lines = boilerplate_lines(docs, min_sites, band, lg_k)
        found = stage(found.select("line"), "bad-lines")
        bad = {r.line for r in found.collect()} if found.count() <= few else None
        d, proven = docs if bad is not None else with_hits(docs, found), None
        if copy_share is not None:
            marked = _cleaned(d, bad, None, copy_share)
            suspects = stage(marked.where("not __own").select(text_key(F.col("text")).alias("key"), "text", site_of(F.col("source")).alias("site"), F.col("__bad").alias("bad")), "line-suspects")
            left = stage(independent_lines(suspects, lines, min_sites), "proven-lines")
            if left.count() > few:
                again = _cleaned(with_hits(marked.where("not __own").select(*docs.columns), left), None, None, None)
                return marked.where("__own").unionByName(again).select(*docs.columns, *added)
            proven = {r.line for r in left.collect()}
    return _cleaned(d, bad, proven, copy_share).select(*docs.columns, *added)
