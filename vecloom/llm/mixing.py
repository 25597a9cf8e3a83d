"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the words in proportion to its weight, but at most `max_epochs` times the words it has;
what the capped sources leave goes to the others by weight until none is above its cap.  A source's target is then
taken as whole passes over all its documents and one fractional pass over a seeded prefix of a random order.

Plan: sizes are counted once; one aggregation by (source, bucket of a seeded hash) yields the source sizes and the
running offsets of the buckets.  The hash buckets split a hot source over `buckets` groups, and the running sum inside
a bucket is a window over that bucket alone; no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Temporary, sent, stage


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target.

    Sources are ordered by code point, null last, and take the weights in turn.  In the order of cap/weight the
    capped sources are a prefix: one is capped if the level that holds with all before it capped exceeds its own
    ratio, and the final level is the largest of these levels.  The table has one short row per source.
    """
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (
        sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    level = (F.sum("source_size").over(every) - (F.sum("cap").over(by_ratio) - F.col("cap"))) / (
        F.sum("w").over(every) - (F.sum("w").over(by_ratio) - F.col("w"))
    )
    return t.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.max("level").over(every) * F.col("w")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_epochs: float = 3.0,
    seed: int = 7,
    buckets: int = 4096,
) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, repeats, taken.

    `repeats`: whole passes that take the document.  `taken`: words taken, repeats counted; the last document of the
    fractional pass is cut at the word where its source reaches the target, so a source misses its target by less than
    one word.  Reruns agree: the order in the fractional pass is that of md5(seed, doc_id).

    Null text: size 0, taken 0.  Null source: a source of its own, the last.  Null doc_id: an id of its own.  Repeated
    rows count one by one.  Empty table: no rows.  Other columns are ignored.
    """
    assert buckets == 4096, "a bucket is three hexadecimal digits"
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = stage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h")).withColumn("bucket", F.substring("h", 1, 3)),
        "mix-sizes",
    )
    part = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goal = source_targets(part.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    p, g = part.alias("p"), goal.alias("g")
    plan = p.join(g, F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        F.col("p.source").alias("p_source"),
        F.col("p.bucket").alias("p_bucket"),
        "source_size",
        "target",
        (F.sum("n").over(Window.partitionBy("p.source").orderBy("p.bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = sized.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    out = (
        running.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
        .withColumn("whole", whole)
        .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long") - F.col("before") - F.col("inside"))
    )
    repeats = F.col("whole") + F.when((F.col("size") > 0) & (F.col("rest") >= F.col("size")), 1).otherwise(0)
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("rest"), F.col("size")))
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.cast("long").alias("repeats"), taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7, few: int = 100_000) -> DataFrame:
    """docs(doc_id, text, source, ...), each row as many times as the mix takes it, whole documents only.

    The order in the fractional pass is that of (md5(seed, doc_id), doc_id, hash of the text).  It takes the rows of a
    source up to the last one of which at least half is within the target, so a decision is a comparison with one key
    a source: sizes and keys are aggregated without texts, only the hash bucket that has the key is ordered, and the
    keys are sent to the rows.  Texts are not shuffled unless there are over `few` sources.

    Null text: size 0, in whole passes only.  Null source: a source of its own, the last.  Null doc_id: told apart by
    the text.  Rows of equal id and text are taken alike (all or none in the fractional pass, by half of their sum).
    Empty table: no rows.  Columns pass through.
    """
    text = F.coalesce("text", F.lit(""))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    key = {"__h": h, "__d": F.col("doc_id").cast("long"), "__t": F.xxhash64(text)}
    with Temporary() as mine:
        words = docs.select("source", word_count(F.col("text")).alias("size"), *(c.alias(k) for k, c in key.items()))
        rows = stage(words.groupBy("source", *key).agg(F.sum("size").alias("n")).withColumn("bucket", F.substring("__h", 1, 3)), "mix-sizes")
        part = stage(rows.groupBy("source", "bucket").agg(F.sum("n").alias("n")), "mix-buckets")
        goal = source_targets(part.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        goal = goal.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        goal = stage(goal.withColumnRenamed("source", "g_source"), "mix-targets")
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        before = part.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        same = F.col("source").eqNullSafe(F.col("g_source"))
        last = before.join(goal, same).where(F.col("before") < F.col("rest")).groupBy("g_source").agg(F.max(F.struct("bucket", "before")).alias("x"))
        last = last.select("g_source", F.col("x.bucket").alias("__bucket"), F.col("x.before").alias("before"))
        last = stage(goal.join(last.withColumnRenamed("g_source", "l_source"), F.col("g_source").eqNullSafe(F.col("l_source")), "left").drop("l_source"), "mix-last")
        inside = rows.join(sent(last, few), same & (F.col("bucket") == F.col("__bucket"))).where("n > 0")
        order = Window.partitionBy("source").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
        left = F.col("rest") - F.col("before") - (F.sum("n").over(order) - F.col("n"))
        fits = inside.withColumn("left", left).where(F.col("left") * 2 >= F.col("n"))
        ends = fits.groupBy("source").agg(F.max(F.struct(F.col("__h"), F.coalesce("__d", F.lit(-(1 << 63))).alias("__d"), F.col("__t"))).alias("__end")).withColumnRenamed("source", "e_source")
        ends = last.join(ends, F.col("g_source").eqNullSafe(F.col("e_source")), "left").select("g_source", F.col("whole").alias("__whole"), "__bucket", "__end")
        ends = mine.keep(stage(ends, "mix-ends"))
    own = F.struct(h.alias("__h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__d"), F.xxhash64(text).alias("__t"))
    bucket = F.substring(h, 1, 3)
    extra = F.rlike(text, F.lit(WORD)) & ((bucket < F.col("__bucket")) | ((bucket == F.col("__bucket")) & (own <= F.col("__end"))))
    times = (F.col("__whole") + F.when(extra, 1).otherwise(0)).cast("int")
    taken = docs.join(sent(ends, few), F.col("source").eqNullSafe(F.col("g_source"))).withColumn("__times", times).where("__times > 0")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
