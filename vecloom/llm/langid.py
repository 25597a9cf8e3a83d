"""Language identification by compression.

Each language is a Zstandard raw-content dictionary made of training text.  A text is folded (lower case, letters
only) and compressed once with every dictionary; the dictionary that yields the fewest bytes names the language.  The
score is the share of that language in the code-length posterior 2^-bits, tempered; a narrow margin is a low score.

The classifier is fitted on a bounded sample: `per_language` different texts of each language in the order of a seeded
hash of the text, `dict_chars` characters of them all (equal shares, the first characters of each).  Counts of documents
and languages do not matter to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage, worker_cache

UNKNOWN = "und"
#: Level of Zstandard, bytes of a piece, characters of a training segment.
LEVEL, PIECE, SEGMENT = 6, 2000, 400


def fold(text: str) -> bytes:
    """Lower case, runs of anything but letters as one space."""
    import re

    return re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace")


def training_rows(doc_id: Column) -> Column:
    """The rows that may be learned from: crc32 of the id as text, modulo 4, is not 2 (a null id counts as text 'null')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 != 2


def compressors(contents: list[bytes], level: int) -> list:
    import zstandard as z

    out = []
    for c in contents:
        d = z.ZstdCompressionDict(c, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(z.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False))
    return out


def code_lengths(cs: list, folded: bytes, piece: int = PIECE) -> list[int]:
    """Bytes by dictionary, summed over all pieces of the text, so that a long text is not judged by its own repetitions."""
    parts = [folded[i : i + piece] for i in range(0, len(folded), piece)]
    return [sum(len(c.compress(p)) for p in parts) for c in cs]


def _agreeing(by: dict[str, list[str]], level: int) -> dict[str, list[str]]:
    """The segments that dictionaries made of the other half of the segments give their own label."""
    names = [*by]
    out: dict[str, list[str]] = {k: [] for k in names}
    for half in (0, 1):
        cs = compressors([" ".join(by[k][half::2]).encode() or b" " for k in names], level)
        for k in names:
            for s in by[k][1 - half :: 2]:
                sizes = code_lengths(cs, s.encode())
                if names[sizes.index(min(sizes))] == k:
                    out[k].append(s)
    return {k: out[k] or by[k] for k in names}


def fit(labelled: DataFrame, per_language: int = 48, dict_chars: int = 96_000, max_languages: int = 256, clean_rounds: int = 2, level: int = LEVEL) -> dict[str, bytes]:
    """labelled(doc_id, text, lang) -> {language: dictionary content}; every language that has a letter in its sample.

    Rows with a null language and null or empty texts are not learned from.  Equal texts of a language count once,
    whatever their ids; one that has several labels is learned under each.  Only hashes are ranked (the window keeps
    `per_language` of them a language on the map side); then the chosen texts are read by hash.  At most
    per_language * languages texts come to the driver, the first characters of each up to its share of dict_chars.
    Wrong labels and foreign passages are weeded out by cross-fitting on segments of the sample.  More than
    max_languages languages is an error, found before anything is collected.
    """
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("t"))
    hashes = stage(rows.select("lang", "t").distinct(), "langid-hashes")
    languages = hashes.select("lang").distinct().count()
    if languages > max_languages:
        raise ValueError(f"{languages} languages; the limit is {max_languages}")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("t", F.lit(11)), "t")
    chosen = hashes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_language).select("t").collect()
    discard(hashes)
    if not chosen:
        return {}
    share = max(1, dict_chars // per_language)
    wanted = rows.where(F.col("t").isin(*{r.t for r in chosen}))
    got = wanted.groupBy("lang", "t").agg(F.min(F.substring("text", 1, 4 * share)).alias("text")).collect()
    by: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.t)):
        t = fold(r.text).decode()[:share]
        by.setdefault(r.lang, []).extend(x for i in range(0, len(t), SEGMENT) if (x := t[i : i + SEGMENT]).strip())
    by = {k: v for k, v in sorted(by.items()) if v}
    for _ in range(clean_rounds if len(by) > 1 else 0):
        by = _agreeing(by, level)
    return {k: " ".join(v).encode() for k, v in by.items()}


def predict(docs: DataFrame, model: dict[str, bytes], level: int = LEVEL, temper: float = 0.05) -> DataFrame:
    """docs + lang_pred string, lang_score double, lang_margin double.

    lang_margin: bits saved against the second language as a share of the best length.  Null text or no letter
    (str.isalpha): 'und', score 0, margin 0.  Rows of equal text get equal results, whatever their ids.  Ties: the smaller language name.  With an empty model everything is 'und'.  Whole texts
    are compressed, of any length.  Columns of the same names are replaced; other columns pass through.
    """
    names, contents = [*model], [*model.values()]
    docs = docs.drop("lang_pred", "lang_score", "lang_margin")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(contents)  # bounded: max_languages dictionaries of dict_chars characters

    key = (tuple(contents), level)

    def classify(text):
        if text is None or not names:
            return UNKNOWN, 0.0, 0.0
        if not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        t = fold(text)
        sizes = code_lengths(worker_cache("langid", key, lambda: compressors(shipped.value, level)), t)
        best = min(sizes)
        score = 1 / sum(2.0 ** (-8 * temper * min(s - best, 2000)) for s in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else best * 2
        return names[sizes.index(best)], score, (second - best) / best

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [classify(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            arrays = [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "lang_pred", "lang_score", "lang_margin"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    extra = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_margin", DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *extra]))


def rejected(min_margin: float = 0.001) -> Column:
    """Rows of predict() whose language is unknown or whose margin is narrow."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("lang_margin") < min_margin)
