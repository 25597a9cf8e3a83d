"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

STAGES is a list of (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of docs.  Each stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import langid, line_spread, mixing, near_copies, sentencepiece_nbest
from vecloom.llm.common import Temporary, bounded_batches, discard, stage, table
from vecloom.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or in doubt go; `lang` becomes the predicted language.

    Null and empty texts and those without a letter go.  Repeated rows are judged alike.  Empty table: no rows.
    """
    bounded_batches(spark)
    learn = docs.where(langid.training_rows(F.col("doc_id"))).select("doc_id", "text", "lang")
    out = langid.predict(docs, langid.fit(learn)).where(~langid.rejected())
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts, those of short pages too; n_chars follows.

    Lines that only copies of one document spread stay.  No row goes: null texts stay null, texts of nothing but
    boilerplate become empty, repeated rows are treated alike.  Empty table: no rows.
    """
    out = line_spread.remove_boilerplate(docs, copy_share=0.5)
    return out.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays, once (null doc_ids: all stay).

    SimHash fingerprints compared bit-sliced, then the shingles.  Of rows that share a doc_id each text counts for
    itself.  Null and empty texts are copies of one another.  Empty table: no rows.
    """
    return near_copies.kept(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (whole documents).

    Null sources are one source, the last; null texts have no words and come in whole passes only; null doc_ids are told
    apart by their texts; rows of equal id and text are taken alike.  Empty table: no rows.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the losses of the next-best segmentations, and whether the ids decode to the text.

    Null and empty texts have no ids.  Repeated rows are encoded each.  Empty table: no rows.
    """
    out = sentencepiece_nbest.encode(docs, tokenizer("piece_bpe_32k.model"), n_best=4)
    round_trip = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_nbest.MARK, " ")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_crc32", "ids", "score", "losses", round_trip.alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage but the last is staged in the shared folder.

    What a stage staged for itself is deleted when its result is written, a result when the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        with Temporary() as mine:
            docs = mine.keep(stage(f(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express compression classifiers, hashes of words and segmentations.
ORACLE_SQL = None
