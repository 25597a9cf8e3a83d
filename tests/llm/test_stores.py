"""Token store, WARC archives, mixing, the queries and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import mixing, token_store, warc
from vecloom.llm.common import new_path

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_piecewise_encoding_equals_the_librarys(tokenizer):
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " a", "a ", "a \nb", "a\n b", "x <|endoftext|> y", "don't 's it' s", "é è  b 　c", "\x1f a \x1cb", "a​ b", "Ωmega ßtraße, ñandú."]
    texts += ["".join(rng.choice(" \n\t ab'1é.,漢s ") for _ in range(rng.randint(0, 30))) for _ in range(800)]
    e = token_store.Encoder(P.path("byte_bpe_50k.json"), "<u2", limit=20)
    want = [np.array(x.ids, "<u2").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts) == want
    assert np.frombuffer(e.encode(["x <|endoftext|> y"])[0], "<u2").tolist() == [87, 220, 50256, 331]
    plain = token_store.Encoder(P.path("byte_bpe_50k.json"), "<u2", plain_text=True)
    assert 50256 not in np.frombuffer(plain.encode(["x <|endoftext|> y"])[0], "<u2") and plain.encode(texts[:8]) == want[:8]


def test_words_are_spelled_at_once_as_the_library_spells_each():
    from tokenizers.pre_tokenizers import ByteLevel

    spell = ByteLevel(add_prefix_space=False, use_regex=False)
    words = [c + "a" + c for c in map(chr, range(0x250)) if c.isalpha()]
    enc = token_store.Encoder(P.path("byte_bpe_50k.json"), "<u2")
    assert enc.spell(words).split(" ") == [spell.pre_tokenize_str(" " + w)[0][0] for w in words]
    whole = enc.tok.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
    assert enc.spaced_ids(words) == {w: np.array(e.ids, "<u2").tobytes() for w, e in zip(words, whole)}


def test_store_reads_back_what_was_written(spark, tokenizer):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(words, k=900))
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1200)))) for i in range(30)]
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200 + i, f"{' '.join(rng.choices(words, k=300))} {passage} end {i}") for i in range(6)]
    rows += [(290, "of <|endoftext|> and on"), (300, None), (301, ""), (302, passage * 3), (302, passage * 3), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("n", F.lit("clash"))
    folder = token_store.write(df, P.path("byte_bpe_50k.json"))
    got = sorted(token_store.read(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    packs = spark.read.parquet(f"{folder}/packs")
    distinct = packs.select(F.explode("digests").alias("x")).distinct().count()
    assert packs.agg(F.sum(F.size("owned"))).first()[0] == distinct < packs.agg(F.sum(F.size("digests"))).first()[0]
    lost = f"{folder}-lost"  # a pack that lost a document
    packs.where("doc_id is null or doc_id <> 5").write.parquet(f"{lost}/packs")
    spark.read.parquet(f"{folder}/manifest").write.parquet(f"{lost}/manifest")
    with pytest.raises(ValueError, match="don't match the manifest"):
        token_store.read(spark, lost)
    empty = token_store.read(spark, token_store.write(df.limit(0), P.path("byte_bpe_50k.json")))
    assert empty.collect() == []


def test_a_damaged_chunk_is_noticed(spark):
    with pytest.raises(ValueError):
        token_store._checked(b"\1\0\2\0", [2], [token_store.digest(b"\1\0\3\0")], token_store.digest(b"\1\0\3\0"), 2)


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    ids, gear = rng.integers(0, 50257, 20_000).astype("<u2"), token_store.gear_table(50257)
    a, b = token_store.cut_points(ids, gear), token_store.cut_points(np.concatenate([ids[:100], ids]), gear)
    assert a[-1] == 20_000 and all(token_store.LEAST <= y - x <= token_store.MOST for x, y in zip(a, a[1:-1]))
    assert len(set(a) & {x - 100 for x in b}) > 0.8 * len(a)


def test_archives_are_read_back_record_by_record(spark):
    big = "<p>" + "x" * 2000 + "é</p>"
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u\r\nInjected: 1", None), (7, "u", ""), (None, "u", big), (5, "http://a/5", big)]
    rows += [(100 + i, "u", f"page {i} " * 300) for i in range(200)] + [(400, "u", "beyond a frame " * 40_000), (401, "u", "beyond a frame " * 40_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit(1))
    index, read = warc.archive(df, frame_bytes=20_000, archive_bytes=60_000)
    got = read.collect()
    assert len(got) == len(rows) == index.count()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (1, 2, 3, 4, 5, 6, 7, None)}
    assert kinds == {(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (2, "response", None), (4, "response", None), (6, "response", None), (7, "response", None), (None, "response", None)}
    assert {r.payload_bytes for r in got if r.page_id in (1, 3, 5)} == {len(big.encode())}
    assert {(r.page_id, r.record_type, r.payload_bytes) for r in got if r.page_id in (400, 401)} == {(400, "revisit", 600_000), (401, "response", 600_000)}
    assert warc.read_record(index, 401)[1].decode() == "beyond a frame " * 40_000
    # more repeated payloads than are broadcast: the same plan by a shuffle join
    key = lambda d: sorted((str(r.page_id), r.digest, str(r.refers_to)) for r in d.select("page_id", "digest", "refers_to").collect())
    assert key(warc.revisit_plan(df, few=0)) == key(warc.revisit_plan(df))
    head, block = warc.read_record(index, 150)
    assert block.decode() == "page 50 " * 300 and head["WARC-Record-ID"] == "<urn:page:150>"
    assert warc.archive(df.limit(0))[1].collect() == []


def filled(sizes, weights, cap):
    """Resharing round by round."""
    total, left, target = sum(sizes), dict(enumerate(sizes)), [0.0] * len(sizes)
    free = float(total)
    while left:
        w = sum(weights[i] for i in left)
        over = [i for i in left if free * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in left:
                target[i] = free * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            free -= target[i]
            del left[i]
    return target


def test_targets_and_taken_words(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 200), rng.choice(["a", "b", "b", "b", "b", "b", "c", "Z", None])) for i in range(600)]
    rows += [(690, "w " * 30_000, "b"), (700, None, "a"), (701, "", "only empty"), (None, "x y z", "a"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = dict(zip(names, filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    for n, size in zip(names, sizes):
        mine = [r for r in got if r.source == n]
        assert {r.source_size for r in mine} == {size} and all(abs(r.target - want[n]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[n]) <= 1
    assert all(r.taken <= 3 * r.size for r in got) and len(got) == len(rows)
    assert mixing.mix(df.limit(0)).collect() == []


def test_whole_documents_meet_the_targets_and_null_ids_are_their_own(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(900)]
    rows += [(None, f"n{i} words of a row without id", s) for i in range(3) for s in "abc"] + [(5, "another text of an id", "a"), (950, None, "a"), (951, "  ", "b"), (952, "w " * 20_000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    got = mixing.mixed(df).collect()
    assert Counter(got) == Counter(mixing.mixed(df.repartition(7)).collect()) and got[0].target == "clash"
    target = {r.source: (r.target, r.source_size) for r in mixing.mix(df.drop("target")).collect()}
    for name, (goal, size) in target.items():
        mine = [r for r in got if r.source == name]
        longest = max(len((t or "").split()) for _, t, s in rows if s == name)
        assert abs(sum(len((r.text or "").split()) for r in mine) - goal) <= longest / 2 + 1
        times = Counter((r.doc_id, r.text) for r in mine)
        assert all(int(goal // size) <= times[i, t] <= int(goal // size) + 1 for i, t, s in rows if s == name)
    assert mixing.mixed(df.limit(0)).collect() == []


def test_queries_run_over_whole_tables(spark):
    from vecloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    size = {"op3_cover_tree": spark.read.parquet(f"{d}/embeddings.parquet").count(), "op6_warc": spark.read.parquet(f"{d}/pages.parquet").count()}
    for name, q in QUERIES.items():
        assert q(spark, d).count() == size.get(name, docs), name


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline as cp

    text = {i: " ".join(random.Random(i).choices("the of and to in is that it was for on are with as".split(), k=60)) for i in range(60)}
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in text.items()] + [(100, text[5], "en", "s1", 1), (101, text[5].upper(), "en", "s2", 1), (102, None, "en", None, 0), (103, "", None, "s1", 0), (None, text[7] + " x", "en", "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    for name, f in cp.STAGES[:-1]:
        before, docs = docs, f(spark, docs, "")
        assert docs.columns == before.columns
        path = new_path(spark, "t")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {*text, 100, 101, None}
        if name == "near_dedup":
            assert ids == {*text, None}
    out = cp.STAGES[-1][1](spark, docs, "").collect()
    assert out and all(r.round_trip for r in out)
    for _, f in cp.STAGES:
        assert f(spark, docs.limit(0), "").collect() == []


def test_staged_tables_keep_types_and_nulls_and_go_with_their_owner(spark):
    from decimal import Decimal

    from vecloom.llm import common

    kinds = "a long, b string, c struct<x: string not null, y: array<int> not null>, d decimal(38,0), e array<binary>, f map<string,double>, g boolean, h timestamp, i array<array<struct<u: int, v: array<int>>>>"
    import datetime

    rows = [(1, "é", ("x", [1, 2]), Decimal(3), [b"1", None], {"k": 1.5}, True, datetime.datetime(2020, 1, 1), [[(1, [2])], []]), (None,) * 9]
    df = spark.createDataFrame(rows, kinds).repartition(3)
    with common.Temporary() as outer:
        with common.Temporary() as inner:
            kept, lost = inner.keep(common.stage(df, "t")), common.stage(df, "t")
            assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
        assert kept.count() == 2 and kept._staged_path in outer.staged
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(lost._staged_path)
        assert not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)
    assert common.stage(df.limit(0), "t").collect() == []


def test_a_worker_drops_what_earlier_tasks_made(monkeypatch):
    import sys
    from types import SimpleNamespace

    from pyspark import TaskContext
    from vecloom.llm.common import worker_cache

    monkeypatch.setattr(sys, "_vecloom_cache", {}, raising=False)
    made = []
    for task, slot in [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (4, "a")]:
        monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls, task=task: SimpleNamespace(taskAttemptId=lambda: task)))
        worker_cache(slot, 0, lambda: made.append((task, slot)))
    assert made == [(1, "a"), (1, "b"), (3, "c"), (4, "a")] and [*sys._vecloom_cache] == ["a"]
