"""Language, toxicity, fingerprints by weighted sampling, segmentation."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import cws, langid, sentencepiece_nbest, toxicity

P = pytest.importorskip("public_tokenizers")
WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas".split(),
}


def corpus(n, seed=0):
    rng = random.Random(seed)
    langs = [*WORDS]
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]]) for _ in range(80)), langs[i % 3]) for i in range(n)]


def test_language_of_held_out_texts_and_of_odd_ones(spark):
    rows = corpus(180) + [(1000, None, "en"), (1001, "", None), (1002, "123 !!", "de"), (1003, "der die das " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 120"), per_language=20, dict_chars=8000)
    assert [*model] == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.predict(df.withColumnRenamed("lang", "lang_pred"), model).collect()}
    assert sum(got[i].lang_pred == rows[i][2] for i in range(120, 180)) >= 59
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    odd = spark.createDataFrame([(1, "½ ²"), (2, "ⅷ 7"), (3, "a"), (4, "_-_")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.predict(odd, model).collect()} == {1: True, 2: True, 3: False, 4: True}
    empty = langid.predict(df, langid.fit(df.limit(0)))
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert langid.predict(df.limit(0), model).collect() == []


def test_languages_by_code_lengths_of_fresh_compressors(spark):
    """Every text compressed on its own, piece by piece, with a compressor made for it."""
    import zstandard as z

    rows = corpus(90, 4) + [(500 + i, w, None) for i, w in enumerate(["a", "die", "Être ou ne pas", "x" * 9000, "der the le " * 900])] + [(3, "of the and", "en"), (3, "of the and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 60"), per_language=15, dict_chars=6000)
    model["aa"] = model["en"]  # a tie: the smaller name
    model = dict(sorted(model.items()))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        t = langid.fold(r.text)
        sizes = {}
        for name, content in model.items():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            fresh = lambda: z.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False)  # noqa: B023, E731
            sizes[name] = sum(len(fresh().compress(t[i : i + langid.PIECE])) for i in range(0, len(t), langid.PIECE))
        best = min(sizes.values())
        assert r.lang_pred == min(k for k, v in sizes.items() if v == best) and r.lang_pred != "en"
        second = sorted(sizes.values())[1]
        assert abs(r.lang_margin - (second - best) / best) < 1e-12


def test_fit_takes_equal_texts_once_whatever_their_ids(spark):
    rows = [(1, "the same text of many rows", "en")] * 50 + [(None, "the same text of many rows", "en")] * 50 + [(i, f"other text {chr(97 + i)} of the", "en") for i in range(8)] + [(9, "le texte est ici", "fr"), (10, "", "fr"), (11, None, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    a, b = langid.fit(df, per_language=20), langid.fit(df.dropDuplicates(["text", "lang"]), per_language=20)
    assert a == b and [*a] == ["en", "fr"] and a["en"].count(b"same text") == 1
    with pytest.raises(ValueError, match="2 languages; the limit is 1"):
        langid.fit(df, max_languages=1)


def test_folding_undoes_disguises():
    assert toxicity.fold("You ІDI0T, 1d!ot and ｌｏｓｅｒ") == " you idiot idiot and loser "
    assert toxicity.fold("call 555 1234 or +1 (2)") == " call or "
    assert toxicity.fold("") == "  "


def test_toxicity_is_learned_and_normalised(spark):
    rng = random.Random(3)
    plain = [w for ws in WORDS.values() for w in ws]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["zorgle", "blaxtor", "Fenwick", "zorglex"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None), (1001, ""), (1002, "z0rgle blахtor " + " ".join(plain)), (1003, " ".join(plain * 300) + " zorgle")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    lex = toxicity.fit(df.where("doc_id < 300"), lab)
    got = {r.doc_id: r.tox_score for r in toxicity.score(df.withColumn("tox_score", df.doc_id), lex).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300, 400))
    assert got[1000] == got[1001] < 0.5 and got[1002] >= 0.7 and got[1003] < 0.7
    repeated = toxicity.fit(df.where("doc_id < 300").unionByName(df.where("doc_id < 300")), lab.unionByName(lab))
    assert repeated.entries == lex.entries and (repeated.slope, repeated.bias) == (lex.slope, lex.bias)
    spared = toxicity.Lexicon({" trash": 5.0}, ("trash can",), 1.0, 0.0)
    a = spared.automaton()
    assert toxicity.Lexicon.weigh(a, toxicity.fold("a trash can"))[0] == 0 and toxicity.Lexicon.weigh(a, toxicity.fold("what trash"))[0] == 5
    none = toxicity.fit(df.limit(0), lab)
    assert {r.tox_score >= 0.7 for r in toxicity.score(df, none).collect()} == {False}


def naive_weight(lexicon, folded):
    """Every entry tried at every word by comparing strings, exceptions by searching for them."""
    spared = []
    for e in lexicon.exceptions:
        p = toxicity.fold(e)
        at = folded.find(p)
        while at >= 0:
            spared.append((at, at + len(p) - 1))
            at = folded.find(p, at + 1)
    total = 0.0
    for at, c in enumerate(folded):
        if c == " " and not any(a <= at < b for a, b in spared):
            total += max((w for p, w in lexicon.entries.items() if folded.startswith(p, at) and w > 0), default=0.0)
    return total


def test_weights_equal_a_naive_search_without_the_automaton(spark):
    rng = random.Random(8)
    parts = ["zor", "gle", "trash", "can", "clown", "fish", "a", "is", "Z0r", "tr4sh", "сan"]
    texts = ["", "  ", "zor", "trash can"] + [" ".join("".join(rng.choices(parts, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    lexicon = toxicity.Lexicon({" zor": 2.0, " zorgle": 3.5, " trash": 1.5, " clown ": 2.5, " gle ": 1.0, " is": 0.5}, ("trash can", "clown fish", "is a zor"))
    a = lexicon.automaton()
    for t in texts:
        assert abs(toxicity.Lexicon.weigh(a, toxicity.fold(t))[0] - naive_weight(lexicon, toxicity.fold(t))) < 1e-9
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    for r in toxicity.score(df, lexicon).collect():  # one id for all rows: each is scored by its text
        f = toxicity.fold(r.text)
        assert abs(r.tox_score - lexicon.score(naive_weight(lexicon, f), max(0, f.count(" ") - 1))) < 1e-9


def test_exceptions_are_learned_from_harmless_phrases(spark):
    rng = random.Random(9)
    plain = [w for ws in WORDS.values() for w in ws]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[3] = words[20] = "grunk"
        elif i % 40 == 1:
            words[5:7] = ["grunk", "valve"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.fit(df, lab)
    assert any(p.strip() in "grunk" for p in lex.entries) and "grunk valve" in lex.exceptions
    got = toxicity.score(spark.createDataFrame([(1, "the grunk valve of this"), (2, "the grunk of this")], "doc_id long, text string"), lex).collect()
    assert got[0].tox_weight == 0 < got[1].tox_weight


def jaccard(a, b):
    def terms(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    x, y = terms(a), terms(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = random.Random(5)
    s, err = cws.Sampler(), []
    for _ in range(60):
        base = [rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(150)]
        other = base[: rng.randrange(150)] + [rng.choice("hijk") for _ in range(rng.randrange(80))]
        a, b = " ".join(base * rng.randint(1, 2)), " ".join(other)
        err.append(cws.likeness(s.fingerprint(a), s.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(err)) < 0.03 and np.std(err) < 0.09
    for n in (30_000, 100_000):  # lanes share a table of draws: no bias in long texts either
        words = [f"w{k}" for k in range(n)]
        a, b = " ".join(words), " ".join(words[: n * 2 // 3] + [f"v{k}" for k in range(n // 3)])
        assert abs(cws.likeness(s.fingerprint(a), s.fingerprint(b)) - jaccard(a, b)) < 0.2
    assert cws.likeness(s.fingerprint("a b c d e f"), s.fingerprint("A  B c d e\nf")) == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_and_edited_texts(spark, parts):
    rows = [(i, f"document {i} " + " ".join(random.Random(i % 7).choices("uvwxyz", k=20 + i))) for i in range(40)] + [(50, None), (51, ""), (52, "é漢 " * 3000), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("fingerprint", F_lit("x"))
    got = {r.doc_id: r for r in cws.fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    s = cws.Sampler()
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == s.fingerprint(t).tobytes().hex() and r.edited_fingerprint == s.fingerprint(e).tobytes().hex()
        assert r.near_next == cws.likeness(s.fingerprint(t), s.fingerprint(n))
    one = cws.fingerprints(df.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert cws.fingerprints(df.limit(0)).collect() == []


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_scores_of_the_model_count_where_it_has_them():
    assert sentencepiece_nbest.piece_scores([-1.25, -2.0, -7.0004]) == [-1250, -2000, -7000]
    zipf = sentencepiece_nbest.piece_scores([0.0, -1.0, -2.0, -1e9])
    assert zipf == sorted(zipf, reverse=True) and abs(sum(np.exp(x / 1000) for x in zipf) - 1) < 0.01


@pytest.fixture(scope="module")
def segmenter():
    return sentencepiece_nbest.Segmenter(P.path("piece_bpe_32k.model"), limit=50)


def every_segmentation(v, text):
    s = "▁" + text.replace("▁", " ").replace(" ", "▁")
    into = v.edges(s)

    def paths(j):
        return [(0, ())] if j == 0 else [(a + w, p + tuple(ids)) for i, ids, w in into[j] for a, p in paths(i)]

    return sorted(paths(len(s)), key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_equals_enumeration_and_decodes(segmenter, n):
    rng = random.Random(n)
    texts = ["a", "the cat", "  a ", " é漢", "ab ▁c", "x\ny\tz"] + ["".join(rng.choice("aeth nis漢 \n") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for t, (raw, score, alts) in zip(texts, segmenter.encode(texts, n)):
        want = every_segmentation(segmenter.v, t)[:n]
        assert [score - a for a, _ in alts] == [w for w, _ in want]
        assert sum(segmenter.v.score.get(i, segmenter.v.byte_score) for i in np.frombuffer(raw, np.uint16).tolist()) == score
        assert segmenter.decode(raw) == t.replace("▁", " ")
        import sentencepiece

        assert sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).decode(np.frombuffer(raw, np.uint16).tolist()) == t.replace("▁", " ")


def test_encoding_of_a_table_with_odd_rows(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 8000), (5, "x" * 5000), (1, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F_lit("clash"))
    got = {r.doc_id: r for r in sentencepiece_nbest.encode(df, P.path("piece_bpe_32k.model"), 3).collect()}
    assert all(got[i].decoded == (t or "") for i, t in rows) and got[2].n_tokens == 0 and got[4].n_tokens == len(got[4].ids)
    assert got[1].losses[0] == 0 and got[1].losses == sorted(got[1].losses) and len(got[1].edits) == 3
    assert sentencepiece_nbest.encode(df.limit(0), P.path("piece_bpe_32k.model")).collect() == []


def test_workers_keep_no_solved_units_between_tasks(spark):
    import public_tokenizers as P

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            pass
        kinds = [type(x).__name__ for x in gc.get_objects()]
        yield pa.RecordBatch.from_arrays([pa.array([kinds.count(k)], pa.int64()) for k in ("Pieces", "Segmenter")], names=["pieces", "solved"])

    docs = spark.range(64).selectExpr("concat('some words of text ', id) as text").repartition(4)
    assert sentencepiece_nbest.encode(docs, P.path("piece_bpe_32k.model")).where("decoded = text").count() == 64
    found = spark.range(8).repartition(8).mapInArrow(held, "pieces long, solved long").collect()
    assert sum(r.pieces for r in found) and not sum(r.solved for r in found)
