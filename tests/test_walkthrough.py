"""From an empty journal to a search, through the command line, and the same journal as a stream."""

from vecloom.__main__ import main
from vecloom.operators.search import search
from vecloom.plans.catalog import Catalog
from vecloom.streaming.refresh import append_and_refresh

DOCS = [(1, [1.0, 0.0, 0.0], False, 1), (2, [0.9, 0.1, 0.1], False, 2), (3, [0.0, 1.0, 0.0], False, 3), (4, [0.0, 0.0, 1.0], False, 4), (5, [0.6, 0.6, 0.0], False, 5)]
SCHEMA = "id long, vec array<double>, del boolean, ver long"


def test_walkthrough(spark, tmp_path, capsys):
    root, journal = f"file://{tmp_path}/x", f"file://{tmp_path}/j"
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(journal)
    main([root, "register", "docs", journal, "id", "vec", "--op", "del", "--ver", "ver", "--metric", "cosine", "--margin", "0"], spark)
    main([root, "refresh", "docs"], spark)
    assert "full (first build): 5 vectors" in capsys.readouterr().out
    c = Catalog(spark, root)
    found = search(c, "docs", query="[1, 0.2, 0]", k=3).collect()
    assert [r.id for r in found] == [2, 1, 5] and [r.rank for r in found] == [1, 2, 3]
    assert abs(found[1].score - 0.9805807) < 1e-6 and abs(found[2].score - 0.8320503) < 1e-6
    spark.createDataFrame([(2, None, True, 6), (4, [1.0, 0.2, 0.0], False, 7)], SCHEMA).write.mode("append").parquet(journal)
    assert [r.id for r in search(c, "docs", query="[1, 0.2, 0]", k=2).collect()] == [4, 1]
    assert [r.id for r in search(c, "docs", query="[1, 0.2, 0]", k=2, freshness="snapshot").collect()] == [2, 1]
    main([root, "refresh", "docs"], spark)
    main([root, "set", "docs", "precision_default=exact", "m=8"], spark)
    main([root, "status", "docs"], spark)
    main([root, "search", "docs", "[1, 0.2, 0]", "-k", "2"], spark)
    out = capsys.readouterr().out
    assert "incremental: 1 appended, 2 tombstoned, 0 unchanged, 0 absent" in out and "4 live vectors, 2 tombstones" in out
    main([root, "drop", "docs"], spark)
    assert c.names() == []


def test_stream_of_changes_ends_where_one_refresh_would(spark, tmp_path):
    root, journal = f"file://{tmp_path}/x", f"file://{tmp_path}/j"
    rows = [*DOCS, (3, None, True, 8), (1, [0.0, 0.5, 0.5], False, 9)]
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{journal}/batch=-1")
    main([root, "register", "docs", journal, "id", "vec", "--op", "del", "--ver", "ver", "--margin", "0", "--type", "flat"], spark)
    c = Catalog(spark, root)
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        append_and_refresh(stream, c, "docs", f"{tmp_path}/check").awaitTermination()
        live = {r.id: r.vec for r in c.live(c.get("docs")).collect()}
        assert sorted(live) == [1, 2, 4, 5] and live[1] == [0.0, 0.5, 0.5]
    assert spark.read.parquet(journal).count() == len(rows)
