"""Shards are written by many tasks and chosen as wholes."""

from corpusloom.plans import io
from corpusloom.sources import readers


def test_shards_of_many_files(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "array(cast(id as int)) tokens", "id % 5 g").repartition(4)
    rows.write.partitionBy("g").parquet(f"{tmp_path}/t")
    ids = lambda mode, *at: sorted(r["id"] for r in readers.token_shards(spark, f"{tmp_path}/t", mode, *at, folders=True).collect())
    assert ids("full") == list(range(100))
    assert ids("single") == [i for i in range(100) if i % 5 == 0]
    assert ids("split", 0, 2) == [i for i in range(100) if i % 5 < 3] and ids("split", 1, 2) == [i for i in range(100) if i % 5 > 2]


def test_query_writes_shards_in_many_tasks(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "a bb ccc") for i in range(40)], "doc_id bigint, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    monkeypatch.setattr(io, "here", lambda s, tag: kept.append(f"{tmp_path}/out") or kept[0])
    with_old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        got = {r["mode"]: (r["n"], r["tokens"]) for r in io.s16(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", with_old)
    assert got == {"full": (40, 120), "single": (8, 24), "split": (16, 48)}
    assert len(list((tmp_path / "out" / "g=0").glob("*.parquet"))) > 1
