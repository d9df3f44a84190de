"""Collections, metadata, snapshots, logs and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from halyard.operators import metadata
from halyard.operators.collection import Collection, CollectionError
from halyard.sources import log, snapshot
from halyard.streaming import ingest

SCHEMA = "id long, embedding array<float>, tag string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def three(spark):
    return Collection.create(frame(spark, [(i, [float(i), 0.0], f"t{i}") for i in (1, 2, 3)]), 2)


def idlist(df):
    return sorted(r["id"] for r in df.select("id").collect())


def only_ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_insert(spark, three):
    more = three.insert(frame(spark, [(9, [1.0, 1.0], None)]))
    assert idlist(more.live()) == [1, 2, 3, 9] and idlist(three.live()) == [1, 2, 3]
    for bad in ([(1, [0.0, 0.0], None)], [(5, [0.0], None)], [(5, [float("nan"), 0.0], None)], [(0, [0.0, 0.0], None)], [(5, [0.0, 0.0], "a"), (5, [0.0, 1.0], "b")]):
        with pytest.raises(CollectionError):
            three.insert(frame(spark, bad))


def test_batch_insert(spark, three):
    batch = spark.createDataFrame([(0, 7, [1.0, 0.0]), (1, 7, [2.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 8, [0.0]), (4, 0, [0.0, 0.0]), (5, 6, [float("inf"), 0.0])], "n int, id long, embedding array<float>")
    done = three.batch_insert(batch, "n")
    assert idlist(done.live()) == [1, 2, 3, 7]
    assert done.get(7).first()["embedding"] == [1.0, 0.0]
    with pytest.raises(CollectionError):
        three.batch_insert(batch.where("n = 3"), "n")


def test_delete_restore_compact(spark, three):
    gone = three.delete(only_ids(spark, 2, 2, 77))
    assert idlist(gone.live()) == [1, 3] and gone.is_deleted(2) and not gone.contains(2)
    assert gone.rows.where("id = 2").first()["tag"] is None
    assert gone.delete_report(only_ids(spark, 1, 1, 2, 77)).first().asDict() == {"total": 4, "unique": 3, "deleted": 1, "already_deleted": 1, "invalid": 1}
    assert idlist(gone.restore(only_ids(spark, 2)).live()) == [1, 2, 3]
    assert gone.stats().first()["tombstone_ratio"] == pytest.approx(1 / 3)
    assert gone.needs_compaction() and "33%" in gone.compaction_warning()
    small = gone.compact()
    assert small.stats().first()["total"] == 2 and not small.needs_compaction() and idlist(small.live()) == [1, 3]
    assert [r["id"] for r in gone.search([2.0, 0.0], 2).collect()] == [1, 3]
    empty = Collection.create(frame(spark, []), 2)
    assert empty.stats().first()["tombstone_ratio"] == 0 and empty.search([0.0, 0.0], 3).collect() == []


def test_facade(spark, three):
    assert [r["id"] for r in three.search([3.0, 0.0], 2, 'tag != "t3"', include=["tag"]).collect()] == [2, 1]
    assert three.count('tag IN ["t1", "t2"]') == 2
    assert three.search_filtered([0.0, 0.0], 1, 'tag = "t2"').rows.first()["id"] == 2
    assert three.search_boosted([0.0, 0.0], 1, []).first()["id"] == 1
    assert three.search_codes([1.0, 0.0], 1).first()["id"] == 1
    assert three.search_rescored([2.0, 0.0], 1).first()["id"] == 2
    assert three.search_batch(only_ids(spark, 5).select(F.col("id").alias("qid"), F.array(F.lit(3.0), F.lit(0.0)).alias("embedding")), 1).first()["id"] == 3


def test_metadata_columns(spark, three):
    done = three.set_metadata(spark.createDataFrame([(1, "x", 5), (2, None, 6), (99, "z", 7)], "id long, tag string, size int"))
    assert {r["id"]: (r["tag"], r["size"]) for r in done.live().collect()} == {1: ("x", 5), 2: ("t2", 6), 3: ("t3", None)}
    with pytest.raises(metadata.MetadataError):
        three.set_metadata(spark.createDataFrame([(1, "x")], "id long, `no key` string"))


def test_metadata_rows(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x", "c": null, "d": {"e": 1}, "f": ["p"], "g": [1]}'), (2, "not json"), (3, None)], "id long, props string")
    own = metadata.from_json(rows, "props")
    assert sorted(r["key"] for r in own.collect()) == ["a", "b", "f"]
    plain = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (2, "a", "3")], "id long, key string, value string")
    new = spark.createDataFrame([(1, "a", "9"), (3, "z", "8")], "id long, key string, value string")
    values = lambda df: sorted(map(tuple, df.collect()))
    assert values(metadata.merge(plain, new)) == [(1, "a", "9"), (1, "b", "2"), (2, "a", "3"), (3, "z", "8")]
    assert values(metadata.update(plain, new)) == [(1, "a", "9"), (1, "b", "2"), (2, "a", "3")]
    assert values(metadata.delete(plain, new.select("id", "key"))) == [(1, "b", "2"), (2, "a", "3")]
    assert values(metadata.delete(plain, new.select("id"))) == [(2, "a", "3")]
    assert values(metadata.key_counts(plain)) == [(1, 2), (2, 1)]
    assert tuple(metadata.totals(plain).first()) == (2, 3)


def test_metadata_limits():
    metadata.check({"ok_1": 1, "s": "x", "f": 0.5, "b": True, "l": ["a"]})
    for bad in ({"": 1}, {"a b": 1}, {"k" * 257: 1}, {"a": "x" * 65_537}, {"a": float("nan")}, {"a": 1 << 63}, {"a": [1]}, {"a": ["x"] * 1_025}, {"a": None}, {f"k{i}": 1 for i in range(65)}):
        with pytest.raises(metadata.MetadataError):
            metadata.check(bad)


def test_snapshot(spark, three, tmp_path):
    path = f"file://{tmp_path}/s"
    snapshot.save(three.delete(only_ids(spark, 2)), path)
    back = snapshot.load(spark, path)
    assert idlist(back.live()) == [1, 3] and back.metric == "l2" and back.is_deleted(2)
    snapshot.save(back.compact(), path)
    assert snapshot.load(spark, path).stats().first()["total"] == 2
    part = spark.read.parquet(f"{path}/manifest").first()["part"]
    frame(spark, [(50, [0.0, 0.0], "x")]).withColumn("deleted", F.lit(False)).write.mode("append").parquet(f"{path}/{part}")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, path)


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    entries = spark.createDataFrame([(1, "insert", 7, [1.0]), (2, "insert", 8, [2.0]), (3, "delete", 7, None), (4, "insert", 9, [3.0]), (6, "insert", 10, [4.0])], "seq long, op string, id long, embedding array<float>")
    log.append(entries.where("seq < 3"), path)
    log.append(entries.where("seq >= 3"), path)
    assert sorted((r["id"], r["seq"]) for r in log.replay(spark, path).collect()) == [(8, 2), (9, 4)]
    torn = log.read(spark, path).withColumn("crc", F.when(F.col("seq") == 2, 0).otherwise(F.col("crc")))
    assert [r["seq"] for r in log.whole_prefix(torn).collect()] == [1]
    assert log.whole_prefix(torn.where("seq = 2")).collect() == []
    assert log.whole_prefix(log.read(spark, path).limit(0)).collect() == []


def test_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "id long, op string, ts timestamp, embedding array<float>"
    first = [(1, "insert", at(1), [1.0]), (1, "insert", at(2), [9.0]), (2, "insert", at(3), [2.0])]
    second = [(2, "delete", at(4), None), (3, "insert", at(5), [3.0])]
    source = f"file://{tmp_path}/in"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{source}/a")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    ingest.follow(ingest.first_seen(stream()), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(f"{source}/b")
    ingest.follow(ingest.first_seen(stream()), f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    state = {r["id"]: r["embedding"] for r in ingest.current(ingest.changes_at(spark, f"{tmp_path}/log")).collect()}
    assert set(state) == {1, 3}
    counts = ingest.windowed_counts(spark.createDataFrame(first + second, schema)).first()
    assert (counts["inserts"], counts["deletes"]) == (4, 1)
