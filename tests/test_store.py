"""Collections by hash buckets: first writers win, and work follows what is written."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexloom.sources.store import BUCKET, Store
from lexloom.streaming.deploy import first_of_each

SCHEMA = "title string, `a.b` int, at int"


def rows(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def found(store):
    return sorted((tuple(r) for r in store.read().collect()), key=repr)


def files(path):
    return {p for p in Path(path).rglob("*.parquet")}


def test_first_writer_wins_whatever_the_key(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", SCHEMA, ["title"], 4)
    assert found(store) == []
    store.insert_if_absent(rows(spark, ("a", 2, 2), ("a", 1, 1), (None, 5, 1), ("b", None, 3)), ["at"])
    store.insert_if_absent(rows(spark, ("a", 9, 0), (None, 9, 0), ("c", 3, 1), ("c", 4, 1)).withColumn("extra", F.lit(1)), ["at", "a.b"])
    assert found(store) == sorted([("a", 1, 1), (None, 5, 1), ("b", None, 3), ("c", 3, 1)], key=repr)
    store.insert_if_absent(rows(spark), ["at"])
    assert len(found(store)) == 4
    assert Store(spark, f"{tmp_path}/s", SCHEMA, ["title"], 99).buckets == 4
    assert sorted(r.title for r in store.lookup(spark.createDataFrame([("a",), ("z",), ("c",)], "title string")).collect()) == ["a", "c"]


def test_two_keys_and_order(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", SCHEMA, ["title", "a.b"], 3)
    store.insert_if_absent(rows(spark, ("a", 1, 5), ("a", 1, 4), ("a", 2, 3), ("a", None, 2)), ["at"])
    assert found(store) == sorted([("a", 1, 4), ("a", 2, 3), ("a", None, 2)], key=repr)
    store.update(spark.createDataFrame([("a", None, 8), ("a", 7, 9)], SCHEMA))
    assert found(store) == sorted([("a", 1, 4), ("a", 2, 3), ("a", None, 8)], key=repr)


def test_two_writers_at_once(spark, tmp_path):
    stores = [Store(spark, f"{tmp_path}/s", SCHEMA, ["title"], 4) for _ in range(3)]
    barrier, errors = threading.Barrier(3), []

    def write(k):
        try:
            barrier.wait()
            stores[k].insert_if_absent(rows(spark, *[(f"t{i}", k, 0) for i in range(20)], (f"own{k}", k, 0)), ["at"])
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    titles = [t for t, _, _ in found(stores[0])]
    assert sorted(titles) == sorted([f"t{i}" for i in range(20)] + [f"own{k}" for k in range(3)])
    assert not list((tmp_path / "s" / "_claims").glob("[0-9]*"))


def test_a_claim_of_a_dead_writer_is_named(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", SCHEMA, ["title"], 1, patience=0.1)
    (tmp_path / "s" / "_claims").mkdir()
    (tmp_path / "s" / "_claims" / "000000").touch()
    with pytest.raises(TimeoutError, match="_claims/000000"):
        store.insert_if_absent(rows(spark, ("a", 1, 1)), ["at"])
    (tmp_path / "s" / "_claims" / "000000").unlink()
    store.insert_if_absent(rows(spark, ("a", 1, 1)), ["at"])
    assert found(store) == [("a", 1, 1)]


def test_only_touched_buckets_are_read_and_rewritten(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", SCHEMA, ["title"], 32)
    store.insert_if_absent(rows(spark, *[(f"t{i}", i, i) for i in range(400)]), ["at"])
    before = files(tmp_path / "s")
    one = spark.createDataFrame([("t7", 70), ("none", 1)], "title string, at int")
    touched = {r[0] for r in one.select(store.bucket()).collect()}
    assert len(touched) <= 2 < len({p.parent for p in before})
    read = {p.split("file://")[-1] for p in store.lookup(one.select("title")).inputFiles() if BUCKET in p}
    plan = store._table(sorted(touched))
    assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()
    scanned = plan.select(F.input_file_name()).distinct().count()
    assert scanned <= 2 and read
    store.update(one)
    after = files(tmp_path / "s")
    assert {p.parent.name for p in before - after} <= {f"{BUCKET}={k}" for k in touched} and len(before & after) >= len(before) - 2
    assert {r.title: r.at for r in store.read().where("title in ('t7', 't8', 'none')").collect()} == {"t7": 70, "t8": 8}
    store.insert_if_absent(rows(spark, ("new1", 1, 1)), ["at"])
    store.insert_if_absent(rows(spark, ("new2", 1, 1)), ["at"])
    store.compact()
    assert len(files(tmp_path / "s")) <= 32 and store.read().count() == 402


def test_streams_keep_the_titles_they_have_seen(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path}/out"
    kind = "title string, at string, v int"
    source.mkdir()
    for k, x in enumerate(([("a", "2", 1), ("a", "1", 2), ("a", None, 3), (None, "1", 9)], [("a", "0", 4), ("b", "1", 5), (None, "0", 8)])):
        spark.createDataFrame(x, kind).write.mode("append").json(str(source / f"batch{k}"))
        stream = first_of_each(spark.readStream.schema(kind).json(f"{source}/*"), "title", "at")
        stream.writeStream.format("json").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(((r.title, r.v) for r in spark.read.schema(kind).json(out).collect()), key=repr) == sorted([("a", 2), (None, 9), ("b", 5)], key=repr)
