"""The store of true records: JSON files in byte ranges, and changes that are written into it."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from inkwell.plans import queries as plans
from inkwell.sources import ground_truth, shared

ODD = ["a", "{", "}", "}}", '"', "\\", '\\"', 'x, "y": {', 'é"}', '[{"', "\n", '"}, "z": {', "a\\"]


def record(rnd):
    if rnd.random() < 0.2:
        return rnd.choice([5, None, True, "t}", "[", [1, {"a": "}"}]])
    return {rnd.choice(ODD) + str(i): rnd.choice([rnd.choice(ODD), {"q": rnd.choice(ODD), "p": {}}, [rnd.choice(ODD), {}], 1.5]) for i in range(rnd.randrange(4))}


def plain(x):
    try:
        return json.dumps(json.loads(x))
    except (TypeError, ValueError):
        return x


@pytest.mark.parametrize("indent", [None, 2])
def test_store_in_ranges(spark, tmp_path, indent):
    rnd = random.Random(1)
    store = {t: {rnd.choice(ODD) + str(i): record(rnd) for i in range(200)} for t in ["invoice", 'pay{"ment\\', "}", 'e"']}
    store |= {"empty": {}, "nothing": None, "last": {"f": {"a": 1}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(store, ensure_ascii=False, indent=indent))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"invoice": {"other": {"b": 2}}}, indent=indent))
    (tmp_path / "in" / "c.json").write_text("{}")
    store["invoice"]["other"] = {"b": 2}
    sizes = {k: v for k, v in (("spark.sql.files.maxPartitionBytes", "3000"), ("spark.sql.files.openCostInBytes", "1"))}
    was = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        path = str(tmp_path / "in")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
        got = sorted(((r.doc_type, r.file_name, plain(r.record)) for r in ground_truth.read_json(spark, path).collect()), key=str)
        want = sorted(((t, f, None if v is None else v if isinstance(v, str) and plain(v) == v else plain(v) if isinstance(v, str) else json.dumps(v)) for t, m in store.items() for f, v in (m or {}).items()), key=str)
        assert got == want
        assert ground_truth.read_json(spark, path, 'pay{"ment\\').count() == 200
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def files_of(path):
    return {f: os.path.getmtime(f) for d, _, names in os.walk(path) for f in (f"{d}/{x}" for x in names) if f.endswith(".parquet")}


CHANGES = "doc_type string, file_name string, record string, at long"


def test_changes_write_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "store")
    store = spark.createDataFrame([(t, f"f{i}", "old") for t in ("invoice", "payment_order") for i in range(40)], "doc_type string, file_name string, record string")
    ground_truth.start(store, path)
    before = files_of(path)
    changes = spark.createDataFrame([("invoice", "f1", "first", 1), ("invoice", "f1", "second", 2), ("account_protocol", "g", "new", 1)], CHANGES)
    assert ground_truth.apply_changes(spark, path, changes) == 2
    after = files_of(path)
    assert {f for f in before if "payment_order" in f} <= set(after) and all(after[f] == before[f] for f in before if f in after)
    assert len(set(before) - set(after)) == 1  # one part of one type was written anew
    held = {(r.doc_type, r.file_name): r.record for r in ground_truth.current(spark, path).collect()}
    assert held["invoice", "f1"] == "second" and held["account_protocol", "g"] == "new" and len(held) == 81
    # Again, and later ones after earlier ones: nothing changes, nothing is written.
    assert ground_truth.apply_changes(spark, path, changes) == 0
    assert ground_truth.apply_changes(spark, path, spark.createDataFrame([("invoice", "f1", "late", 1)], CHANGES)) == 0
    assert ground_truth.apply_changes(spark, path, spark.createDataFrame([], CHANGES)) == 0
    assert files_of(path) == after


def test_stream_of_changes(spark, tmp_path):
    rnd = random.Random(2)
    store = spark.createDataFrame([("a", f"f{i}", "old") for i in range(30)], "doc_type string, file_name string, record string")
    ground_truth.start(store, f"{tmp_path}/store", buckets=4)
    rows = [(rnd.choice("ab"), f"f{rnd.randrange(40)}", str(i), i) for i in range(200)]
    rnd.shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = plans.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], CHANGES).schema)
    ground_truth.follow_changes(stream, f"{tmp_path}/store", f"{tmp_path}/state", buckets=4).awaitTermination()
    got = {(r.doc_type, r.file_name): r.record for r in ground_truth.current(spark, f"{tmp_path}/store").collect()}
    want = {(r.doc_type, r.file_name): r.record for r in ground_truth.upsert(store, spark.createDataFrame(rows, CHANGES), "at").collect()}
    assert got == want


def test_tables_in_the_shared_folder(spark):
    df = spark.range(5).withColumn("x", F.lit("a"))
    kept = shared.materialise(df, "t")
    assert kept.schema["id"].dataType == df.schema["id"].dataType and kept.count() == 5


def test_texts_are_shuffled_twice_at_most(spark, tmp_path):
    """What is added up over a file's pieces goes without their texts."""
    rnd = random.Random(4)
    store = {t: {f"f{i}": {"text": "".join(chr(rnd.randrange(97, 123)) for _ in range(4000))} for i in range(300)} for t in "ab"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(store))
    size = (tmp_path / "in" / "a.json").stat().st_size
    stages = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        java = spark.sparkContext._jvm
        found = stages.stageList(None, False, False, spark.sparkContext._gateway.new_array(java.double, 0), java.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    before = shuffled()
    assert ground_truth.read_json(spark, str(tmp_path / "in")).agg(F.sum(F.length("record"))).first()[0] > 600 * 4000
    assert shuffled() - before < 2.5 * size
