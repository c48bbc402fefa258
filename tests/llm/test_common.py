from types import SimpleNamespace

import pytest

from inkwell.llm import common
from inkwell.sources import shared


def test_refusal_without_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_local_session_without_a_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]", applicationId="a"))
    assert common.shared_dir(spark) == common.shared_dir(spark)


def test_nothing_stays_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert common.materialise(spark.range(5), "five").count() == 5
    assert list((tmp_path / "shared").iterdir())
    common.release(spark)
    assert not list((tmp_path / "shared").iterdir())


def test_batches_for_python_are_bounded(spark):
    """Texts of any size go to Python in small batches while a table is written; afterwards all is as it was."""
    import pyarrow as pa

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    was = [spark.conf.get(n) for n in names]
    df = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', IF(id < 1000, 50000, 10)) AS text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [sum(map(len, b.column(1).to_pylist()))]})

    found = common.materialise(df.mapInArrow(run, "rows long, size long"), "sizes").collect()
    assert sum(r.rows for r in found) == 3000 and sum(r.size for r in found) == 50_020_000
    assert max(r.rows for r in found) <= 1000 and max(r.size for r in found) <= 5 << 20
    assert [spark.conf.get(n) for n in names] == was


def test_a_task_returns_what_it_has_freed():
    """Pieces of 50 kB below one that stays: the C library keeps what is freed among them until it is told to return it."""
    import re
    from pathlib import Path

    import pyarrow as pa

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    stays = []

    def run(batches):
        own = [bytearray(50_000) for _ in range(6000)]
        stays.extend(own[::300])
        yield from batches

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    before = held()
    assert list(common.lean(run)(iter([batch]))) == [batch]
    assert held() < before + 100
