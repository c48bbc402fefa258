import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import same

from inkwell.llm import queries, url_filter

CAPTURES = "id long, url string, fetched timestamp, pattern string, row int, blocked string"
ENTRIES = "list string, pattern string, day timestamp, listed boolean"
DAY0 = datetime(2024, 1, 1)


def active(entries, list_, pattern, at):
    """The last day's entry at or before the time; a listing goes ahead of a removal."""
    own = [(day, listed) for li, p, day, listed in entries if (li, p) == (list_, pattern) and None not in (day, listed) and day <= at]
    return bool(own) and any(listed for day, listed in own if day == max(own)[0])


def test_against_brute_force(spark):
    rnd = random.Random(5)
    hosts = ["a.b.org", "b.org", "x.a.b.org", "c.net", "localhost"]
    patterns = [*hosts, "org", "b.org/p", "a.b.org/q", "net"]
    entries = [(rnd.choice("LM"), rnd.choice(patterns), DAY0 + timedelta(days=rnd.randrange(30)), rnd.random() < 0.6) for _ in range(60)]
    entries += [(None, "b.org", DAY0, True), ("L", None, DAY0, True), ("N", "b.org", None, True), ("N", "c.net", DAY0, None)]
    captures = []
    for i in range(200):
        url = f"{rnd.choice(['http', 'HTTPS'])}://{rnd.choice(['', 'u@'])}{rnd.choice(hosts).upper() if i % 5 == 0 else rnd.choice(hosts)}{rnd.choice(['', ':80'])}{rnd.choice(['', '/', '/p', '/q/r', '/p?x#y', '?p'])}"
        captures.append((i % 150, url, DAY0 + timedelta(hours=rnd.randrange(24 * 35))))
    captures += [(900, None, DAY0), (901, "no url", DAY0), (902, "http://b.org/p", None), (None, "http://b.org/p", DAY0 + timedelta(days=20)), (903, "http://b.org/" + "p" * 20_000, DAY0)]
    df = spark.createDataFrame([(*c, "clash", 1, "b") for c in captures], CAPTURES)
    found = url_filter.evaluate(df, spark.createDataFrame(entries, ENTRIES))
    assert found.columns == ["id", "url", "fetched", "pattern", "row", "hit_lists", "hit_patterns", "blocked"]
    want = []
    for d, url, at in captures:
        hits = set()
        if url and "://" in url and at:
            rest = url.split("://")[1]
            host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
            labels = host.split(".")
            names = {".".join(labels[k:]) for k in range(max(1, len(labels) - 1))}
            path = rest.split("?")[0].split("#")[0].split("/")
            if len(path) > 1 and path[1]:
                names.add(f"{host}/{path[1]}")
            hits = {(li, p) for li in "LMN" for p in names if active(entries, li, p, at)}
        want.append((d, url, sorted({h[0] for h in hits}), sorted({h[1] for h in hits}), bool(hits)))
    got = [(r.id, r.url, r.hit_lists, r.hit_patterns, r.blocked) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[4] for r in got)


def test_intervals_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_INTERVALS", 0)
    test_against_brute_force(spark)


def test_empty(spark):
    none = spark.createDataFrame([], CAPTURES)
    lists = spark.createDataFrame([], ENTRIES)
    assert url_filter.evaluate(none, lists).collect() == []
    one = spark.createDataFrame([(1, "http://a.b/c", DAY0, "", 1, "")], none.schema)
    assert [r.blocked for r in url_filter.evaluate(one, lists).collect()] == [False]


def test_sql(spark):
    same(queries.op4_url_filter(spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL["op4_url_filter"], "/root/testdata/sf0.01")
