import random
import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import same

from inkwell.llm import line_dedup as ld
from inkwell.llm import queries

SCHEMA = "doc_id long, text string, source string, host string, lines_seen int"


def brute(rows, ratio, least, copies_as_one=True):
    pages = defaultdict(list)
    for _, text, host in rows:
        if text is not None and not (copies_as_one and text in pages[host]):
            pages[host].append(text)
    count = defaultdict(int)
    for host, own in pages.items():
        for text in own:
            for line in {x.strip(ld.TRIMMED) for x in text.split("\n")} - {""}:
                count[host, line] += 1
    out = []
    for d, text, host in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        lines = text.split("\n")
        gone = [n >= least and n > ratio * len(pages[host]) for n in (count.get((host, x.strip(ld.TRIMMED)), 0) for x in lines)]
        out.append((d, "\n".join(x for x, g in zip(lines, gone) if not g), sum(x.strip(ld.TRIMMED) != "" for x in lines), sum(gone)))
    return out


def rows_of():
    rnd = random.Random(9)
    common = ["menu", " footer ", "all rights", "é ligne"]
    rows = []
    for i in range(300):
        lines = [rnd.choice(common) if rnd.random() < 0.3 else f"line {rnd.randrange(400)}" for _ in range(rnd.randrange(8))]
        rows.append((i, "\n".join(lines), rnd.choice(["a", "a", "b", None, ""])))
    rows += [(i, "menu\nfooter", "a") for i in range(40)] + [(500, None, "a"), (501, "", "a"), (502, "\n \n", "b"), (503, "long line " * 20_000 + "\nmenu", "a"), (503, "twice", "a"), (503, "twice", "a"), (None, "menu", "b")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    for bound in (ld.BROADCAST_LINES, 0):
        monkeypatch.setattr(ld, "BROADCAST_LINES", bound)
        for as_one in (True, False):
            found = ld.drop_boilerplate(df, ratio=0.05, min_pages=4, copies_as_one=as_one)
            assert found.columns == [*df.columns[:-1], "lines_seen", "lines_dropped"]
            got = [(r.doc_id, r.text, r.lines_seen, r.lines_dropped) for r in found.collect()]
            assert sorted(got, key=str) == sorted(brute(rows, 0.05, 4, as_one), key=str)
            assert any(r[3] for r in got)


def test_small_hosts(spark):
    """Five pages with one menu, and a host of one page."""
    rows = [(i, f"menu\npage {i}", "five") for i in range(5)] + [(9, "menu\nalone", "one")]
    got = {r.doc_id: r.text for r in ld.drop_boilerplate(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), host="source").collect()}
    assert got == {**{i: f"page {i}" for i in range(5)}, 9: "menu\nalone"}


def test_copies_are_one_page(spark):
    rows = [(i, "one\ntwo", "h") for i in range(30)] + [(i, f"page {i}", "h") for i in range(30)]
    got = ld.drop_boilerplate(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), copies_as_one=True).collect()
    assert not any(r.lines_dropped for r in got)


def test_empty(spark):
    assert ld.drop_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark, tmp_path):
    rows = [(i, f"http://h{i % 2}.org/x", f"<html><p>{'menu' if i % 3 else 'x'}</p><p>own {i}<br>two</p><!-- c --><script>v</script><b>t</b></html>") for i in range(40)]
    rows += [(None, None, "<p>x"), (50, "no url", None), (50, "no url", ""), (51, "http://h0.org", "<p>menu</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        same(queries.op3_line_dedup(spark, sf), queries.ORACLE_SQL["op3_line_dedup"], sf)
