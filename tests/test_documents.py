"""Values of JSON texts against a walk with a stack, and edit distances against the table of prefixes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import documents, similarity
from inkwell.operators import evaluate


def walked(record):
    out, stack = [], [record]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out += [x.strip()] if x.strip() else []
        elif isinstance(x, (bool, int, float)):
            out.append(str(x))
        elif isinstance(x, dict):
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return out


def made(rnd, depth):
    kind = rnd.randrange(9 if depth else 7)
    if kind == 0:
        return rnd.choice([None, True, False])
    if kind in (1, 2):
        return rnd.choice([0, -1, 10**20, 0.1, -2.5e-7, 1e-5, 1e-4, 123456.789, 9.999e15, 1e16, 1.5e300, -0.0, 3.0, rnd.random() * 10 ** rnd.randrange(-9, 20), rnd.randrange(-(10**9), 10**9)])
    if kind < 7:
        return rnd.choice(["", "  ", " x ", 'a"b\\', "\\\\", "[1, {", "12", "null", "é ", "\n\t", "a:b", ":", "}", '":', "ключ"])
    n = rnd.randrange(4)
    return [made(rnd, depth - 1) for _ in range(n)] if kind == 7 else {rnd.choice(['k"', "a:", "[", "x"]) + str(i): made(rnd, depth - 1) for i in range(n)}


def test_values_of_any_shape(spark):
    rnd = random.Random(7)
    records = [[made(rnd, 5)] if i % 2 else {"k": made(rnd, 5), "l": made(rnd, 4)} for i in range(400)]
    records += [{"a": "x" * 200_000 + '\\"' * 50_000}, {}, [], "text", 5, None]
    texts = [json.dumps(r, ensure_ascii=i % 3 == 0, indent=2 if i % 5 == 0 else None) for i, r in enumerate(records)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.v for r in df.select("i", documents.json_values(F.col("t")).alias("v")).collect()}
    for i, record in enumerate(records):
        assert got[i] == walked(record), (texts[i][:300], got[i], walked(record))


def test_what_is_no_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("{broken",), ('{"a": }',), ("plain text",)], "t string")
    assert [r.v for r in df.select(documents.json_values(F.col("t")).alias("v")).collect()] == [None] * 5
    assert {r.v for r in df.select(documents.json_text(F.col("t")).alias("v")).collect()} == {""}


def test_store_of_mixed_records(spark):
    """Records of different types in one table, compared as texts."""
    item = {"line_number": 1, "description": "REU032 HAIR STYLING CLAY Reuzel Clay Mate Pomade, 35g", "unit": "pcs", "quantity": 100, "unit_price": 0.8, "vat_rate": "20%"}
    other = {"line_number": 2, "description": "REU44 EXTRA STRONG HOLD Reuzel Extreme Hold Matte Pomade, 35g", "unit": "pcs", "quantity": 3, "unit_price": 30.0, "vat_rate": "20%"}
    invoice = {"invoice_number": "286552", "invoice_date": "23.08.2024", "items": [item, other], "totals": {"total_incl_vat": 753.8}}
    misread = {"invoice_number": "28655Z", "invoice_date": "23.08.2O24", "items": [item | {"quantity": 10, "vat_rate": "2O%"}, other], "totals": {"total_incl_vat": 752.8}}
    order = {"payment_order_number": "17", "document_date": None}
    truth = spark.createDataFrame([("invoice", "f", json.dumps(invoice)), ("payment_order", "f", json.dumps(order)), ("invoice", "g", json.dumps(invoice))], "doc_type string, file_name string, record string")
    seen = spark.createDataFrame([("invoice", "f", json.dumps(misread)), ("payment_order", "f", json.dumps({"payment_order_number": 17}))], truth.schema)
    got = {(r.doc_type, r.file_name): r for r in evaluate.compare(truth, seen, ["doc_type", "file_name"]).collect()}
    assert got["invoice", "f"].cer == pytest.approx(5 / 174) and got["invoice", "f"].wer == pytest.approx(5 / 32)
    assert got["invoice", "g"].cer == 1 and got["payment_order", "f"].cer == 0


def table(a, b):
    up = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        own = [i]
        for j, y in enumerate(b, 1):
            own.append(min(up[j] + 1, own[-1] + 1, up[j - 1] + (x != y)))
        up = own
    return up[-1]


def test_distance_by_columns_of_bits():
    rnd = random.Random(3)
    for i in range(600):
        a = [rnd.choice("abc") for _ in range(rnd.randrange(150))]
        b = [rnd.choice("abc") for _ in range(rnd.randrange(150))] if i % 2 else a[: rnd.randrange(len(a) + 1)] + ["x"] * rnd.randrange(4) + a[rnd.randrange(len(a) + 1) :]
        want = table(a, b)
        assert similarity.edit_distance(a, b) == want == similarity.edit_distance("".join(a), "".join(b))


def test_distance_is_the_built_in_one(spark):
    rnd = random.Random(4)
    own = ["".join(rnd.choice("abcdé 😀") for _ in range(rnd.randrange(1, 400))) for _ in range(60)]
    rows = [(a, b) for a in own[:8] for b in [*own, None, ""]] + [("", ""), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(similarity.cer(F.col("a"), F.col("b")).alias("got"), (F.levenshtein("a", "b") / F.nullif(F.length("a"), F.lit(0))).alias("want"), "a", "b").collect()
    for r in got:
        if r.a:
            assert r.got == (None if r.b is None else 1.0 if r.b == "" else pytest.approx(r.want))


def test_even_tasks(spark):
    """Rows of a few bytes and much work aren't put together in one task."""
    from inkwell.plans import queries

    found = queries.nested_records(spark, "/root/testdata/sf0.01").withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() >= 4
