"""Operators on small inputs with every branch."""

import io
import json
import math
import time
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.operators import chat, evaluate, lines, pages, pixels, recognize, registry, session
from inkwell.sources import export, files, ground_truth
from inkwell.streaming import session as stream

PAGES = "doc string, page_number int, text string, confidence double, error string"


def test_pages_of_a_giant_document(spark):
    """However places are cut into stretches, and whatever is blank."""
    rows = [("a", i, None if i % 11 == 0 else " " if i % 7 == 0 else f"p{i}") for i in range(500)] + [("b", 3, "x"), ("b", 1, "y"), ("b", 1, "x"), ("c", 1, None), (None, 5, "z")]
    df = spark.createDataFrame(rows, "doc string, at long, text string").repartition(6)
    want = {}
    for doc in ("a", "b", None):
        own = [t for _, t in sorted((at, t) for d, at, t in rows if d == doc and (t or "").strip())]
        for i in range(0, len(own), 30):
            want[doc, i // 30 + 1] = (-(-len(own) // 30), i + 1, min(i + 30, len(own)), own[i : i + 30])
    for stretch in (1, 7, 64, 4096):
        got = {(r.doc, r.page): (r.total_pages, r.first, r.last, r.paragraphs) for r in pages.text_pages(df, ["doc"], "at", "text", stretch=stretch).collect()}
        assert got == want


def test_pages_on_a_stream(spark, tmp_path):
    """Complete documents come out at once, others when nobody waits any longer; repeated pages count once."""
    from inkwell.plans import queries as plans
    from inkwell.streaming import pages as page_stream

    schema = "document long, page_number long, pages long, text string, confidence double, error string, ts timestamp"
    at = [T0 + timedelta(minutes=i) for i in range(60)]
    parts = [
        [(1, 1, 2, "one", 0.9, None, at[0]), (2, 1, None, "a", 0.8, None, at[1]), (2, 1, None, "again", 0.1, None, at[1]), (3, 5, 3, None, None, "bad", at[2])],
        [(1, 2, 2, "two", 0.7, None, at[0]), (1, 2, 2, "two", 0.2, None, at[1]), (2, 3, None, None, None, "bad", at[0]), (None, 1, 1, "x", 0.5, None, at[1])],
        [(1, 1, 2, "late", 0.1, None, at[2]), (9, 1, 1, "end", 1.0, None, T0 + timedelta(days=1))],
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.3)
    source = plans.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    got = {r.document: r for r in page_stream.rolled_up(plans.streamed(spark, page_stream.gather(source), str(tmp_path))).collect()}
    assert set(got) == {1, 2, 3, 9}
    assert (got[1].total_pages, got[1].confidence, got[1].confidence_per_page) == (2, 0.7, [0.9, 0.7]) and "late" not in got[1].combined_text
    assert (got[2].total_pages, got[2].failed_pages, got[2].confidence_per_page) == (2, 1, [0.8, 0.1])
    assert (got[3].total_pages, got[3].processed_pages, got[3].combined_text) == (1, 0, "")


def test_long_logits(spark):
    """Steps over many tasks, logits far from zero, and tokens that the vocabulary lacks."""
    from inkwell.operators import tokens

    rng = np.random.default_rng(1)
    rows, want = [], {}
    for doc in range(6):
        logs = []
        for step in range(5):
            x = rng.standard_normal(40) * [1, 30, 300][doc % 3] + [0, 700, -5000][step % 3]
            made = int(rng.integers(0, 40)) if (doc, step) != (5, 2) else 99
            rows += [(doc, step, made, t, float(v)) for t, v in enumerate(x)]
            if made < 40:
                logs.append(math.log(max(0.01, float(np.exp(x[made] - x.max()) / np.exp(x - x.max()).sum()))))
        want[doc] = (len(logs), math.exp(np.mean(logs)) if doc < 5 else 0.5)
    rows += [(7, 0, 5, 0, 1.0), (7, 0, 5, 1, None), (8, 0, 1, 0, None)]
    got = {r.doc: (r.steps, r.confidence) for r in tokens.confidence(spark.createDataFrame(rows, "doc int, step int, made int, token int, logit double").repartition(7), ["doc"]).collect()}
    assert got.pop(7) == (0, 0.5) and got == {k: (n, pytest.approx(c)) for k, (n, c) in want.items()}


def test_threshold_on_bytes(spark):
    rows = [(t, bytearray(range(256))) for t in (-30, -1, 0, 1, 48, 69, 70, 127, 254, 255, 256, 400)] + [(5, bytearray()), (5, None)]
    df = spark.createDataFrame(rows, "t int, b binary").select("t", "b", pixels.binarize_bytes(F.col("b"), F.col("t")).alias("c"), pixels.binarize_bytes(F.col("b"), F.col("t"), clamped=False).alias("u"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        for got, t in ((r.c, min(max(r.t, 0), 255)), (r.u, r.t)):
            assert got == (None if r.b is None else bytearray(255 if x > t else 0 for x in r.b))


def echo_recognizer():
    """A stand-in whose text is the image's origin. It recognises nothing."""

    class Echo:
        def infer(self, image, prompt):
            if image is None or image["height"] is None or image["height"] <= 0:
                raise ValueError("undecodable image")
            text = str(image["origin"])
            return text, [0] * len(text), [[2.0, 0.0]] * len(text)

    return Echo


def test_rollup(spark):
    rows = [("a", 3, "three", 0.85, None), ("a", 1, "one", 0.92, None), ("a", 2, "two", 0.78, None), ("b", 1, "", None, None), ("b", 4, None, None, "bad"), ("c", 1, None, 0.9, None), ("d", 2, "x", None, None)]
    got = {r.doc: r for r in pages.rollup(spark.createDataFrame(rows, PAGES).repartition(4), ["doc"]).collect()}
    assert (got["a"].confidence, got["a"].confidence_per_page, got["a"].processed_pages, got["a"].total_pages) == (0.78, [0.92, 0.78, 0.85], 3, 3)
    assert got["a"].combined_text == "\n\n--- СТРАНИЦА РАЗДЕЛИТЕЛЬ ---\n\n".join(f"[Страница {i}]\n{t}" for i, t in ((1, "one"), (2, "two"), (3, "three")))
    assert (got["b"].confidence, got["b"].confidence_per_page, got["b"].processed_pages, got["b"].combined_text, got["b"].failed_pages) == (0.1, [0.5, 0.1], 0, "", 1)
    assert got["c"].confidence == 0.9 and got["d"].confidence == 0.5
    assert pages.rollup(spark.createDataFrame([], PAGES), ["doc"]).collect() == []
    own = pages.result_structs(spark.createDataFrame(rows, PAGES), ["doc"]).where("doc = 'b'")
    assert own.select(F.size(pages.pages_with_text(F.col("pages"))), pages.page_by_number(F.col("pages"), F.lit(4))["error"], pages.page_by_number(F.col("pages"), F.lit(9))).first()[:] == (0, "bad", None)


def test_text_pages(spark):
    rows = [("a", i, f"p{i}" if i % 4 else " ") for i in range(60)] + [("b", 0, None)]
    got = pages.text_pages(spark.createDataFrame(rows, "doc string, i int, t string"), ["doc"], "i", "t").orderBy("page").collect()
    assert [(r.doc, r.page, r.total_pages, r["first"], r["last"], len(r.paragraphs)) for r in got] == [("a", 1, 2, 1, 30, 30), ("a", 2, 2, 31, 45, 15)]


SEGMENTS = "image string, line_index int, x1 int, y1 int, x2 int, y2 int"


def longest_by_window(segments, keys, profile):
    """The chosen segment's own row by a ranking window."""
    order = Window.partitionBy(*keys).orderBy(F.col("is_level").desc(), F.col("length").desc(), "line_index")
    best = lines.geometry(segments, profile).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return best if lines.PROFILES[profile].fallback else best.where("is_level")


def test_lines(spark):
    rows = [
        ("level", 0, 0, 0, 100, 0), ("tie", 5, 0, 9, 50, 9), ("tie", 2, 0, 1, 50, 1), ("tie", 3, 0, 0, 0, 80), ("left", 0, 100, 10, 0, 0), ("steep", 0, 0, 0, 0, 50), ("steep", 1, 5, 0, 5, 90), ("point", 0, 3, 3, 3, 3),
    ]
    df = spark.createDataFrame(rows, SEGMENTS)
    got = {r.image: r for r in lines.select_line(df, ["image"]).collect()}
    assert got["level"].rotation_angle == 0 and not got["level"].warning
    assert (got["tie"].line_index, got["tie"].total_lines, got["tie"].level_lines) == (2, 3, 2)
    assert got["left"].detected_angle == pytest.approx(-np.degrees(np.arctan2(10, 100))) and got["left"].rotation_angle == -got["left"].detected_angle
    assert got["steep"].warning and got["steep"].line_index == 1 and abs(got["steep"].rotation_angle) == 90
    util = {r.image: r for r in lines.select_line(df, ["image"], profile="util").collect()}
    assert util["steep"].line_index is None and util["steep"].rotation_angle == 0 and not util["steep"].warning
    local = {r.image: r for r in lines.select_line(df, ["image"], profile="local").collect()}
    assert local["left"].detected_angle == pytest.approx(-180 + np.degrees(np.arctan2(10, 100))) and local["left"].rotation_angle == pytest.approx(-np.degrees(np.arctan2(10, 100)))
    for p in lines.PROFILES:
        chosen = {r.image: r.line_index for r in longest_by_window(df, ["image"], profile=p).collect()}
        assert {k: r.line_index for k, r in {"server": got, "util": util, "local": local}[p].items() if r.line_index is not None} == chosen
    images = spark.createDataFrame([("level",), ("none",)], "image string")
    all_ = {r.image: r for r in lines.with_lines(images, lines.select_line(df, ["image"]), ["image"]).collect()}
    assert set(all_) == {"level", "none"} and all_["none"].rotation_angle == 0 and all_["none"].total_lines == 0 and all_["none"].line_index is None


@pytest.mark.parametrize("degrees", [0, 8.99, 9.01, 14.99, 15.01, 19.99, 20.01, 90])
def test_level_limits(spark, degrees):
    for name, p in lines.PROFILES.items():
        assert spark.range(1).select(lines.is_level(F.lit(float(degrees)), p)).first()[0] == (degrees < p.level_below), name


INVOICE = "invoice_number string, invoice_date string, items array<struct<line_number int, description string, unit string, quantity int, unit_price double, vat_rate string>>, totals struct<total_incl_vat double>"


def invoice(number, date, quantity, rate, total):
    return {
        "invoice_number": number,
        "invoice_date": date,
        "items": [
            {"line_number": 1, "description": "REU032 HAIR STYLING CLAY Reuzel Clay Mate Pomade, 35g", "unit": "pcs", "quantity": quantity, "unit_price": 0.8, "vat_rate": rate},
            {"line_number": 2, "description": "REU44 EXTRA STRONG HOLD Reuzel Extreme Hold Matte Pomade, 35g", "unit": "pcs", "quantity": 3, "unit_price": 30.0, "vat_rate": "20%"},
        ],
        "totals": {"total_incl_vat": total},
    }


def test_golden_invoice(spark):
    schema = f"doc_type string, file_name string, record struct<{', '.join(INVOICE.replace('struct<line', 'struct<line').split(', '))}>"
    first = invoice("286552", "23.08.2024", 100, "20%", 753.8)
    del first["items"][0]["vat_rate"]
    first["items"][0]["vat_rate"] = "20%"
    truth = spark.createDataFrame([("invoice", "f", first), ("invoice", "g", first)], schema)
    seen = spark.createDataFrame([("invoice", "f", invoice("28655Z", "23.08.2O24", 10, "2O%", 752.8))], schema)
    got = {r.file_name: r for r in evaluate.compare(truth, seen, ["doc_type", "file_name"]).collect()}
    assert got["g"].cer == 1 and got["g"].wer == 1
    flat = truth.select(evaluate.flat_text(F.col("record"), truth.schema["record"].dataType)).first()[0]
    assert got["f"].cer == pytest.approx(5 / len(flat)) and got["f"].wer == pytest.approx(5 / len(flat.split()))
    assert len(flat) == 174 and len(flat.split()) == 32


def test_values_of_any_kind(spark):
    kind = T.StructType.fromDDL("a string, b array<array<string>>, c boolean, d map<string, int>, e date, f struct<>")
    df = spark.createDataFrame([(" x ", [["1", None], [], ["2", " "]], True, {"k": 7}, None, ()), (None, None, None, None, None, None)], kind)
    got = [r[0] for r in df.select(evaluate.values(F.struct(*df.columns), kind)).collect()]
    assert got == [["7", "True", "2", "1", "x"], []]


def test_registry(spark):
    extra = [{"name": "own:1", "display": "My Code", "model_type": "text", "input_type": "text_only", "streaming": False, "system": True, "prompt": "p", "temperature": 0.1, "tokens": 9, "languages": []}]
    models = registry.registry(spark, extra)
    asked = spark.createDataFrame([("llama3",), ("glm-ocr:latest",), ("own:1",), ("none",), (None,)], "model string")
    got = {r.model: (r.model_name, r.model_class) for r in registry.resolve(asked, models).collect()}
    assert got == {"llama3": ("llama3:latest", "Llama3TextModel"), "glm-ocr:latest": ("glm-ocr:latest", "GlmOcrModel"), "own:1": ("own:1", None), "none": (None, None), None: (None, None)}
    assert sorted(str(r.model) for r in registry.refused(asked, models).collect()) == ["None", "none"]
    assert {r.category: r.models for r in registry.by_category(models).collect()} == {"ocr": ["glm-ocr:latest"], "text_general": ["llama3:latest", "qwen:latest", "phi3:latest"], "text_code": ["codellama:latest", "own:1"], "vision": ["llava:latest", "moondream:latest"], "specialized": []}
    assert [registry.default_model(models, t).first().name for t in ("text", "ocr", "vision", "embedding")] == ["llama3:latest", "glm-ocr:latest", "llava:latest", "llama3:latest"]
    assert {r.name for r in registry.on_server(models, spark.createDataFrame([("qwen:latest",), ("qwen:latest",)], "name string")).where("available_on_server").collect()} == {"qwen:latest"}
    assert registry.available(models, "text", "text_code").count() == 2
    rows = spark.createDataFrame([("text_only", "", "i"), ("image_only", "t", None), ("text_and_image", None, ""), ("text_and_image", "t", None), ("custom", None, None)], "i string, t string, p string")
    assert [r[0] for r in rows.coalesce(1).select(registry.input_error(F.col("i"), F.col("t"), F.col("p"))).collect()] == ["text", "image", "text_or_image", None, None]
    assert spark.range(1).select(registry.load_label(F.lit("a"), F.array(F.lit("a"))), registry.is_text_model(F.lit("ocr")), registry.is_vision_model(F.lit("ocr"))).first()[:] == ("loaded", False, True)


def test_chat(spark):
    own = registry.registry(spark).withColumn("model_name", F.col("name")).withColumn("text", F.lit("hello"))
    text = json.loads(own.where("alias = 'llama3'").select(chat.request()).first()[0])
    assert text == {"model": "llama3:latest", "messages": [{"role": "system", "content": "You are a helpful assistant."}, {"role": "user", "content": "hello"}], "stream": False, "options": {"temperature": 0.7, "num_predict": 2048}}
    code = json.loads(own.where("alias = 'codellama'").select(chat.request(stops=True)).first()[0])
    assert code["options"]["stop"] == ["```", "def ", "class ", "if ", "for ", "while ", "{", "}"]
    for alias, system, heads in (("llava", "s", 2), ("llava", None, 1), ("glm-ocr", "s", 1)):
        body = chat.request(vision=True, image=F.lit("QQ=="), system=F.lit(system).cast("string"), text="empty")
        got = json.loads(own.withColumn("empty", F.lit("")).where(F.col("alias") == alias).select(body).first()[0])
        assert len(got["messages"]) == heads and got["messages"][-1]["images"] == ["QQ=="] and got["messages"][-1]["content"]
    answers = ['{"message": {"content": " hi \\n"}, "eval_count": 3}', "{}", '{"response": "x"}', "oops", None]
    got = spark.createDataFrame([(a,) for a in answers], "b string").coalesce(1).select(chat.answer(F.col("b")).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in got] == [("hi", 3, None), ("", 0, None), ("", 0, None), (None, None, "not_json"), (None, None, "not_json")]


EVENTS = "session_id long, ts timestamp, event_id long, action string, file_name string, kind string, payload string"
T0 = datetime(2024, 1, 1)


def events(n=120, seed=3):
    import random

    rnd, rows = random.Random(seed), []
    for i in range(n):
        action = rnd.choice(["upload", "upload", "remove", "result", "result", "clear"])
        rows.append((rnd.randrange(4), T0 + timedelta(seconds=i // 2), i, action, rnd.choice("xy") if action == "upload" else None, rnd.choice(["ocr", "binary"]), str(i)))
    return rows


def replay(rows):
    """What each session holds after each event."""
    state, out = {}, []
    for s, ts, i, action, name, kind, payload in sorted(rows, key=lambda r: (r[1], r[2])):
        own = state.setdefault(s, {"epoch": 0, "file": None, "results": {}})
        if action == "upload" and name != own["file"]:
            own.update(epoch=own["epoch"] + 1, file=name, results={})
        elif action == "remove":
            own["file"] = None
        elif action == "result":
            own["results"][kind] = payload
        elif action == "clear":
            own["results"].pop(kind, None)
        out.append((s, i, own["epoch"], own["file"], len(own["results"])))
    return state, out


def test_session_batch(spark):
    rows = events()
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    state, after = replay(rows)
    assert sorted((r.session_id, r.event_id, r.epoch) for r in session.epochs(df).collect()) == sorted(x[:3] for x in after)
    assert {(r.session_id, r.kind): r.payload for r in session.current_results(df).collect()} == {(s, k): p for s, o in state.items() for k, p in o["results"].items()}
    assert {r.session_id: r.file_name for r in session.current_files(df).collect()} == {s: o["file"] for s, o in state.items() if o["file"]}
    assert {r.session_id: (r.epochs, r.file_name, r.results) for r in session.summary(df).collect()} == {s: (o["epoch"], o["file"], len(o["results"])) for s, o in state.items()}


def test_session_in_spans(spark):
    """However a session is cut, also one that holds most of the events."""
    rows = events(400, 5) + [(9, T0 + timedelta(seconds=i % 97), 1000 + i, r[3], r[4], r[5], r[6]) for i, r in enumerate(events(300, 6))]
    rows += [(9, T0, 5000 + i, "result", None, "ocr", "x") for i in range(50)]
    want = sorted(x[:3] for x in replay(rows)[1])
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    for chunks in (1, 2, 7, 64, 500):
        assert sorted((r.session_id, r.event_id, r.epoch) for r in session.epochs(df, chunks).collect()) == want
    nobody = spark.createDataFrame([(None, T0 + timedelta(seconds=i), i, "upload", x, None, None) for i, x in enumerate("aabba")] + [(None, None, 9, "upload", "a", None, None)], EVENTS)
    assert sorted((r.event_id, r.epoch) for r in session.epochs(nobody, 3).collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (9, 1)]
    assert session.epochs(df.limit(0)).collect() == []


def test_a_hot_session_is_dealt_out(spark):
    """No window holds more than a span of the session."""
    rows = [(1 if i % 3 == 0 else i, T0 + timedelta(seconds=i), i, "upload", str(i % 5), None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, EVENTS)
    chunked = df.withColumn("chunk", session._chunk(df, 64)).groupBy("session_id", "chunk").count()
    assert chunked.agg(F.max("count")).first()[0] <= 3000 / 64 / 3 * 2


def test_session_stream(spark, tmp_path):
    """Events in any order within the watermark, after a first part that a batch has read."""
    import random

    from inkwell.plans import queries as plans

    rows = events(200, 4)
    early, late = [r for r in rows if r[1] < T0 + timedelta(seconds=40)], [r for r in rows if r[1] >= T0 + timedelta(seconds=40)]
    rnd = random.Random(1)
    late.sort(key=lambda r: r[1] + timedelta(seconds=rnd.random() * 8))
    parts = [late[i : i + 40] for i in range(0, len(late), 40)] + [[(99, T0 + timedelta(days=1), -1, "end", None, None, None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.3)
    before = session.state(spark.createDataFrame(early, EVENTS))
    source = plans.read_stream(spark, f"{tmp_path}/in", before.sparkSession.createDataFrame([], EVENTS).schema)
    found = plans.streamed(spark, stream.follow(source, "20 seconds", before), str(tmp_path))
    got = sorted((r.session_id, r.event_id, r.epoch, r.file_name, r.results) for r in found.where("event_id >= 0").collect())
    known = {x[1] for x in early}
    assert got == sorted(x for x in replay(rows)[1] if x[1] not in {r[2] for r in early}) and known
    visits = stream.active_windows(spark.createDataFrame([(1, T0), (1, T0 + timedelta(minutes=5)), (1, T0 + timedelta(hours=2))], "session_id long, ts timestamp_ntz"))
    assert sorted(r.events for r in visits.collect()) == [1, 2]


def page(degrees, size=(200, 300), channels=3):
    """A white page with black lines through it at an angle."""
    h, w = size
    yy, xx = np.mgrid[0:h, 0:w]
    t = np.deg2rad(degrees)
    across = (xx - w / 2) * np.sin(t) + (yy - h / 2) * np.cos(t)
    along = (xx - w / 2) * np.cos(t) - (yy - h / 2) * np.sin(t)
    ink = (np.abs(across) < 2) & (np.abs(along) < 90)
    gray = np.where(ink, 0, 255).astype(np.uint8)
    return np.repeat(gray[:, :, None], channels, axis=2)


def images(spark, arrays):
    rows = [(i, None if a is None else pixels.as_image(a, f"img{i}")) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, f"id int, image struct<{pixels.IMAGE}>")


@pytest.mark.parametrize("profile", ["server", "util", "local"])
def test_alignment(spark, profile):
    angles = [0, 2.35, -2.35, 9, -9]
    df = images(spark, [page(a) for a in angles] + [np.full((40, 50, 3), 255, np.uint8), None, page(3, channels=1)])
    got = {r.id: r for r in pixels.align(df, ["id"], profile=profile).collect()}
    for i, a in enumerate(angles):
        # The turned page is level again: its line is found at no angle.
        turned = pixels.as_array(got[i].rotated)
        h, w, _ = turned.shape
        again = images(spark, [turned[h // 2 - 60 : h // 2 + 60, w // 2 - 120 : w // 2 + 120]])  # without dark corners
        level = pixels.align(again, ["id"], profile=profile).first()
        assert got[i].line_index is not None and abs(abs(got[i].rotation_angle) - abs(a)) < 1.5
        assert abs(level.rotation_angle) < 1.2, (a, level.rotation_angle)
    assert got[5].rotation_angle == 0 and got[5].total_lines == 0 and got[5].rotated.height == 40
    assert got[6].rotated is None and got[6].error == "undecodable"
    assert got[7].rotated.nChannels == 1


def test_morphology_and_rotation():
    a = np.full((9, 9), 255, np.uint8)
    a[4, 4] = 0  # a dark speck goes by closing
    assert (pixels.close_open(a) == 255).all()
    b = 255 - a  # a light one by opening
    assert (pixels.close_open(b) == 0).all() and pixels.close_open(b, opened=False)[4, 4] == 255
    c = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (pixels.turned(c, 0) == c).all()
    assert (pixels.turned(c, 90, expand=True) == np.rot90(c)).all()
    corner = pixels.turned(np.zeros((40, 40, 3), np.uint8), 45)
    assert corner[0, 0, 0] == 255 and pixels.turned(np.zeros((40, 40, 3), np.uint8), 45, border=0)[0, 0, 0] == 0


def test_binarize(spark):
    px = [0, 127, 128, 129, 255]
    df = spark.createDataFrame([(px, t) for t in (-5, 0, 128, 255, 300)], "p array<int>, t int").coalesce(1)
    got = [tuple(r) for r in df.select(pixels.binarize(F.col("p"), F.col("t")), pixels.binarize_unclamped(F.col("p"), F.col("t"))).collect()]
    for t, (clamped, plain) in zip((-5, 0, 128, 255, 300), got):
        assert clamped == [255 * (p > min(max(t, 0), 255)) for p in px] and plain == [255 * (p > t) for p in px]


def test_png_files(spark, tmp_path):
    color = np.random.default_rng(1).integers(0, 256, (6, 9, 3)).astype(np.uint8)
    df = images(spark, [color, color[:, :, :1], np.concatenate([color, color[:, :, :1]], axis=2), None, np.full((30, 10, 3), 200, np.uint8)])
    out = df.select("id", pixels.to_png("image").alias("png"), pixels.binary_png(128)("image").alias("binary"), pixels.downscaled(5)("image").alias("small"), pixels.gray_values("image").alias("gray")).collect()
    rows = {r.id: r for r in out}
    assert rows[3].png is None and rows[3].binary is None
    for i in (0, 1, 2, 4):
        (tmp_path / f"{i}.png").write_bytes(rows[i].png)
        (tmp_path / f"s{i}.png").write_bytes(rows[i].small)
    (tmp_path / "bad.png").write_bytes(b"no image")
    back = {r.path.split("/")[-1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert (pixels.as_array(back["0.png"].image) == color).all() and (pixels.as_array(back["1.png"].image) == color[:, :, :1]).all() and (pixels.as_array(back["2.png"].image) == color).all()
    assert back["bad.png"].error == "undecodable" and back["bad.png"].image is None
    assert (back["s4.png"].image.height, back["s4.png"].image.width) == (5, 2) and set(back["s4.png"].image.data) == {200}
    assert rows[1].gray == color[:, :, 0].ravel().tolist()
    marked = pixels.with_line(df.where("id = 4").select("image", F.lit(1).alias("x1"), F.lit(5).alias("y1"), F.lit(8).alias("x2"), F.lit(5).alias("y2"))).first().marked
    assert marked[:4] == b"\x89PNG" and marked != rows[4].png
    read = files.read_files(spark, str(tmp_path), "*.png").where("size > 8").select("name", "ext", "size").collect()
    assert len(read) == 8 and {r.ext for r in read} == {".png"}


def test_docx(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r>{x}</w:p>" for t, x in (("one", "<w:r><w:tab/><w:t>tab</w:t></w:r>"), (" ", ""), ("два", "")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    df = spark.createDataFrame([(out.getvalue(),), (b"no",), (b"",), (None,)], "c binary").coalesce(1)
    assert [r[0] for r in df.select(files.docx_paragraphs("c")).collect()] == [["one\ttab", "два"], None, None, None]


def test_pdf_pages(spark):
    def rasterize(content, dpi):
        if content == b"bad":
            raise ValueError("broken")
        for n in (1, 2, 4):
            yield n, pixels.as_image(np.zeros((dpi // 100, 2, 1), np.uint8), f"p{n}")

    df = spark.createDataFrame([("a", b"pdf"), ("b", b"bad"), ("c", b"pdf")], "name string, content binary")
    got = files.pdf_pages(df, rasterize, ["name"])
    assert sorted((r.name, r.page_number or 0, r.error) for r in got.collect()) == [("a", 1, None), ("a", 2, None), ("a", 4, None), ("b", 0, "ValueError: broken"), ("c", 1, None), ("c", 2, None), ("c", 4, None)]
    assert [r.image.height for r in files.pdf_pages(df, rasterize, ["name"], dpi=150, first_page_only=True).where("error is null").collect()] == [1, 1]
    wanted = got.where("error is null").withColumn("w", F.when(F.col("name") == "a", 1).otherwise(9))
    assert sorted((r.name, r.page_number) for r in files.single_page(wanted, ["name"], "w").collect()) == [("a", 2), ("c", 1)]


def test_recognize(spark):
    df = images(spark, [page(0), None])
    got = {r.id: r for r in recognize.recognize(df, "echo", echo_recognizer()).collect()}
    assert got[0].text == "img0" and got[0].error is None and len(got[0].token_ids) == 4 and got[0].seconds >= 0
    assert got[1].text is None and "undecodable" in got[1].error
    assert {r.model: r.is_loaded for r in recognize.inventory(spark, ["a", "b"], ["b"]).collect()} == {"a": False, "b": True}


def test_ground_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"invoice": {"f.png": {"invoice_number": "1", "invoice_date": "d", "items": [{"line_number": 1, "description": "x", "unit": "y"}]}}, "payment_order": {"g.png": {"payment_order_number": "2"}}}, ensure_ascii=False, indent=2))
    store = ground_truth.read_json(spark, str(tmp_path / "t.json"))
    assert ground_truth.typed(store, "invoice").first().record["items"][0].description == "x"
    changes = spark.createDataFrame([("invoice", "f.png", "old", 1), ("invoice", "f.png", "new", 2), ("account_protocol", "h.png", "{}", 1)], "doc_type string, file_name string, record string, at int")
    after = ground_truth.upsert(store, changes, "at")
    ground_truth.write(after, str(tmp_path / "store"))
    got = {(r.doc_type, r.file_name): r.record for r in ground_truth.read(spark, str(tmp_path / "store")).collect()}
    assert got[("invoice", "f.png")] == "new" and len(got) == 3 and json.loads(got[("payment_order", "g.png")]) == {"payment_order_number": "2"}
    assert ground_truth.read(spark, str(tmp_path / "none")).collect() == []


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("pdf", "all", None), ("image", None, "one"), ("image", None, None)], "file_type string, combined_text string, text string")
    texts = df.select(export.download_text(F.col("file_type"), F.col("combined_text"), F.col("text")).alias("text"))
    export.write_text(texts, str(tmp_path / "txt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["all", "one"]
    export.write_json(df, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).orderBy(F.desc("value")).first().value) == {"file_type": "pdf", "combined_text": "all", "text": None}
    assert spark.range(1).select(export.from_base64(export.as_base64(F.lit(b"\x00x"))), export.from_base64(F.lit("!"))).first()[:] == (b"\x00x", None)


def test_text_pages_cut_before_they_are_rows(spark):
    rows = [("a", i, f"p{i}" if i % 4 else " ") for i in range(70)] + [("b", 0, None)]
    got = pages.text_pages(spark.createDataFrame(rows, "doc string, i int, t string"), ["doc"], "i", "t").orderBy("page").collect()
    want = [f"p{i}" for i in range(70) if i % 4]
    assert [(r.page, r.total_pages, r.first, r.last) for r in got] == [(1, 2, 1, 30), (2, 2, 31, 52)]
    assert [x for r in got for x in r.paragraphs] == want


def test_counts_and_tally(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", None, False), ("b", None, None)], "f string, image int, ok boolean")
    assert sorted(map(tuple, pages.converted(df, ["f"]).collect())) == [("a", 1), ("b", 0)]
    assert [tuple(r) for r in evaluate.tally(df, F.col("ok")).collect()] == [(1, 3, 1 / 3)]
    assert [tuple(r) for r in evaluate.tally(df.limit(0), F.col("ok")).collect()] == [(0, 0, None)]


def test_sessions_of_a_bucket_are_taken_at_once():
    """However events come in parts, all sessions of a bucket hold what each would by itself; also one that is null."""
    import pandas as pd

    rows = [(None if r[0] == 3 else r[0], *r[1:]) for r in events(400, 9)]
    want = {(s, i): rest for s, i, *rest in replay(rows)[1]}
    frame = pd.DataFrame([(s or 0, s is None, int(ts.timestamp()) * 1_000_000, i, *rest) for s, ts, i, *rest in rows], columns=stream._WAITING.names)
    for size in (400, 37, 1):
        sessions, results, got = stream._unpacked([], stream._SESSIONS), stream._unpacked([], stream._RESULTS), {}
        for at in range(0, len(rows), size):
            out, sessions, results = stream.taken(sessions, results, frame[at : at + size].sample(frac=1, random_state=1))
            got |= {(None if x.nobody else x.session_id, x.event_id): [x.epoch, x.file_name, x.results] for x in out.itertuples()}
        assert got == want
        assert {(None if x.nobody else x.session_id, x.kind): x.payload for x in results.itertuples()} == {(s, k): p for s, o in replay(rows)[0].items() for k, p in o["results"].items()}


def test_a_stream_keeps_state_by_buckets(spark, tmp_path):
    """Keys of state are buckets, however many sessions there are."""
    from inkwell.plans import queries as plans

    spark.range(500).selectExpr("id AS session_id", "timestamp'2024-01-01' AS ts", "id AS event_id", "'upload' AS action", "'x' AS file_name", "'ocr' AS kind", "'' AS payload").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    source = plans.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], EVENTS).schema)
    plans.streamed(spark, stream.follow(source, "1 second", buckets=5), str(tmp_path))
    kept = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state")
    assert kept.select("key.bucket").distinct().count() == 5
