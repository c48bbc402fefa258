"""Golden values of the column expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import confidence as conf
from inkwell.functions import errors, files, params, similarity


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


LOOKS = [
    (None, 10**6, 0.1), ("", 10**6, 0.1), (" \n\t ", 10**6, 0.1), ("abc", 10**6, 0.49), ("plain words here", 10**6, 0.7), ("plain words here", 100 * 100, 0.595),
    ("wooooord plain text", 10**6, 0.42), ("a" + "\n" * 6 + "b plain text", 10**6, 0.7), ("abcdefghij" * 500 + "k", 10**6, 0.63), ("ab!!cd??ef", 10**6, 0.56), ("ab!!cd??ef", 50_000, 0.56), ("ab!!cd??ef", 49_999, 0.476),
]


def test_heuristic(spark):
    got = one(spark, [x[:2] for x in LOOKS], "t string, a long", conf.heuristic(F.col("t"), F.col("a")), conf.heuristic(F.col("t")))
    for (text, area, want), (with_area, without) in zip(LOOKS, got):
        assert with_area == pytest.approx(want, abs=1e-9), text
        assert without == pytest.approx(want / 0.85 if area < 50_000 else want, abs=1e-9)
        assert with_area <= 0.7 + 1e-12


def test_heuristic_is_bounded(spark):
    rnd = random.Random(1)
    rows = [("".join(rnd.choice("ab !?\nñß.") for _ in range(rnd.randrange(60))), rnd.randrange(100_000), rnd.random()) for _ in range(200)]
    for looks, both in one(spark, rows, "t string, a long, p double", (h := conf.heuristic(F.col("t"), F.col("a"))), conf.combine(F.col("p"), h, F.lit(True))):
        assert 0 <= looks <= 0.7 + 1e-12 and 0 <= both <= 0.91 + 1e-12


def test_token_confidence(spark):
    rows = [
        ([0], [[1.0, 1.0, 1.0, 1.0]], 0), ([9, 9, 1], [[0.0, 100.0]], 2), ([1], [[100.0, 0.0]], 0), ([1, 0], None, 0), ([], [[1.0]], 0), ([0, 0, 0], [[1.0, 1.0], [0.0, 0.0]], 0), ([5], [[1.0, 1.0]], 0), ([1000], [[1e4, 0.0]], 1),
    ]
    got = one(spark, rows, "t array<int>, l array<array<float>>, n int", conf.sequence_confidence(F.col("t"), F.col("l"), F.col("n")))
    assert [x for (x,) in got] == pytest.approx([0.25, 1.0, 0.01, 0.5, 0.5, 0.5, 0.5, 0.5])


def test_combine_and_policies(spark):
    c = F.col
    rows = [("combined", 0.9, 0.6, True, True), ("combined", None, 0.6, False, True), ("tokens_only", 0.9, 0.6, True, True), ("tokens_only", None, 0.6, False, True), ("text_only", 0.9, 0.6, True, True), ("combined", 0.9, 0.6, True, False)]
    got = one(spark, rows, "p string, t double, l double, h boolean, w boolean", conf.by_policy(c("p"), c("t"), c("l"), c("h"), c("w")))
    assert [x for (x,) in got] == [pytest.approx(0.81), 0.6, pytest.approx(0.81), None, 0.6, None]


def test_bands(spark):
    got = one(spark, [(0.85,), (0.8499,), (0.7,), (0.6999,), (None,)], "c double", conf.level(F.col("c")), conf.band(F.col("c"))["label"])
    assert got == [("high", "Высокая"), ("medium", "Средняя"), ("medium", "Средняя"), ("low", "Низкая"), (None, None)]


NAMES = ["A.JPG", "a.b.pdf", "pdf", ".pdf", "x.tif", "x.tiff", "x.webp", "x.gif", "x.docx", "x.", "dir.v1/y", "dir/z.PNG", "", None]


def test_kinds(spark):
    got = one(spark, [(n,) for n in NAMES], "n string", files.ocr_kind("n"), files.convert_kind(F.lit(None).cast("string"), "n"), files.ocr_client_admits("n"), files.suffix("n"), files.stem("n"))
    assert [g[0] for g in got] == ["image", "pdf", "pdf", "pdf", None, "image", "image", None, None, None, None, "image", None, None]
    assert [g[1] for g in got] == ["image", "pdf", None, "pdf", None, None, "image", "image", None, None, None, "image", None, None]
    assert [g[2] for g in got] == [True, True, False, True, False, True, True, False, False, False, False, True, False, False]
    from pathlib import PurePosixPath

    for name, g in zip(NAMES, got):
        if name and name != "x.":  # a trailing dot is no suffix here whatever the Python version
            assert (g[3], g[4]) == (PurePosixPath(name).suffix.lower(), PurePosixPath(name).stem), name


def test_ui_kinds_and_gates(spark):
    mb = 1024 * 1024
    rows = [("image/png", ".xyz", 1), ("x/y", ".PDF", 10 * mb), ("x/y", ".docx", 10 * mb + 1), ("x/y", ".tif", 1), (None, None, 0), ("x/y", ".gif", 50 * mb + 1), ("x/y", ".gif", 0)]
    got = one(spark, rows, "mime string, ext string, size long", files.is_image(), files.is_pdf(), files.is_docx(), files.is_supported(), files.upload_refusal(), files.full_refusal(F.lit(True), length="size"), files.icon_kind())
    assert got == [
        (True, False, False, True, None, None, "image"), (False, True, False, True, None, None, "pdf"), (False, False, True, True, "too_large", None, "docx"), (False, False, False, False, "unsupported", "unsupported", "other"),
        (False, False, False, False, "unsupported", "unsupported", "other"), (True, False, False, True, "too_large", "too_large", "image"), (True, False, False, True, None, "empty", "image"),
    ]
    assert one(spark, [(1,)], "x int", files.full_refusal(F.lit(False), F.lit(1), F.lit(""), F.lit(""), F.lit(0))) == [("missing",)]
    previews = one(spark, [("application/pdf", ""), ("image/x", ""), ("", ".docx"), ("", ".txt")], "mime string, ext string", *(files.preview()[k] for k in ("dpi", "caption", "paragraphs_per_page", "show_page_selector")))
    assert previews == [(150, None, None, True), (None, "Изображение", None, None), (None, None, 30, True), (None, None, None, None)]


def test_names_and_sizes(spark):
    rows = [("Отчёт №5.v2.pdf", 1280), ("a b.c", 1023), ("x", 1024 * 1024), ("", 1024 * 1024 - 1)]
    got = one(spark, rows, "n string, s long", files.download_name("n", "txt"), files.safe_name("n"), files.human_size(F.col("s")), files.size_mb(F.col("s")))
    for (name, size), (download, safe, human, mb) in zip(rows, got):
        assert download == "ocr_" + re.sub(r"[^\w\-_\.]", "_", name.split(".")[0]) + ".txt"
        assert safe == "".join(c if c.isalnum() else "_" for c in name)[:20]
        assert human == (f"{size} B" if size < 1024 else f"{size / 1024:.1f} KB" if size < 2**20 else f"{size / 2**20:.1f} MB")
        assert mb == round(size / 2**20, 2)
    assert one(spark, [("p/scan.page.png", -2.345)], "n string, a double", files.aligned_name("n", F.col("a"))) == [("aligned_scan.page_-2.3deg.png",)]
    assert one(spark, [(1,)], "x int", files.request_id(F.lit("2024-01-01 00:00:00.123").cast("timestamp")), files.formats("convert"), files.image_like_formats()) == [
        ("req_1704067200123", [".bmp", ".gif", ".jpeg", ".jpg", ".pdf", ".png", ".webp"], [".bmp", ".gif", ".jpeg", ".jpg", ".pdf", ".png"])
    ]
    assert one(spark, [(b"ok",), (b"\xff",), (b"x" * 10_000,)], "b binary", files.readable_start(F.col("b"))) == [("ok",), (None,), (None,)]


def test_params(spark):
    values = ["128", " 7 ", "-1", "256", "1.5", "x", "", None, "99999", "1_0"]
    got = one(spark, [(v,) for v in values], "v string", params.threshold(F.col("v"))["value"], params.threshold(F.col("v"))["error"], params.line_params(F.col("v"), F.col("v"), F.col("v")))
    assert [g[:2] for g in got] == [(128, None), (7, None), (None, "out_of_range"), (None, "out_of_range"), *[(None, "not_a_number")] * 4, (None, "out_of_range"), (10, None)]
    assert [tuple(g[2]) for g in got] == [(128, 100, True), (10, 7, True), (10, 1, True), (256, 100, True), (50, 20, True), (50, 20, True), (50, 20, False), (50, 20, True), (500, 100, True), (10, 10, True)]
    got = one(spark, [("360",), ("-360.1",), ("NaN",), ("left",), (None,), ("1e2",)], "v string", params.rotation_angle(F.col("v"))["error"])
    assert [x for (x,) in got] == [None, "out_of_range", None, "not_a_number", "not_a_number", None]
    got = one(spark, [(0, 3), (9, 3), (2, 3), (-1, 3)], "p int, n int", params.page_clamp(F.col("p"), F.lit(1), F.col("n")), params.saved_page(F.col("p"), F.col("n")), params.zero_page(F.col("p"), F.col("n")))
    assert got == [(1, 1, 0), (3, 1, 0), (2, 2, 2), (1, 1, 0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    rnd = random.Random(2)
    rows = [("", ""), ("", "x"), ("abc", ""), ("äb", "ab"), (" a  b ", "a b"), ("日本 語", "日 本語")]
    rows += [tuple(" ".join(rnd.choice(["a", "b", "ä", "cc", "\n"]) for _ in range(rnd.randrange(9))) for _ in range(2)) for _ in range(80)]
    for (a, b), (c, w, p) in zip(rows, one(spark, rows, "a string, b string", similarity.cer(F.col("a"), F.col("b")), similarity.wer(F.col("a"), F.col("b")), similarity.positional(F.col("a"), F.col("b")))):
        x, y = a.split(), b.split()
        assert c == pytest.approx(distance(a, b) / len(a) if a else float(bool(b)))
        assert w == pytest.approx(distance(x, y) / len(x) if x else float(bool(y)))
        s, t = a.strip().lower(), b.strip().lower()
        assert p == pytest.approx(100 if s == t else sum(i == j for i, j in zip(s, t)) / max(len(s), len(t)) * 100), (a, b)


def test_many_words(spark):
    a = [f"w{i}" for i in range(30_000)]
    ((got,),) = one(spark, [(" ".join(a[:300]), " ".join(a[29_000:29_200] + a[:100]))], "a string, b string", similarity.wer(F.col("a"), F.col("b")))
    assert got == pytest.approx(distance(a[:300], a[29_000:29_200] + a[:100]) / 300)


def test_errors(spark):
    rows = [
        ("api", "m", None, None, None, None), ("api", "m", 404, "/ocr", None, None), ("ocr_server", "m", 500, "/ocr", "glm", None), ("preprocessing_server", "m", 0, None, None, None), ("api", "m", None, None, None, "rotate"),
        ("file", "is EMPTY", None, None, None, None), ("validation", "m", None, None, None, None), ("image", "out of memory", None, None, None, None), ("odd", "m", None, None, None, None),
    ]
    e = F.struct(*errors.SCHEMA.replace(" string", "").replace(" int", "").replace(" ", "").split(","))
    got = one(spark, rows, errors.SCHEMA, errors.category(e), errors.message(e), errors.hint(e))
    assert got == [
        ("unknown", "APIError: m", None), ("ocr", "APIError (404): m", "check_url"), ("ocr", "APIError (500): m [endpoint=/ocr | model=glm]", "server_failed"), ("preprocessing", "APIError: m [operation=unknown]", None), ("preprocessing", "APIError: m", None),
        ("file", "is EMPTY", "other_file"), ("validation", "m", "check_value"), ("image", "out of memory", "lower_resolution"), ("unknown", "m", None),
    ]
    texts = [("404 Client Error", "deepseek-ocr2"), ("No module PaddleNLP", "x"), ("needs accelerate", "x"), ("other", "x")]
    assert [x for (x,) in one(spark, texts, "t string, m string", errors.load_failure(F.col("t"), F.col("m")))] == ["model_not_published", "dependency_paddlenlp", "dependency_accelerate", "other"]
