"""Queries over the given tables.

The tables hold no images or uploads, so inputs are derived from their columns:
documents and conversation turns stand for recognised texts and pages, vectors
for logits and pixels, order lines for segments, events for sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import confidence as conf
from ..functions import documents, errors, files, params, similarity
from ..operators import chat, evaluate, lines, pages, pixels, recognize, registry, session, tokens
from ..sources import export, ground_truth, shared
from ..sources import files as file_sources
from ..streaming import pages as page_stream_
from ..streaming import session as stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt out for work that is heavy per row; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def _six(value: Column) -> Column:
    """Transcendental results may differ in their last digits."""
    return F.round(value, 6)


#: Files that a stream's events are dealt out to, and events of all files in one bucket of sessions, about.
STREAM_FILES, BUCKET_EVENTS = 3, 200_000


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Folders of Parquet files as a stream, a file at a time."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def streamed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until all files are read, written to the folder and read back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, stream.ROCKS)
    try:
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


# Recognised texts: the documents, with an image size that follows from the id.
def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (100 + F.col("doc_id") % 400) * (100 + F.col("doc_id") % 300)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", conf.heuristic(F.col("text"), area).alias("confidence"))


def confidence_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return scored_documents(spark, sf_dir).select("doc_id", _six(c).alias("confidence"), conf.level(_six(c)).alias("level"))


def confidence_band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = confidence_heuristic(spark, sf_dir)
    return own.groupBy("level").agg(F.count("*").alias("documents"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


def confidence_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is told about a document's confidence."""
    own = confidence_combined(spark, sf_dir)
    told = conf.band(F.col("confidence"))
    return own.select("doc_id", *(told[c].alias(c) for c in ("level", "label", "color", "sign", "advice")))


# Logits: a vector is one step, its label the token; eight neighbouring ids make up a document.
def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("doc_id"), conf.token_probability(F.col("embedding"), F.col("label")).alias("p"))
    return steps.groupBy("doc_id").agg(F.count("p").alias("steps"), _six(conf.mean_confidence(F.col("p"))).alias("token_confidence"))


def token_confidence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a row per logit."""
    own = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("doc_id"), F.col("vec_id").alias("step"), F.col("label").alias("made"), F.posexplode("embedding").alias("token", "logit"))
    return tokens.confidence(own, ["doc_id"]).select("doc_id", "steps", _six(F.col("confidence")).alias("token_confidence"))


def confidence_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = token_confidence(spark, sf_dir)
    own = scored_documents(spark, sf_dir).join(token, "doc_id", "left")
    model = pick(list(conf.POLICIES), F.col("doc_id") % 4)
    policy = pick(list(conf.POLICIES.values()), F.col("doc_id") % 4)
    score = conf.by_policy(policy, F.col("token_confidence"), F.col("confidence"), F.col("token_confidence").isNotNull(), F.col("doc_id") % 10 != 9)
    return own.select("doc_id", model.alias("model"), _six(score).alias("confidence"))


# Pages: conversation turns; some have no score, some failed.
def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("turn") % 7 == 5
    return spread(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        F.col("turn").alias("page_number"),
        F.when(~failed, F.when(F.col("turn") % 6 == 4, "").otherwise(F.col("text"))).alias("text"),
        F.when(~failed & (F.col("turn") % 5 != 3), conf.heuristic(F.col("text"))).alias("confidence"),
        F.when(failed, "failed").alias("error"),
    )


def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled_up(pages.rollup(recognised_pages(spark, sf_dir), ["conv_id"]))


def _rolled_up(found: DataFrame) -> DataFrame:
    per_page = F.array_join(F.transform("confidence_per_page", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    return found.select("conv_id", "total_pages", "processed_pages", "failed_pages", _six(F.col("confidence")).alias("confidence"), per_page.alias("confidence_per_page"))


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from pages that come one by one, some twice; of a third of the documents nobody knows how many pages they have."""
    own = recognised_pages(spark, sf_dir)
    n = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    i, k = F.col("conv_id"), F.col("page_number")
    ts = F.timestamp_seconds(1_700_000_000 + i % 1000 + F.coalesce(k, F.lit(0)) * 7 % 60)
    rows = own.join(n, "conv_id").select(i.alias("document"), k.cast("long").alias("page_number"), F.when(i % 3 != 0, F.col("n")).alias("pages"), "text", "confidence", "error", ts.alias("ts"))
    folder = shared.new_folder(spark)
    end = {"document": F.lit(-1).cast("long"), "page_number": F.lit(0).cast("long"), "ts": F.timestamp_seconds(F.lit(1_800_000_000))}
    last = spark.range(1).select(*(c.alias(name) for name, c in end.items()))  # the clock goes on when all has come
    part = F.pmod(F.xxhash64("document", "page_number"), F.lit(STREAM_FILES))
    for j in range(STREAM_FILES):  # every fourth page comes once more, in the file after its own
        again = F.pmod(F.xxhash64("page_number", "document"), F.lit(4)) == 0
        own = rows.where((part == j) | (again & (part == j - 1)))
        own = own.unionByName(last, allowMissingColumns=True) if j == STREAM_FILES - 1 else own
        own.coalesce(1).write.parquet(f"{folder}/in/{j}")
    gathered = streamed(spark, page_stream_.gather(read_stream(spark, f"{folder}/in", rows.schema), "1 hour"), folder)
    return _rolled_up(page_stream_.rolled_up(gathered.where("document >= 0")).withColumnRenamed("document", "conv_id"))


def document_text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.rollup(recognised_pages(spark, sf_dir), ["conv_id"]).select("conv_id", "combined_text")


def pages_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.result_structs(recognised_pages(spark, sf_dir), ["conv_id"])
    own = pages.pages_with_text(F.col("pages"))
    second = pages.page_by_number(F.col("pages"), F.lit(1))
    return found.select("conv_id", F.array_join(F.transform(own, lambda p: p["page_number"].cast("string")), ",").alias("numbers"), second["text"].alias("second_text"))


# Segments: an order is an image, its lines are segments with whole coordinates.
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    y1 = F.col("l_suppkey") * 13 % 400
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_linenumber").alias("line_index"),
        (F.col("l_partkey") * 7 % 600).alias("x1"),
        y1.alias("y1"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 97) % 600).alias("x2"),
        (y1 + (F.col("l_quantity").cast("long") * 3 + F.col("l_linenumber") * 11) % 90 - 40).alias("y2"),
    )


def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.geometry(segments(spark, sf_dir), "server")
    return found.select("image_id", "line_index", _six(F.col("length")).alias("length"), _six(F.col("angle")).alias("angle"), "is_level")


def _line_select(profile: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = lines.select_line(segments(spark, sf_dir), ["image_id"], profile=profile)
        rounded = {c: _six(F.col(c)) for c in ("length", "detected_angle", "rotation_angle")}
        return found.withColumns(rounded)

    return query


# Recognised text with mistakes that follow from it.
def _misread(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "aeo", "430"), "th|é", "t")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("text").alias("reference"), _misread(F.col("text")).alias("hypothesis"))


def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", _six(similarity.cer(F.col("reference"), F.col("hypothesis"))).alias("cer"))


def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("conv_id", "turn", _six(similarity.wer(F.col("reference"), F.col("hypothesis"))).alias("wer"))


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("reference"), F.col("hypothesis")
    return _pairs(spark, sf_dir).select("conv_id", "turn", _six(similarity.positional(a, b)).alias("percent"), similarity.round_trip_passes(a, b).alias("passes"))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a conversation and its misread copy, compared as nested values."""
    own = evaluate.evenly(table(spark, sf_dir, "conversations"), "conv_id")  # the group-by takes these partitions as they are
    item = F.struct(F.col("turn").alias("line_number"), F.col("role").alias("unit"), F.when(F.col("turn") % 3 != 2, F.col("text")).alias("description"))
    truth = own.groupBy("conv_id").agg(F.struct(F.concat(F.lit("C-"), F.col("conv_id").cast("string")).alias("number"), F.array_sort(F.collect_list(item)).alias("items"), F.struct((F.count("*") * 0.25).alias("total")).alias("totals")).alias("record"))
    kind = truth.schema["record"].dataType
    flat = truth.select("conv_id", evaluate.flat_text(F.col("record"), kind).alias("reference"))
    return flat.select("conv_id", "reference", _six(similarity.cer(F.col("reference"), _misread(F.col("reference")))).alias("cer"))


# Files: names, types and sizes that follow from a document's id.
_ENDS = [".JPG", ".pdf", ".tif", ".tiff", ".webp", ".gif", ".docx", ".txt", ".Json", "", ".tar.gz", ".png", "."]
_MIMES = [None, "image/png", "application/pdf", "application/octet-stream", "image/webp"]


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.when(i % 11 == 0, ".").otherwise(F.concat(F.lit("Файл "), F.col("source"), F.lit("_"))), i.cast("string"), F.when(i % 4 == 1, ".v2").otherwise(""), pick(_ENDS, i % len(_ENDS)))
    size = F.when(i % 17 == 0, 0).otherwise(F.col("n_chars") * 9973 % 60_000_000)
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), pick(_MIMES, i % len(_MIMES)).alias("mime"), size.cast("long").alias("size"))


def file_classify_ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uploads(spark, sf_dir).withColumn("ext", files.suffix("name"))
    return own.select("doc_id", "ext", files.is_image().alias("is_image"), files.is_pdf().alias("is_pdf"), files.is_docx().alias("is_docx"), files.is_supported().alias("is_supported"), files.is_image_like().alias("is_image_like"), files.icon_kind().alias("icon"))


def file_classify_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("doc_id", files.ocr_kind().alias("kind"), files.ocr_client_admits().alias("admitted"))


def file_classify_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("doc_id", files.convert_kind().alias("kind"))


def file_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uploads(spark, sf_dir).withColumn("ext", files.suffix("name"))
    present = F.col("doc_id") % 19 != 0
    return own.select("doc_id", files.upload_refusal().alias("upload"), files.full_refusal(present, length="size").alias("full"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uploads(spark, sf_dir)
    meta = files.metadata()
    return own.select(
        "doc_id",
        meta["stem"].alias("stem"),
        meta["size_mb"].alias("size_mb"),
        files.human_size(F.col("size")).alias("human_size"),
        files.download_name("name", "txt").alias("download_name"),
        files.safe_name("name").alias("safe_name"),
        files.binary_name("name", F.col("doc_id") % 9, F.col("doc_id") % 256).alias("binary_name"),
    )


def param_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 9 == 0, "many").when(i % 9 == 1, None).otherwise((F.col("n_chars") % 700 - 40).cast("string"))
    angle = F.when(i % 9 == 0, "NaN").when(i % 9 == 1, "left").otherwise(((F.col("n_chars") % 8000 - 4000) / 10).cast("string"))
    got, limit, turn = params.line_params(raw, raw, F.when(i % 3 == 0, "").when(i % 3 == 1, "false")), params.threshold(raw), params.rotation_angle(angle)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        got["min_line_length"].alias("min_line_length"),
        got["max_line_gap"].alias("max_line_gap"),
        got["use_morphology"].alias("use_morphology"),
        limit["value"].alias("threshold"),
        limit["error"].alias("threshold_error"),
        turn["error"].alias("angle_error"),
        params.request_error(limit["value"], got["min_line_length"], got["max_line_gap"]).alias("status"),
    )


# Pixels: vectors scaled to gray values.
def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256 + 128), F.lit(0)), F.lit(255)).cast("int"))
    found = table(spark, sf_dir, "embeddings").select("vec_id", pixels.binarize(gray, (F.col("vec_id") % 300 - 20).cast("int")).alias("b"))
    return found.select("vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.when(x == 255, 1).otherwise(0)).alias("white"), F.array_join(F.transform("b", lambda x: F.when(x == 255, "1").otherwise("0")), "").alias("bits"))


def binarize_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on bytes, with thresholds moved into range and as they are."""
    gray = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256 + 128), F.lit(0)), F.lit(255)).cast("int"))
    t = F.col("vec_id") % 300 - 20

    def bits(found: Column) -> Column:
        return F.replace(F.replace(F.hex(found), F.lit("FF"), F.lit("1")), F.lit("00"), F.lit("0"))

    own = table(spark, sf_dir, "embeddings").select("vec_id", pixels.gray_bytes(gray).alias("pixels"))
    return own.select("vec_id", bits(pixels.binarize_bytes(F.col("pixels"), t)).alias("bits"), bits(pixels.binarize_bytes(F.col("pixels"), t, clamped=False)).alias("unclamped"))


def docx_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a source's documents as the paragraphs of one file each."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = pages.text_pages(own, ["doc_id"], "pos", "line", per_page=5)
    return found.select("doc_id", "page", "total_pages", "first", "last", F.size("paragraphs").alias("paragraphs"), F.array_join("paragraphs", "\n").alias("text"))


# Requests: a document asks for a model by name, alias or something unknown.
_WANTED = ["llama3", "glm-ocr:latest", "codellama", "llava", "unknown", "moondream:latest", "phi3", "qwen"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", pick(_WANTED, F.col("doc_id") % len(_WANTED)).alias("model"))


def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.resolve(requests(spark, sf_dir), registry.registry(spark))
    return found.select("doc_id", "model", "model_name", "model_class", F.when(F.col("model_name").isNull(), 400).alias("status_code"))


def registry_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests go to each category, also to those without any."""
    models = registry.registry(spark)
    asked = registry.resolve(requests(spark, sf_dir), models).where("model_name is not null")
    counts = asked.join(F.broadcast(models.select(F.col("name").alias("model_name"), "category")), "model_name").groupBy("category").agg(F.count("*").alias("requests"))
    found = registry.by_category(models).join(counts, "category", "left")
    return found.select("category", F.array_join("models", ",").alias("models"), F.coalesce("requests", F.lit(0)).alias("requests"))


def chat_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = registry.registry(spark)
    asked = registry.resolve(requests(spark, sf_dir), models).where("model_name is not null")
    own = asked.join(F.broadcast(models.withColumnRenamed("name", "model_name")), "model_name").withColumn("image", F.when(F.col("doc_id") % 3 == 0, F.base64(F.col("doc_id").cast("string").cast("binary"))))
    vision = registry.is_vision_model(F.col("model_type"))
    body = F.when(vision, chat.request(image=F.col("image"), vision=True)).when(F.col("category") == "text_code", chat.request(stops=True)).otherwise(chat.request())
    lacks = registry.input_error(F.col("input_type"), F.col("text"), F.col("image"))
    got = F.from_json(body, "model string, messages array<struct<role: string, content: string, images: array<string>>>, options struct<temperature: double, num_predict: int, stop: array<string>>")
    last = F.element_at(got["messages"], -1)
    return own.select(
        "doc_id",
        got["model"].alias("model"),
        F.size(got["messages"]).alias("messages"),
        F.element_at(got["messages"], 1)["role"].alias("first_role"),
        last["content"].alias("content"),
        F.coalesce(F.size(last["images"]), F.lit(0)).alias("images"),
        got["options"]["num_predict"].alias("num_predict"),
        F.coalesce(F.size(got["options"]["stop"]), F.lit(0)).alias("stops"),
        lacks.alias("lacks"),
    )


def chat_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several forms around the turns of conversations."""
    i = F.col("turn") % 4
    message = F.to_json(F.struct(F.struct(F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("content")).alias("message"), F.length("text").alias("eval_count")))
    body = F.when(i == 0, message).when(i == 1, F.to_json(F.struct(F.col("text").alias("response")))).when(i == 2, F.col("text")).otherwise("{}")
    got = chat.answer(body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", got["text"].alias("text"), got["tokens_used"].alias("tokens_used"), got["error"].alias("error"))


def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["api", "ocr_server", "preprocessing_server", "file", "validation", "image", "timeout"]
    value = F.col("value").cast("long")
    error = F.struct(
        pick(kinds, F.col("event_id") % 7).alias("kind"),
        F.col("event_type").alias("message"),
        F.when(value % 3 != 0, pick([400, 404, 500, 503], value % 4)).cast("int").alias("status_code"),
        F.when(F.col("user_id") % 2 == 0, "/ocr").alias("endpoint"),
        F.when(F.col("user_id") % 3 == 0, "glm-ocr").alias("model"),
        F.when(F.col("user_id") % 5 == 0, "rotate").alias("operation"),
    )
    return table(spark, sf_dir, "events").select("event_id", errors.category(error).alias("category"), errors.message(error).alias("message"), errors.hint(error).alias("hint"))


# Sessions: a user's events; sign-ups remove the file, errors clear a result.
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "upload").when(F.col("event_type") == "signup", "remove").when(F.col("event_type") == "error", "clear").otherwise("result")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        action.alias("action"),
        F.when(action == "upload", F.concat(F.lit("file"), (F.col("event_id") % 3).cast("string"))).alias("file_name"),
        pick(["ocr", "binary", "rotation"], F.col("event_id") % 3).alias("kind"),
        F.col("props").alias("payload"),
    )


def session_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.epochs(session_events(spark, sf_dir)).select("event_id", "session_id", "epoch")


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream: the first third of the time as a batch, the rest as files in which events stand up to two hours late."""
    events = session_events(spark, sf_dir)
    low, high, n = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count("*")).first()
    at, jitter = F.unix_micros("ts"), F.pmod(F.xxhash64("event_id"), F.lit(7200)) * 1_000_000
    start = (low or 0) + ((high or 0) - (low or 0)) // 3
    width = max(1, ((high or 0) - start + 7_200_000_000) // STREAM_FILES + 1)
    before, rest = events.where(at < start), events.where(at >= start).withColumn("part", F.floor((at + jitter - start) / width))
    folder = shared.new_folder(spark)
    # The clock goes on when all has come, so that nobody waits any longer: an event of no session, which is left out again.
    end = {"session_id": F.lit(-1).cast("long"), "ts": F.timestamp_micros(F.lit((high or 0) + 10**11)), "event_id": F.lit(-1).cast("long"), "action": F.lit("end"), "part": F.lit(STREAM_FILES - 1).cast("long")}
    rest = rest.unionByName(spark.range(1).select(*(c.alias(n) for n, c in end.items())), allowMissingColumns=True)
    for i in range(STREAM_FILES):  # one after another: the source takes files by their age
        rest.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/in/{i}")
    state = shared.materialise(session.state(before), "before")
    found = streamed(spark, stream.follow(read_stream(spark, f"{folder}/in", events.schema), "2 hours 10 minutes", state, max(32, n // BUCKET_EVENTS)), folder)
    return session.epochs(before).select("event_id", "session_id", "epoch").unionByName(found.where("event_id >= 0").select("event_id", "session_id", "epoch"))


def session_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.current_results(session_events(spark, sf_dir))


def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.summary(session_events(spark, sf_dir))


def _store_and_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of documents, and changes that follow from the labels."""
    i = F.col("doc_id")
    kind = pick(list(ground_truth.RECORDS), i % 4)
    store = table(spark, sf_dir, "documents").select(kind.alias("doc_type"), F.concat(F.lit("f"), i.cast("string")).alias("file_name"), F.to_json(F.struct("lang", "n_chars")).alias("record"))
    changes = table(spark, sf_dir, "labels").select(kind.alias("doc_type"), F.concat(F.lit("f"), (i - i % 8 + i % 4).cast("string")).alias("file_name"), F.to_json(F.struct("quality", "toxic")).alias("record"), i.alias("at"))
    return store, changes


def ground_truth_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth.upsert(*_store_and_changes(spark, sf_dir), "at")


def ground_truth_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with changes that come as files, later ones first, into a store of which only touched parts are written."""
    store, changes = _store_and_changes(spark, sf_dir)
    folder = shared.new_folder(spark)
    ground_truth.start(store, f"{folder}/store")
    for i in range(3):
        changes.where(F.col("at") % 3 == 2 - i).coalesce(1).write.parquet(f"{folder}/in/{i}")
    ground_truth.follow_changes(read_stream(spark, f"{folder}/in", changes.schema), f"{folder}/store", f"{folder}/state").awaitTermination()
    return ground_truth.current(spark, f"{folder}/store").select("doc_type", "file_name", "record")


def ground_truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of about a thousand documents as JSON files, read in byte ranges; names hold quotes and braces."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 1000").alias("part"), pick(["invoice", 'pay{"ment', "protocol}"], i % 3).alias("doc_type"), F.concat(F.lit('f"}{'), i.cast("string"), F.lit("\\")).alias("file_name"), F.struct("doc_id", "lang", "text").alias("record")
    )
    docs = docs.repartition("part")  # once for both groupings
    types = docs.groupBy("part", "doc_type").agg(F.map_from_entries(F.collect_list(F.struct("file_name", "record"))).alias("files"))
    texts = types.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("doc_type", "files")))).alias("value"))
    path = f"{shared.new_folder(spark)}/stores"
    texts.write.partitionBy("part").text(path)
    got = F.from_json("record", "doc_id long, lang string, text string")
    found = ground_truth.read_json(spark, path).withColumn("got", got)
    return found.select("doc_type", "file_name", "got.doc_id", "got.lang", F.md5(F.col("got.text").cast("binary")).alias("digest"))


# Records: a turn is a record, of which the recognised copy has misread texts; some copies are missing.
def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of whole nested records."""
    own = table(spark, sf_dir, "conversations")

    def record(text: Column) -> Column:
        item = F.struct(F.col("turn").alias("line_number"), F.col("role").alias("unit"), text.alias("description"))
        number = F.concat(F.lit("C-"), F.col("conv_id").cast("string"))
        return F.struct(number.alias("number"), F.array(item).alias("items"), F.struct((F.col("turn") * 0.25).alias("total")).alias("totals")).alias("record")

    truth = own.select("conv_id", "turn", record(F.col("text")))
    seen = own.where("conv_id % 9 <> 4").select("conv_id", "turn", record(_misread(F.col("text"))))
    found = evaluate.compare(truth, seen, ["conv_id", "turn"])
    return found.select("conv_id", "turn", _six(F.col("cer")).alias("cer"), _six(F.col("wer")).alias("wer"))


# Records of no declared type: what a conversation's record holds depends on its id.
def mixed_records(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """JSON texts with lists in lists, numbers, booleans, nulls and blank strings."""
    i, n = F.col("conv_id"), F.col("turn")
    own = evaluate.evenly(table(spark, sf_dir, "conversations"), "conv_id")
    turn = F.struct(n.alias("n"), F.concat(text, F.lit(' "\\\t')).alias("said"), F.when(n % 3 == 1, F.col("role")).alias("who"), F.array(F.array((n * 0.5).alias("x"), F.lit(None)), F.array(n * 1000003.25)).alias("box"), (n % 2 == 0).alias("even"), F.lit("  ").alias("blank"))
    turns = F.array_sort(F.collect_list(turn))
    total = (i % 7) * F.when(i % 2 == 0, 1e-5).otherwise(1e15)
    kinds = [
        F.to_json(F.struct(F.lit("list").alias("kind"), turns.alias("turns"), total.alias("total"))),
        F.to_json(F.struct(F.struct(F.struct(turns.alias("deep"), total.alias("a:b")).alias("in")).alias("out"), i.alias("id"))),
        F.concat(F.lit("[["), F.to_json(turns), F.lit("],[[["), F.to_json(turns), F.lit("]]]]")),
    ]
    record = F.when(i % 3 == 0, kinds[0]).when(i % 3 == 1, kinds[1]).when(i % 9 == 8, F.lit("{broken")).otherwise(kinds[2])
    return own.groupBy("conv_id").agg(record.alias("record"))


def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of records of which no type is known, the last one first."""
    found = documents.json_values(F.col("record"))
    return mixed_records(spark, sf_dir, F.col("text")).select("conv_id", F.size(found).alias("n"), F.array_join(found, "|").alias("joined"))


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of records of no declared type, some of which weren't recognised."""
    truth = mixed_records(spark, sf_dir, F.col("text"))
    seen = mixed_records(spark, sf_dir, _misread(F.col("text"))).where("conv_id % 5 <> 2")
    return evaluate.compare(truth, seen, ["conv_id"]).select("conv_id", _six(F.col("cer")).alias("cer"))


def round_trip_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of a conversation come through a round trip."""
    a, b = F.col("reference"), F.col("hypothesis")
    found = evaluate.tally(_pairs(spark, sf_dir), similarity.round_trip_passes(a, b, 80.0), ["conv_id"])
    return found.select("conv_id", "passed", "total", _six(F.col("share")).alias("share"))


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that each file was converted into: pages that didn't fail."""
    return pages.converted(recognised_pages(spark, sf_dir).withColumn("image", F.when(F.col("error").isNull(), F.col("page_number"))), ["conv_id"])


def page_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per page in page order; they follow from the page's number and file."""
    timed = recognised_pages(spark, sf_dir).withColumn("seconds", ((F.col("page_number") * 37 + F.col("conv_id") * 11) % 400) / 64)
    found = pages.rollup(timed, ["conv_id"], seconds="seconds")
    return found.select("conv_id", F.array_join(F.transform("seconds_per_page", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("hundredths"))


def page_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where selectors of a conversation's pages start for wanted and remembered pages, also ones that aren't there."""
    own = table(spark, sf_dir, "conversations")
    n = own.groupBy("conv_id").agg(F.count("*").alias("pages"))
    wanted = F.col("turn") * 3 - 2
    found = own.join(n, "conv_id")
    return found.select("conv_id", "turn", params.page_clamp(wanted, F.lit(1), F.col("pages")).alias("clamped"), params.saved_page(wanted, F.col("pages")).alias("saved"), params.zero_page(wanted, F.col("pages")).alias("from_zero"))


def file_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uploads(spark, sf_dir).withColumn("ext", files.suffix("name"))
    return own.select("doc_id", files.source_kind().alias("kind"))


def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = uploads(spark, sf_dir).withColumn("ext", files.suffix("name"))
    shown = files.preview()
    return own.select("doc_id", *(shown[c].alias(c) for c in ("dpi", "caption", "paragraphs_per_page", "show_page_selector")), files.icon().alias("icon"))


def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted formats of each service, and how many uploads have each of them."""
    used = uploads(spark, sf_dir).withColumn("format", files.suffix("name")).groupBy("format").agg(F.count("*").alias("uploads"))
    lists = [spark.range(1).select(F.lit(p).alias("profile"), F.posexplode(files.formats(p)).alias("place", "format"), files.image_like_formats(p).alias("like")) for p in files.PROFILES]
    known = lists[0]
    for more in lists[1:]:
        known = known.unionByName(more)
    found = known.join(used, "format", "left")
    return found.select("profile", "place", "format", F.array_contains("like", F.col("format")).alias("image_like"), F.coalesce("uploads", F.lit(0)).alias("uploads"))


def raw_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of files as text; every seventh file isn't valid UTF-8."""
    text = F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.unhex(F.lit("FF")))).otherwise(text)
    shown = files.readable_start(content)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(shown).alias("digest"), F.length(shown).alias("characters"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of aligned images."""
    return uploads(spark, sf_dir).select("doc_id", files.aligned_name("name", (F.col("size") % 901 - 450) / 10).alias("aligned_name"))


# Errors: events stand for failed loads.
_FAILURES = ["404 Client Error: Not Found", "No module AIStudio_SDK", "PaddleNLP is missing", "needs accelerate>=0.26", "CUDA out of memory"]


def load_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text, model = F.concat(pick(_FAILURES, i % 5), F.lit(" / "), F.col("event_type")), pick(["deepseek-ocr2", "glm-ocr", "deepseek-ocr"], i % 3)
    reason = errors.load_failure(text, model)
    return table(spark, sf_dir, "events").select("event_id", files.request_id(F.col("ts").cast("timestamp")).alias("request_id"), reason.alias("reason"), errors.shortened(reason, 15).alias("short"))


def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of errors that hold a byte which isn't UTF-8."""
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(errors.encodable(broken).cast("binary")).alias("digest"), errors.shortened(F.col("text"), 100).alias("short"))


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files in a folder per source, found again by a scan of files; empty files don't reach it."""
    own = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.col("text").alias("value")).withColumn("folder", F.md5(F.col("source").cast("binary")))
    path = f"{shared.new_folder(spark)}/texts"
    own.select("folder", F.coalesce("value", F.lit("")).alias("value")).write.partitionBy("folder").text(path)
    found = file_sources.read_files(spark, path, "part-*").where("size > 0")
    each = found.groupBy(F.regexp_extract("path", "folder=([0-9a-f]+)", 1).alias("folder")).agg(F.sum("size").alias("bytes"), F.sum(F.length("content")).alias("read"), F.max("ext").alias("ext"))
    return own.select("folder", "source").distinct().join(each, "folder").select("source", "bytes", "read", "ext")


def result_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as they are downloaded: text, JSON with nulls, base64 and back."""
    own = table(spark, sf_dir, "documents")
    kind = pick(["pdf", "image", "docx"], F.col("doc_id") % 3)
    text = export.download_text(kind, F.concat(F.lit("all "), F.col("source")), F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    json = export.json_of("doc_id", "lang", "n_chars", F.lit(None).cast("string").alias("error"))
    found = own.select("doc_id", text.alias("text"), export.as_base64(text.cast("binary")).alias("encoded"), json.alias("json"))
    return found.withColumn("decoded", export.from_base64(F.when(F.col("doc_id") % 4 == 0, F.lit("not base64!")).otherwise(F.col("encoded"))).cast("string"))


def registry_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that a document gets by type when it names none, and how many models its category offers."""
    types = registry.TYPES
    own = table(spark, sf_dir, "documents").select("doc_id", pick(types, F.col("doc_id") % len(types)).alias("model_type"), pick(registry.CATEGORIES, F.col("doc_id") % len(registry.CATEGORIES)).alias("category"))
    models = registry.registry(spark)
    return registry.with_offers(registry.with_defaults(own, models), models).select("doc_id", "model_type", F.col("default_model").alias("default_name"), "category", "offered")


def registry_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with what the server offers: those that documents of over 2,000 characters ask for by name."""
    models = registry.registry(spark)
    asked = registry.resolve(requests(spark, sf_dir).withColumn("long", F.length("text") > 2000), models).where("model_name is not null")
    server = asked.where("long and doc_id % 3 = 0").select(F.col("model_name").alias("name"))
    counts = asked.groupBy("model_name").agg(F.count("*").alias("requests"))
    found = registry.on_server(models, server).join(counts, F.col("name") == F.col("model_name"), "left")
    label = registry.load_label(F.col("name"), F.array(F.lit("llava:latest"), F.lit("qwen:latest")))
    return found.select("name", "available_on_server", label.alias("label"), F.coalesce("requests", F.lit(0)).alias("requests"))


def registry_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.refused(requests(spark, sf_dir), registry.registry(spark)).select("doc_id", "model", "status_code")


def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known models, which of them are in memory, and how many documents ask for each."""
    names = [m["name"] for m in registry.MODELS]
    asked = registry.resolve(requests(spark, sf_dir), registry.registry(spark)).groupBy("model_name").agg(F.count("*").alias("requests"))
    found = recognize.inventory(spark, names, names[::3]).join(asked, F.col("model") == F.col("model_name"), "left")
    return found.select("model", "is_loaded", "accelerated", F.coalesce("requests", F.lit(0)).alias("requests"))


def binarize_unclamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from -20 to 279 as they are."""
    gray = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256 + 128), F.lit(0)), F.lit(255)).cast("int"))
    found = table(spark, sf_dir, "embeddings").select("vec_id", pixels.binarize_unclamped(gray, (F.col("vec_id") % 300 - 20).cast("int")).alias("b"))
    return found.select("vec_id", F.array_join(F.transform("b", lambda x: F.when(x == 255, "1").otherwise("0")), "").alias("bits"))


def ground_truth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices of a store with their fields; some records are no JSON."""
    i = F.col("doc_id")
    item = F.struct(F.lit(1).alias("line_number"), F.col("source").alias("description"), F.lit("pcs").alias("unit"))
    record = F.to_json(F.struct(i.cast("string").alias("invoice_number"), F.col("lang").alias("invoice_date"), F.array_repeat(item, (i % 4).cast("int")).alias("items")))
    store = table(spark, sf_dir, "documents").select(pick(["invoice", "packing_list"], i % 2).alias("doc_type"), F.concat(F.lit("f"), i.cast("string")).alias("file_name"), F.when(i % 5 == 0, "broken").otherwise(record).alias("record"))
    got = F.col("record")
    return ground_truth.typed(store, "invoice").select("file_name", got["invoice_number"].alias("invoice_number"), got["invoice_date"].alias("invoice_date"), F.size(got["items"]).alias("items"), F.get(got["items"], F.lit(0))["description"].alias("first"))


QUERIES = {
    f.__name__: f
    for f in (
        confidence_heuristic, confidence_band_summary, token_confidence, token_confidence_long, confidence_combined, document_rollup, page_stream, document_text_concat, pages_with_text, line_geometry,
        cer, wer, text_similarity, nested_records, json_values, json_records, file_classify_ui, file_classify_ocr, file_classify_convert, file_size_gate, file_names, param_clamp, binarize, binarize_bytes, docx_paging,
        registry_resolve, registry_by_category, chat_request, chat_response, error_categories, session_epochs, session_stream, session_results, session_summary, ground_truth_upsert, ground_truth_stream, ground_truth_files,
        confidence_advice, metric_records, round_trip_tally, image_counts, page_timing, page_selectors, file_source_kind, file_preview, file_formats, file_scan, raw_previews, output_names, load_failures, error_texts,
        result_exports, registry_defaults, registry_server, registry_refused, model_inventory, binarize_unclamped, ground_truth_records,
    )
} | {f"line_select_{p}": _line_select(p) for p in lines.PROFILES}
