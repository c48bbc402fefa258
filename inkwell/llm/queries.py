"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, language_id, license_scan, line_dedup, mixing, packing, prefix_trie, quality_net, simhash, stages, topk, toxicity, url_filter, whitening
from .common import materialise, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents for work that is heavy per row: a scan with fewer splits than cores is dealt out."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir, "doc_id", "text"), added=True)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = pages.select("page_id", line_dedup.url_host(F.col("url")).alias("host"), line_dedup.html_text(F.col("html")).alias("text"))
    texts = materialise(texts, "texts")  # the HTML is parsed once
    return line_dedup.drop_boilerplate(texts, "text", "host")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.evaluate(url_filter.page_captures(pages), url_filter.page_entries(pages))
    return found.select("page_id", F.array_join("hit_lists", ",").alias("hit_lists"), F.array_join("hit_patterns", ",").alias("hit_patterns"), "blocked")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = texts(spark, sf_dir, "doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(F.coalesce(~held_out, F.lit(True))))
    found = language_id.predict(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(texts(spark, sf_dir, "doc_id", "text"))
    places, matches = F.col("licences.places"), F.col("licences.matches")
    starts, base = F.transform(places, lambda x: x["word"]), F.transform(places, lambda x: x["label"])
    labels = F.concat(base, F.transform(matches, lambda x: x["label"]))
    return found.select(
        "doc_id",
        "licences.n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        # 1 where a notice's mandatory wording stands, a half for the bare name of a licence
        F.when(F.size(matches) > 0, 1.0).when(F.size(places) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(texts(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.is_finite(F.col("embedding")))
    vectors = vectors.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("embedding"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(fertility.measure(texts(spark, sf_dir, "doc_id", "lang", "text")).drop("text"), "measures")
    norms = fertility.fit_norms(found, "lang")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["chars_per_token", "byte_share", "entropy", "script"]
    return found.select(
        "doc_id",
        *(f"quality.{c}" for c in counts),
        fertility.base_failed().alias("base_failed"),
        fertility.kept(lang_col="lang", norms=norms).alias("kept"),
        *(f"quality.{c}" for c in more),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = texts(spark, sf_dir, "doc_id", "text")
    net = quality_net.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = quality_net.score(docs.select("doc_id", held_out.alias("held_out"), "text"), net)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= net.s.good).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_simhash": op8_simhash,
    "op9_top_k": op9_top_k,
    "op10_fertility_rules": op10_fertility_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_quality_net": op13_quality_net,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.MIX_SQL,
    "op3_line_dedup": line_dedup.pages_sql(),
    "op4_url_filter": url_filter.PAGES_SQL,
    "op9_top_k": topk.SQL,
    "op11_prefix_trie": prefix_trie.TRIE_SQL,
}
