"""One query per operator over its whole table, and what DuckDB can say of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import (
    bpe,
    decontaminate,
    embeddings,
    fim,
    langid,
    licenses,
    lines,
    merkle,
    repeats,
    secrets,
    simhash,
    token_windows,
    toxicity,
)
from offerlake.llm.common import table
from offerlake.llm.oracle import ORACLE as ORACLE


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.array_distinct("phrases.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").alias("first_word"),
        F.array_max("phrases.start").alias("last_word"),
        F.concat_ws(",", F.array_sort(base)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, F.col("spans.label")))).alias("labels"),
        F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("score"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.concat_ws(
            ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        )

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        removed("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every text as ids and back: their number and digests."""
    file = bpe.tokenizer_file(tokenizer)
    lexicon = bpe.build_lexicon(bpe.frequent_words(docs, file), file)
    coded = bpe.round_trip(docs, file, lexicon)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def removed(spans: str) -> Column:
    """Total length of an array of spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        removed("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_windows.without_seen(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        removed("spans").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.DECISION).cast("int").alias("predicted"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    spoiled = merkle.digest([*map(F.col, columns), F.replace("text", F.lit("\n"), F.lit(""))])
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(
        docs, [*columns, "text"], "source", "doc_id", {"tampered": F.when(even, spoiled)}
    )
    now = F.coalesce("item.tampered", "leaf")
    return found.withColumn("folded_root", merkle.root_of(now)).select(
        F.col("item.key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.concat("way", "group_way"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.restore(fim.transform(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select(
        "doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe": op5_bpe,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_repeated_words": op7_repeated_words,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language": op13_language,
}
