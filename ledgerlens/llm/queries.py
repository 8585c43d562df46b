"""One registered query per operator, over its whole table; digest columns are derived here."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    ann,
    bpe,
    conversation_repair,
    decontaminate,
    language_id,
    merkle,
    oracles,
    packing,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)
from ledgerlens.llm.common import fold

LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_words(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secrets(docs, secret_model(docs))


def secret_model(docs: DataFrame) -> secret_scan.Forest:
    """A forest trained on rule-labelled findings of documents outside fold 2 of 4."""
    learned = docs.where(fold("doc_id", 4) != 2)
    return secret_scan.fit(secret_scan.rule_labels(learned), secret_scan.dictionary(docs))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held))
    return (language_id.identify(docs, model)
            .select("doc_id", held.alias("held_out"), "lang_pred", "score"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return (ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Trained on the labelled rows outside fold 1 of 3."""
    return toxicity.fit(toxicity.labelled_texts(docs, labels.where(fold("doc_id", 3) != 1)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=LIMIT,
                                  end=2).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The conversations with planted faults, and how often each row counts (0: dropped, 2: repeated)."""
    def or_blank(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(or_blank("text"), "[.!?]", "")).otherwise(or_blank("text")))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    found = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(or_blank("role")).alias("role"), text.alias("text"),
                        copies.alias("copies"))
    return found, F.col("copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.counted(*damaged(table(spark, sf_dir, "conversations")))
    return conversation_repair.digests(rows, conversation_repair.report(rows))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id's crc32, a row is shown with one more in ``n_chars``."""
    docs = table(spark, sf_dir, "documents")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    shown = merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(docs, presented=F.when(tampered, shown))
    return (rows.withColumn("folded_root", merkle.folded(F.col("presented"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "position"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_ann": op7_ann,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_bpe_codec": op13_bpe_codec,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op9_warc": oracles.OP9,
    "op11_conversation_repair": oracles.OP11,
    "op12_merkle_manifest": oracles.OP12,
}
