"""A corpus pipeline of five stages over the documents table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the next stage's documents, the last one the packed pieces.  What a
stage keeps it passes on with every column.

* toxicity: documents scored at or above the threshold go.
* simhash_dedup: one document of each near-duplicate group stays, the one with
  the smallest id.
* decontaminate: documents that hold a benchmark item go.
* secrets: secrets in the texts are masked; ``n_chars`` follows the text.
* packing: the documents become sequences of token ids.

Defined results: a null or empty text is scored, kept, masked to itself and packed
as its end token; rows without an id cannot be named, so near-dedup and
decontamination keep them; rows that share an id are judged each by its own text,
and of rows equal in id and text one stays, the same on every run; an empty table
gives an empty result; texts are worked on whole, whatever their length; further
columns pass through every stage but the last, and none of their names can clash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, packing, queries, secret_scan, simhash_dedup, toxicity
from ledgerlens.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(spark, model) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs, shingle=3, distance=2)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a secret keep their text and ``n_chars`` as they are."""
    masked = secret_scan.masked_column(spark, queries.secret_model(docs))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), masked.alias("masked"))  # no name can clash
    own = {c: F.col("row")[c] for c in docs.columns}
    changed = ~F.col("masked").eqNullSafe(own["text"])
    new = {"text": F.col("masked")}
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("masked").cast(kind)).otherwise(own["n_chars"])
    return rows.select(*[(own | new)[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: SQL has no form for the models, fingerprints and tokenizer of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
