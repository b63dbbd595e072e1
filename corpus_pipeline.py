"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, byte-level BPE.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns what the next one gets as
docs.  ``run`` applies them to ``documents``, every result written to the shared folder and read again.

In every stage a null text reads as empty, a text of any length is worked on whole, rows that repeat a
doc_id are all kept or all dropped, an empty table gives an empty result, and further columns of any
name pass unchanged up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, decontaminate, lines, minhash, toxicity
from trackloom.llm.shared import Scratch, work_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go.

    A probability equal to the threshold is a rejection.  Null and empty texts are judged by the
    intercepts; rows with a null doc_id are judged like others.  Without labels all stay.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages go but for their first occurrence; every document stays.

    First is the smallest doc_id, then the smallest line.  A null text stays null, a text may become
    empty, rows with a null doc_id pass unchanged.  ``n_chars``, where it exists, follows the text.
    """
    own = [c for c in ("n_lines", "n_removed") if c in docs.columns]
    held = docs.withColumnsRenamed({c: f"own {c}" for c in own})
    out = lines.line_dedup(held, passages=True).drop("n_lines", "n_removed").withColumnsRenamed({f"own {c}": c for c in own})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more.

    That of the smallest doc_id.  Texts without words are nobody's duplicates; rows with a null doc_id stay.
    """
    found = minhash.near_duplicates(docs, words=5, percent=80)
    return docs.join(found.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, perhaps with other names and numbers, go.

    Shares equal to a bound count as found.  Null and empty items are never found; rows with a null
    doc_id stay.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to: a row per row, null texts without ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).drop("text")
    count = F.size("token_ids").cast("long").alias("n_tokens")
    return bpe.decode(ids, path).select("doc_id", "lang", "source", count, "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", tokenise),
]

#: No SQL: trained models, sketches and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's own work tables go once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with work_folder(spark):
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
