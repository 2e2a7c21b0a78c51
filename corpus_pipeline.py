"""A corpus pipeline of five training-data operators: each stage works on all that its predecessor kept.

1. language: texts without a letter, or without a language that the model is sure of, go; others keep their columns.
2. near_dups: of each group of near-duplicate documents (5-word shingles, similarity 0.8) the smallest doc_id stays.
3. suffix_dedup: passages of over 50 words, or of 400 bytes and more, that also occur elsewhere are cut from the texts,
   every occurrence unless KEEP_FIRST is set, whole characters only. A repeat is found from PASSAGE_BYTES bytes on: 50 words of three letters.
4. decontaminate: documents that hold benchmark passages on 5 % of their words or more go.
5. sentencepiece: each text is encoded, and decoded again as a check.

Rows with a null doc_id pass all stages on their own merits; empty tables give empty tables. Stages return the columns
they are given; names that a stage needs for itself begin with `_llm_`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm import common, decontaminate, language, near_dups, pieces, suffix_dedup

PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 200, 32
#: Whether the first occurrence of a repeated passage stays in the corpus; else every one is cut, as op2's contract has it.
KEEP_FIRST = False


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language identification rejects: `und`, or a score under MIN_SCORE. Learns from labelled rows of its input."""
    model = language.fit(docs)
    out = language.identify(docs, model, keep=docs.columns, prefix="_llm_", spans=False)
    return out.where((F.col("_llm_lang_pred") != "und") & (F.col("_llm_score") >= language.MIN_SCORE)).select(*docs.columns)


def stage_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component, once; rows that repeat a kept doc_id go only if their text is the same."""
    found = near_dups.near_duplicates(docs, shingle=5)
    kept = found.where("kept AND id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    # one shuffle by doc_id: the window that finds repeated rows sorts what the join has dealt out
    before = F.lag(F.struct("text")).over(Window.partitionBy("doc_id").orderBy("text"))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("_llm_before", before)
    named = named.where(F.col("_llm_before").isNull() | ~F.col("_llm_before")["text"].eqNullSafe(F.col("text")))
    return named.select(*docs.columns).union(docs.where("doc_id IS NULL").select(*docs.columns))


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages; n_chars follows the text."""
    gone = suffix_dedup.repeated_spans(docs, span=PASSAGE_BYTES, gram=PASSAGE_GRAM, min_words=PASSAGE_WORDS, keep_first=KEEP_FIRST)
    gone = gone.select(F.col("text_key").alias("_llm_key"), F.col("kept_text").alias("_llm_kept"))
    rows = docs.withColumn("_llm_key", suffix_dedup.text_key()).join(gone, "_llm_key", "left")
    text = F.coalesce("_llm_kept", "text")
    size = F.when(F.col("_llm_kept").isNotNull(), F.char_length("_llm_kept")).otherwise(F.col("n_chars"))
    return rows.select(*((text if c == "text" else size.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    out = decontaminate.decontaminate(docs, common.documents(spark, sf_dir, "benchmark"), keep=docs.columns, prefix="_llm_")
    return out.where(~F.col("_llm_contaminated")).select(*docs.columns)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, exact of every document that is left."""
    import public_tokenizers

    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


STAGES = [("language", stage_language), ("near_dups", stage_near_dups), ("suffix_dedup", stage_suffix_dedup), ("decontaminate", stage_decontaminate), ("sentencepiece", stage_sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Several stages cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
