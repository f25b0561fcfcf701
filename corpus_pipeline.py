"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of documents. run() writes each stage's rows to the shared folder and
reads them again for the next.

Not every stage can be said in SQL (learned classifiers, sentencepiece), so ORACLE_SQL is None; the
tests hold the rows against a brute-force version. An empty table stays empty through all stages, and
further columns go through them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, line_dedup, ngram_jaccard, pieces
from tidemark.llm.catalog import tokenizer_path
from tidemark.llm.names import keeping
from tidemark.runtime import settle, table

ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; undetermined and ambiguous ones go. Null texts and texts
    without a letter are undetermined."""
    return language.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines but for their first place; documents left without any line go.
    Null and empty texts and rows without a doc_id lose nothing and stay."""

    def kept(rows: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(rows).filter("n_removed = 0 or n_left > 0")
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))

    return keeping(docs, ("n_lines", "n_removed", "n_left"), kept)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id. Shingles of
    five words, similarity of 0.8 or more.

    Of rows equal in every column one stays. Rows of one doc_id with different texts stay or go as
    their texts do, or all of them stay if one does. Rows without a doc_id can't be told apart: all
    stay, unless each of them has a near duplicate with a doc_id. Texts without words have none."""
    groups = ngram_jaccard.near_duplicate_components(docs, n=5, num=80, den=100)
    firsts = F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("n")
    counts = groups.groupBy(F.col("doc_id").alias("of_id")).agg(firsts).filter("n <> 1")
    # Ids that go, and ids of several rows that stay: both are few, so the texts needn't move for them.
    counts = settle(counts, "not-first-of-group")
    same = docs["doc_id"].cast("long").eqNullSafe(counts["of_id"])
    once = docs.join(counts, same, "left_anti")
    again = counts.filter("n > 1")
    return once if again.isEmpty() else once.unionByName(docs.join(again, same, "left_semi").dropDuplicates())


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts hold none; repeated rows stay or
    go together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the text that they decode to; a null text is the empty one."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language identification", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
