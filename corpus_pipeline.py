"""Corpus pipeline: language ID, near-duplicate removal, mixing to target weights, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is
written as Parquet and read again before the next stage starts. Documents have the columns doc_id,
text, lang, source, n_chars; other columns of the input are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, language_id, mixing, ngram_join
from textloom.llm.common import Workspace, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is this uncertain are rejected, as are those without any.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: no letters, or two languages about as likely."""
    model = language_id.fit(docs)
    said = language_id.identify(docs, model, keep=COLUMNS[1:])
    return said.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the one of least key (no key counts as the greatest), then of least text.

    Classes are of texts, not of keys: different texts that share a key, or have none, all stay.
    Without words a document has no class and stays, as often as it is there.
    """
    return ngram_join.representatives(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix says: dropped, once or twice (a repeat is a row of its own)."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars")).filter("passes > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "passes")).alias("_pass")).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with the digests of ids and of the bytes they decode to."""
    coded = bpe.round_trip(docs, bpe.vocabulary_path())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_stage), ("ngram_near_duplicates", near_duplicate_stage), ("source_mixing", mixing_stage), ("bpe_encoding", encode_stage)]

#: SQL expresses neither the language model nor byte-level BPE; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
