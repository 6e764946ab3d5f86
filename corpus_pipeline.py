"""A training corpus from raw documents: language, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents. A stage's own scratch tables are deleted when the next stage starts, as by then its result is written. Every stage
starts with heaps trimmed to what lives, as its Python workers share an executor's memory with what earlier stages left.

The stages handle the cases their operators define: null and empty texts have no language and go with the first stage; very long
texts are read whole by all stages; of rows that repeat id and text one stays, and rows of one id with other texts are judged by
their own texts; ties of classes go to the smaller id, a null id being larger than all others; an empty table gives empty
results; columns beside those of documents are dropped at the start of a stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import scratch
from gleaner.llm.containment import near_duplicates
from gleaner.llm.decontamination import decontaminate
from gleaner.llm.language_id import identify
from gleaner.llm.packing import concat_and_cut
from gleaner.llm.pii import replace_pii
from gleaner.llm.registry import PII_KEY, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language prediction below this score is as good as none.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told; the others get the language they are written in."""
    scratch.trim_heaps(spark)
    docs = docs.select(*COLUMNS)
    train = docs.select("text", "lang").filter("lang IS NOT NULL")
    told = identify(docs, train, keep=COLUMNS)
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each class that has the most distinct shingles, and one row of those that repeat its id and text."""
    scratch.release(spark)
    docs = docs.select(*COLUMNS)
    judged = near_duplicates(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    judged = scratch.written(judged.agg(F.sum(F.col("kept").cast("long")).alias("kept"), F.count("*").alias("n")).filter("kept < n"))
    here = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.xxhash64("text") == F.col("_key"))
    left = docs.join(judged.filter("kept = 0"), here, "left_anti")
    again = judged.filter("kept > 0")
    if again.isEmpty():
        return left
    rows = left.join(again, here, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
    return left.join(again, here, "left_anti").unionAll(rows.select("doc_id", "text", "r.lang", "r.source", "r.n_chars"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    scratch.release(spark)
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; n_chars follows the new text."""
    scratch.release(spark)
    done = replace_pii(docs.select(*COLUMNS), PII_KEY)
    changed = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.select("doc_id", "text", "lang", "source", changed.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of fixed windows."""
    scratch.release(spark)
    pieces = concat_and_cut(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", clean_of_benchmark),
    ("pii", surrogates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    scratch.release(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # no stage but the last has an SQL form
