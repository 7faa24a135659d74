"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns a DataFrame; all but the last return the columns of documents, and other columns are dropped.

Defined results, in every stage: an empty table gives no rows; repeated rows share a fate, but for
near-duplicates, where rows of equal ids stay or go together; very long texts are taken whole; a null in a column that a stage
does not read is kept.  What each does with nulls and ties stands with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import langid, line_dedup, minhash, packing, tiling
from tessera.llm.storage import kept

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document whose language scores less is not text of any learned language.
LEAST_SCORE = 0.3


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a learned language; those without letters or of no clear language go.

    A null or empty text has no letters and goes; a null id or language is no matter; equal scores go to the language that
    sorts first.
    """
    found = langid.classify(docs, langid.train(docs), keep=[c for c in COLUMNS if c not in ("doc_id", "text")])
    return _documents(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def without_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines; documents stay, and n_chars follows the text.

    A null text stays null; null sources are one site; rows without an id keep their lines; the smallest id keeps a line, with all its rows.
    """
    cleaned = line_dedup.dedup_lines(docs)
    return _documents(cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id.

    Null and empty texts are in no group and stay; rows without an id stay.
    """
    return _documents(minhash.keep_one(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover a benchmark item.

    Null and empty texts stay; rows without an id are decided by their text; without a benchmark all stay.
    """
    return _documents(tiling.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all remaining documents in sequences.

    A null text is packed as an empty one; ties of length go by id and piece.
    """
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_spread_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Language scores, near-duplicates, tiles and packing are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
