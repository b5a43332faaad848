"""The training-data pipeline: language ID, line dedup, near-dedup, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, which is written as Parquet and
read again between them. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import langid, linededup, mixing, packing, simhash
from varve.llm.common import fresh, written

#: A document whose profile is further than this from every language is rejected, as is one without a letter. Held-out
#: labelled documents of sf0.1 score 0.44 or more, sentences in languages that no label teaches and letter junk under 0.3.
LEAST_SCORE = 0.35
#: For texts of fewer words than SHORT: three words of labelled documents score as little as 0.32.
SHORT, LEAST_SHORT = 5, 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; a null or letterless text has none."""
    cols = docs.columns
    lang, score = fresh(docs, "lang_pred", "score")
    found = langid.predict(docs, langid.fit(docs.select("doc_id", "text", "lang")), lang, score)
    least = F.when(F.size(F.split(F.trim("text"), r"\s+", SHORT)) < SHORT, LEAST_SHORT).otherwise(LEAST_SCORE)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= least)).select(*cols)


def _with_length(docs: DataFrame, cols: list[str]) -> DataFrame:
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in cols))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat in windows of three; those with no text left go."""
    (counts,) = fresh(docs, "counts")
    out = linededup.line_dedup(docs, counts_col=counts).where(F.col(f"{counts}.n_removed") < F.col(f"{counts}.n_lines"))
    return _with_length(out, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Documents link as in op6_simhash_near_dedup (fingerprints by pigeonhole blocks, at most 3 differing bits) or, as
    fingerprints lose copies with a passage more, by a Jaccard similarity of 0.8 of their 5-word shingles.
    """
    return simhash.one_of_each(docs, distance=3)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: dropped, cut, whole or twice."""
    return _with_length(mixing.mixed_texts(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Not expressible in SQL: the stages hash with XXH64, walk fingerprints and tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
