"""Language identification by rank-order profiles of n-grams.

A profile is the PROFILE most frequent 1- to 3-grams of the words (runs of letters, lower-cased, with a mark
before and after). A document's profile is taken over its whole text. Its distance to a language is the sum,
over its n-grams, of how far each is out of place: the difference of ranks, or PROFILE if the language lacks
it. The nearest language wins; ties go to the smaller name. The score is 1 - distance / greatest distance.

Language profiles are fitted on `fit_documents` different labelled documents of each language, those with the smallest
hash: the same ones in every run. Equal rows count once. Only hashes are sorted to find them, and few of those. The
`languages` labels with the most rows are learned. Their n-gram counts are summed by Spark; only the profiles, PROFILE rows a
language, come to the driver and go out to the tasks.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled text every
document is; a null label is not learned from; repeated rows all get their result; an empty table gives an
empty result. Very long texts are counted in full, each by itself in a task's memory; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table

PROFILE = 300
#: What the profiles are fitted on: documents a language, and languages. These bound what is sorted, broadcast and collected.
FIT_DOCUMENTS, LANGUAGES = 2000, 1024
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
MARK, CODE_BITS = "_", 21


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, ascending, with their counts: as code points in CODE_BITS bits each.

    They are taken of the different words, one after another with a mark before and after each, by how often each is there.
    """
    words = Counter(WORD.findall((text or "").lower()))
    for w in [w for w in words if not w.isalpha()]:  # with signs such as a half or a raised two, which are no letters
        n = words.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            words[part] += n
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer((MARK + MARK.join(words) + MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
    inner = c != ord(MARK)
    n = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.diff(np.flatnonzero(~inner)))
    two = (c[:-1] << CODE_BITS) | c[1:]
    middle = inner[1:-1]  # a third with a mark in the middle would run over two words
    three = ((two[:-1] << CODE_BITS) | c[2:])[middle]
    own = inner[:-1]
    codes = np.concatenate((c[:-1][own], two, three))
    weights = np.concatenate((n[own], n, n[:-1][middle]))
    order = np.argsort(codes)
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(weights, first)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, the first first; ties to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def drawn(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS, languages: int = LANGUAGES) -> DataFrame:
    """(lang, text) of the documents that profiles are fitted on."""
    labelled = documents.where("lang is not null and text is not null").withColumn("draw", F.xxhash64("doc_id", "text"))
    # hashes are even, so four times the wanted part of the different ones holds enough; only those are put in order
    sizes = labelled.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("rows"), F.approx_count_distinct("draw").alias("n"))
    sizes = F.broadcast(sizes.orderBy(F.desc("rows"), "of").limit(languages))  # as many rows at most
    slim = labelled.select("lang", "draw").join(sizes, F.col("lang") == F.col("of")).where(F.col("draw") / 2.0**64 + 0.5 <= 4 * fit_documents / F.col("n"))
    first = Window.partitionBy("lang").orderBy("draw")
    upto = slim.select("lang", "draw").distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= fit_documents)
    upto = F.broadcast(upto.groupBy(F.col("lang").alias("of")).agg(F.max("draw").alias("upto")))  # a row a language
    chosen = labelled.join(upto, (F.col("lang") == F.col("of")) & (F.col("draw") <= F.col("upto")))
    # equal rows are one: their partial aggregates are
    return chosen.groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")


def fit(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS, languages: int = LANGUAGES) -> dict[str, np.ndarray]:
    """Language profiles of labelled documents (doc_id, text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = gram_counts(text)
                if lang in total:
                    codes, at = np.unique(np.concatenate((total[lang][0], found[0])), return_inverse=True)
                    found = codes, np.bincount(at, np.concatenate((total[lang][1], found[1])), len(codes)).astype(np.int64)
                total[lang] = found
            for lang, (codes, counts) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    small_batches(documents.sparkSession)
    counts = drawn(documents, fit_documents, languages).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("at") <= PROFILE)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "at", "gram").collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], []).append((r["at"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(rows)], np.int64) for lang, rows in sorted(profiles.items())}


class Classifier:
    """Out-of-place distances to all language profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]) -> None:
        self.langs = list(profiles)
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for row, p in zip(self.rank, profiles.values(), strict=True):
            row[np.searchsorted(self.codes, p)] = np.arange(len(p))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranked(*gram_counts(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        ranks = self.rank[:, at]
        far = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), PROFILE).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], 1 - float(far[best]) / (PROFILE * len(own))


def predict(documents: DataFrame, profiles: dict[str, np.ndarray], lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """documents with the predicted language and its score, of the text alone; columns of their names are replaced."""
    kept = [c for c in documents.columns if c not in (lang_col, score_col)]
    schema = documents.select(*kept).schema.add(lang_col, "string").add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(profiles)
        for b in batches:
            found = [classify(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*b.schema.names, lang_col, score_col])

    small_batches(documents.sparkSession)
    return documents.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = fit(documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = predict(documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")
