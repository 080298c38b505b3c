"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

A text's letters and blanks (digits and ASCII marks become one blank, A-Z are lower-cased) give byte n-grams of two
lengths, hashed to ``DIMENSIONS`` places; its vector is (1 + ln count) * idf, normalised.  Document frequencies are
counted over all rows to learn from.  For each language the vectors of a bounded sample (at most
``SAMPLE_PER_LANGUAGE`` distinct texts, those with the smallest hashes) are clustered by spherical k-means into
``CENTROIDS_PER_LANGUAGE`` centroids.  The prediction is the language of the centroid with the largest cosine.
Distance-based rejection: each centroid keeps the cosine that all but ``REJECT_SHARE`` of its own sample
reach, and a text further from its centroid is marked ``rejected``.

Memory: texts are counted in groups of ``GROUP`` rows; the model is a matrix of languages * centroids by
``DIMENSIONS`` 4-byte numbers (64 KB a language) that goes to the tasks with the function.

Defined results: NULL text, and text without a letter, gives lang_pred ``und``, score 0 and rejected.  Equal cosines go
to the language that comes first by name.  Rows with NULL lang aren't learned from.  With nothing to learn from, all
texts get ``und``.  Repeated rows give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import fold, free_names, materialize, ship_package, table
from equipoise.llm.words import text_bytes
from equipoise.session import join_small

DIMENSIONS, LENGTHS, GROUP = 4096, (2, 4), 512
SAMPLE_PER_LANGUAGE, CENTROIDS_PER_LANGUAGE, REJECT_SHARE = 400, 4, 0.005
UNKNOWN = "und"

_FOLDED = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8).copy()
_FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, one row a text; n-grams don't cross texts or runs of blanks."""
    raw, bounds = text_bytes(texts)
    n = len(bounds) - 1
    counts = np.zeros(n * DIMENSIONS, np.float32)
    # groups of rows bound the memory; a text is taken whole, in stretches
    for row in range(n):
        for lo in range(bounds[row], bounds[row + 1], 1 << 20):
            part = _FOLDED[raw[lo:min(lo + (1 << 20) + max(LENGTHS) - 1, bounds[row + 1])]]
            blank = part == 0x20
            part = part[~(blank & np.append(False, blank[:-1]))].astype(np.uint32)
            own = counts[row * DIMENSIONS:(row + 1) * DIMENSIONS]
            for size in LENGTHS:
                if len(part) < size:
                    continue
                code = np.full(len(part) - size + 1, size, np.uint32)
                for i in range(size):
                    code = code * np.uint32(0x01000193) + part[i:len(part) - size + 1 + i]
                code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                own += np.bincount(code >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return counts.reshape(n, DIMENSIONS)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of ``texts`` (one column) and how many of them have each place; one vector a task is added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = batch.column(0).slice(start, GROUP)
                seen += (ngram_counts(part) > 0).sum(axis=0)
                rows += len(part)
        yield pa.record_batch({"place": np.arange(DIMENSIONS + 1, dtype=np.int32), "n": np.append(seen, rows)})

    totals = texts.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    out[totals["place"]] = totals["n"]
    return int(out[-1]), out[:-1]


def cluster(vectors: np.ndarray, k: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids, started far from each other."""
    rng = np.random.default_rng(seed)
    centroids = vectors[[rng.integers(len(vectors))]]
    while len(centroids) < min(k, len(vectors)):
        nearest = (vectors @ centroids.T).max(axis=1)
        centroids = np.vstack([centroids, vectors[nearest.argmin()]])
    for _ in range(rounds):
        owner = (vectors @ centroids.T).argmax(axis=1)
        sums = np.vstack([vectors[owner == i].sum(axis=0) if (owner == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def sample_of(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): of each language the distinct texts with the ``per_language`` smallest hashes, each once.

    So no language is left out, and none has more, whatever copies there are.  Hashes are thinned to about twice the number
    before a language's are ordered.
    """
    keyed = rows.withColumn("h", F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 62)))
    distinct = materialize(keyed.select("lang", "h").distinct(), "sample-hashes")
    sizes = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # some more than twice, so that fewer than the wanted are left but once in 10**30
    bound = F.lit(float(1 << 62)) * (2 * per_language + 100) / F.col("n")
    few = join_small(distinct, sizes, "lang").filter(F.col("h") < bound)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = materialize(few.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "h"), "sample-chosen")
    # a task sends one text of a group of copies
    return join_small(keyed, chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def learn(rows: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """The model from labelled ``rows`` (text, lang)."""
    ship_package(rows.sparkSession)
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    n, df = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sample = sample_of(rows, per_language)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = unit_vectors(ngram_counts(batch.column(1).slice(start, GROUP)), idf).astype(np.float32)
                yield pa.record_batch({"lang": batch.column(0).slice(start, GROUP), "v": pa.array([v.tobytes() for v in part], pa.binary())})

    found = sample.mapInArrow(vectors, "lang string, v binary").toPandas()
    names, centroids, floors = [], [], []
    for lang, part in sorted(found.groupby("lang")["v"], key=lambda x: x[0]):
        own = np.frombuffer(b"".join(sorted(part)), np.float32).reshape(-1, DIMENSIONS)
        middle = cluster(own, CENTROIDS_PER_LANGUAGE)
        cosine = own @ middle.T
        nearest = cosine.argmax(axis=1)
        for i in range(len(middle)):
            mine = cosine[nearest == i, i]
            names.append(lang)
            floors.append(float(np.quantile(mine, REJECT_SHARE)) if len(mine) else 1.0)
        centroids.append(middle)
    return {"idf": idf, "names": names, "floors": np.array(floors),
            "centroids": np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32)}


def predict(docs: DataFrame, model: dict, *keep: str | Column) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred, score (the cosine) and rejected; only ``text`` is looked at."""

    ship_package(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = np.array([*model["names"], UNKNOWN], dtype=object)
        for texts in batches:
            for start in range(0, len(texts), GROUP):
                counts = ngram_counts(pa.array(texts.iloc[start:start + GROUP], pa.string()))
                if not len(model["names"]):
                    yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(counts), "score": 0.0, "rejected": True})
                    continue
                cosine = unit_vectors(counts, model["idf"]) @ model["centroids"].T
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
                yield pd.DataFrame({"lang_pred": names[best], "score": top, "rejected": top < model["floors"][best]})

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    own = docs.select(*keep).columns
    has, p = free_names(own, "letters", "predicted")
    return docs.select(*keep, letters.alias(has), nearest(F.coalesce("text", F.lit(""))).alias(p)).select(
        *own, F.when(F.col(has), F.col(f"{p}.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col(has), F.col(f"{p}.score")).otherwise(0.0).alias("score"),
        F.when(F.col(has), F.col(f"{p}.rejected")).otherwise(True).alias("rejected"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from those whose id's fold of 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~held_out).select("text", "lang"))
    return predict(docs, model, "doc_id", held_out.alias("held_out"))
