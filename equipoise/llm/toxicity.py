"""Toxicity by a convolutional text classifier, trained in numpy.

A text's words (runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased) are embedded by three hashed
tables: two by different hashes of the word, so that two words rarely share both places, and one by its first
bytes.  Filters of several widths slide over the whole text, max pooling takes the strongest response of
each, and a logistic layer weighs them.  Only the places that win a pooling get a gradient, so an Adagrad step
touches a few rows of the tables.

Training reads all labelled rows, equal texts of a class once, in tasks whose models are averaged after each pass; about every
fifth row, by a hash of the text, is kept for calibration.  Thresholds are calibrated by language: the language is
guessed from the text alone (word frequencies by language of all labelled rows, hashed), and a text's score is
shifted so that its language's threshold becomes 0.5.

Scoring is per row; the responses of each embedding row to each filter position are tabulated once a worker, so that
a word costs a few look-ups.  Memory: the model (about 5 MB, tables about 30 MB) and ``GROUP_WORDS`` words.

Defined results: NULL and empty texts, and texts without a word, have no response and get the score of a text whose
filters are all silent.  Rows without a label aren't learned from.  With no labelled rows of both classes every score is
0.  Repeated rows give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import fold, free_name, materialize, release, ship_package, table
from equipoise.llm.words import words_of
from equipoise.session import join_small

PLACES, DEPTH, TABLES = 1 << 15, 6, 3
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH, RATE = 10, 32, 0.15
#: Rows and words that a task trains on at a time; numbers of a block; width of a step of logits in calibration.
PASS_ROWS, PASS_WORDS, BLOCK, STEP = 3000, 1_000_000, 1 << 16, 0.005
HEAD, LANGUAGE_PLACES, GROUP_WORDS = 5, 2048, 50_000

#: All ASCII bytes but letters and digits part words.
_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words x TABLES) places and the n + 1 bounds of each text."""
    w = words_of(texts, _BREAKS, HEAD)
    places = np.empty((len(w.hashes), TABLES), np.int32)
    places[:, 0] = w.hashes & np.uint64(PLACES - 1)
    places[:, 1] = (w.hashes >> np.uint64(32)) & np.uint64(PLACES - 1)
    places[:, 2] = w.heads & np.uint64(PLACES - 1)
    return places, w.bounds


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled texts, equal ones of a class once: toxic, text, lang, held (kept for calibration).

    Rows are ordered by a hash within the files, so that training doesn't depend on the order in which a shuffle met them.
    """
    classes = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = join_small(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"), classes, "doc_id")
    once = rows.groupBy("toxic", "text").agg(F.min("lang").alias("lang"))
    key = F.xxhash64(F.lit("row"), "text", "toxic")
    held = F.pmod(F.xxhash64(F.lit("held"), "text", "toxic"), F.lit(5)) == 4
    return materialize(once.withColumn("held", held).sortWithinPartitions(key), "toxicity-rows")


def hashed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Short slices of the batches with the places and bounds of the words of their ``text``."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            yield part, *hashed_words(part.column("text"))


def responses(tables: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, places: np.ndarray, bounds: np.ndarray):
    """Pooled responses (texts x all filters) and the word at which each window that wins begins.

    Windows that reach beyond the text see nothing there; a text without words pools to 0 everywhere.
    """
    x = np.concatenate([tables[t][places[:, t]] for t in range(TABLES)], axis=1)
    n, texts = len(x), len(bounds) - 1
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # words from here to the text's end
    pooled = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
    winner = np.full(pooled.shape, -1, np.int64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    for j, w in enumerate(WIDTHS):
        z = np.tile(bias[j], (n, 1))
        for k in range(w):
            part = x @ filters[j][k]
            part[left <= 0] = 0
            z[:n - k] += np.where((left > k)[:n - k, None], part[k:], 0)
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        if len(full):
            best = np.maximum.reduceat(z, bounds[full], axis=0)
            pooled[full, cols] = best
            hit = z == np.repeat(best, np.diff(bounds)[full], axis=0)
            first = np.where(hit, np.arange(n)[:, None], n)
            winner[full, cols] = np.minimum.reduceat(first, bounds[full], axis=0)
    return np.maximum(pooled, 0), np.where(pooled > 0, winner, -1), x


def fresh(rng: np.random.Generator) -> dict:
    """An untrained classifier; ``seen``: Adagrad's sums of squares."""
    size = DEPTH * TABLES
    tables = rng.normal(0, 0.05, (TABLES, PLACES, DEPTH)).astype(np.float32)
    filters = [rng.normal(0, 0.5, (w, size, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
    out = rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    return {"tables": tables, "filters": filters, "bias": bias, "out": out, "shift": -1.0,
            "seen": {"tables": np.full_like(tables, 1e-3), "filters": [np.full_like(f, 1e-2) for f in filters],
                     "bias": np.full_like(bias, 1e-2), "out": np.full_like(out, 1e-2), "shift": 1e-2}}


def flat(model: dict) -> np.ndarray:
    """All numbers of a classifier in training, one after the other."""
    return np.concatenate([np.concatenate([part["tables"].ravel(), *[f.ravel() for f in part["filters"]], part["bias"].ravel(), part["out"],
                                           [part["shift"]]]).astype(np.float32) for part in (model, model["seen"])])


def unflat(numbers: np.ndarray) -> dict:
    """The classifier of ``flat``."""
    halves = []
    for half in np.split(numbers.astype(np.float32), 2):
        shapes = [(TABLES, PLACES, DEPTH), *[(w, DEPTH * TABLES, FILTERS) for w in WIDTHS], (len(WIDTHS), FILTERS), (len(WIDTHS) * FILTERS,)]
        cuts = np.cumsum([math.prod(s) for s in shapes])
        tables, *filters, bias, out = [part.reshape(s).copy() for part, s in zip(np.split(half, cuts), shapes)]
        halves.append({"tables": tables, "filters": filters, "bias": bias, "out": out, "shift": float(half[-1])})
    return halves[0] | {"seen": halves[1]}


def train(words: list[np.ndarray], toxic: np.ndarray, seed: int = 3) -> dict:
    """The classifier after ``EPOCHS`` passes over rows in memory."""
    rng = np.random.default_rng(seed)
    model = fresh(rng)
    for _ in range(EPOCHS):
        one_pass(model, words, toxic, rng)
    return {k: v for k, v in model.items() if k != "seen"}


def one_pass(model: dict, words: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad steps over the rows in a random order; ``model`` is changed in place."""
    tables, filters, bias, out, shift, seen = (model[k] for k in ("tables", "filters", "bias", "out", "shift", "seen"))
    order = rng.permutation(len(words))
    for start in range(0, len(order), BATCH):
        rows = order[start:start + BATCH]
        bounds = np.concatenate([[0], np.cumsum([len(words[r]) for r in rows])])
        places = np.concatenate([words[r] for r in rows])
        pooled, winner, x = responses(tables, filters, bias, places, bounds)
        p = 1 / (1 + np.exp(-(pooled @ out + shift)))
        err = ((p - toxic[rows]) / len(rows)).astype(np.float32)
        g_out, g_shift = pooled.T @ err, float(err.sum())
        text, col = np.nonzero(winner >= 0)
        g = err[text] * out[col]
        ends = bounds[1:][text]
        hit_places, hit_grads = [], []
        for j, w in enumerate(WIDTHS):
            mine = col // FILTERS == j
            at, f, gj, end = winner[text[mine], col[mine]], col[mine] % FILTERS, g[mine], ends[mine]
            g_bias = np.bincount(f, gj, FILTERS).astype(np.float32)
            seen["bias"][j] += g_bias ** 2
            bias[j] -= RATE * g_bias / np.sqrt(seen["bias"][j])
            for k in range(w):
                inside = at + k < end
                xs = x[at[inside] + k]
                g_filter = np.zeros_like(filters[j][k])
                np.add.at(g_filter.T, f[inside], xs * gj[inside, None])
                hit_places.append(places[at[inside] + k])
                hit_grads.append(filters[j][k].T[f[inside]] * gj[inside, None])
                seen["filters"][j][k] += g_filter ** 2
                filters[j][k] -= RATE * g_filter / np.sqrt(seen["filters"][j][k])
        if hit_places:
            where, grads = np.concatenate(hit_places), np.concatenate(hit_grads)
            for t in range(TABLES):
                rows_t, inverse = np.unique(where[:, t], return_inverse=True)
                g_table = np.zeros((len(rows_t), DEPTH), np.float32)
                np.add.at(g_table, inverse, grads[:, t * DEPTH:(t + 1) * DEPTH])
                seen["tables"][t][rows_t] += g_table ** 2
                tables[t][rows_t] -= RATE * g_table / np.sqrt(seen["tables"][t][rows_t])
        seen["out"] += g_out ** 2
        out -= RATE * g_out / np.sqrt(seen["out"])
        seen["shift"] += g_shift ** 2
        shift -= RATE * g_shift / np.sqrt(seen["shift"])
    model["shift"] = shift


def train_on_all(rows: DataFrame, seed: int = 3) -> dict:
    """The classifier after ``EPOCHS`` passes over all ``rows`` (toxic, text).

    In a pass each task goes on from the same numbers with the rows that it reads, some at a time; a number becomes the mean,
    by rows, of what the tasks that moved it made of it.  What is shuffled and reaches the driver are blocks of the numbers.
    """
    numbers = flat(fresh(np.random.default_rng(seed)))
    for epoch in range(EPOCHS):
        def go(batches: Iterator[pa.RecordBatch], begin=numbers, epoch=epoch) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            model, rng = unflat(begin), np.random.default_rng([seed, epoch, task])
            words, toxic, size, done = [], [], 0, 0
            for part, places, bounds in hashed_parts(batches):
                words += [places[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                toxic += part.column("toxic").to_pylist()
                size += len(places)
                if size >= PASS_WORDS or len(words) >= PASS_ROWS:
                    one_pass(model, words, np.array(toxic, np.float32), rng)
                    words, toxic, size, done = [], [], 0, done + len(words)
            if words:
                one_pass(model, words, np.array(toxic, np.float32), rng)
                done += len(words)
            if done:
                moved = flat(model) - begin
                for at in range(0, len(moved), BLOCK):
                    yield pa.record_batch({"block": pa.array([at // BLOCK], pa.int32()), "task": pa.array([task], pa.int32()),
                                           "rows": pa.array([done], pa.int64()), "moved": pa.array([moved[at:at + BLOCK].tobytes()], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, n, part in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "moved"))):
                    part = np.frombuffer(part, np.float32).astype(np.float64)
                    sums[block] = sums.get(block, 0) + n * np.stack([part, part != 0])
            for block, (total, n) in sums.items():
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "moved": pa.array(
                    [(total / np.maximum(n, 1)).astype(np.float32).tobytes()], pa.binary())})

        sent = rows.select("toxic", "text").mapInArrow(go, "block int, task int, rows long, moved binary")
        met = sent.repartition("block").sortWithinPartitions("block", "task").mapInArrow(add, "block int, moved binary").collect()
        numbers = numbers.copy()
        for r in met:
            part = np.frombuffer(r["moved"], np.float32)
            numbers[r["block"] * BLOCK:r["block"] * BLOCK + len(part)] += part
    return {k: v for k, v in unflat(numbers).items() if k != "seen"}


def tabulated(model: dict) -> list[list[np.ndarray]]:
    """For each width and position, (tables x places x filters): what a word adds to a window's response."""
    return [[np.stack([model["tables"][t] @ f[t * DEPTH:(t + 1) * DEPTH] for t in range(TABLES)]) for f in model["filters"][j]]
            for j in range(len(WIDTHS))]


def logits(model: dict, tabs: list, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The classifier's logit of each text."""
    n, sizes = len(places), np.diff(bounds)
    full = np.flatnonzero(sizes > 0)
    total = np.full(len(sizes), model["shift"])
    if not len(full):
        return total
    left = np.repeat(bounds[1:], sizes) - np.arange(n)
    for j, w in enumerate(WIDTHS):
        z = np.zeros((n, FILTERS), np.float32)
        for k in range(w):
            part = sum(tabs[j][k][t][places[k:, t]] for t in range(TABLES))
            if k:
                part[left[:n - k] <= k] = 0
            z[:n - k] += part
        best = np.maximum(np.maximum.reduceat(z, bounds[full], axis=0) + model["bias"][j], 0)
        total[full] += best @ model["out"][j * FILTERS:(j + 1) * FILTERS]
    return total


def language_of(model: dict, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Index of each text's most likely language by its words; the first for texts without words."""
    sizes = np.diff(bounds)
    out = np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes > 0)
    if len(full) and len(model["languages"]) > 1:
        likely = np.add.reduceat(model["word_logs"][places[:, 0] % LANGUAGE_PLACES], bounds[full], axis=0)
        out[full] = likely.argmax(axis=1)
    return out


def best_threshold(scores: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The middle of the widest gap among the cuts with the fewest errors; ``rows``: how many rows each score stands for."""
    s, at = np.unique(scores, return_inverse=True)
    rows = np.ones(len(scores)) if rows is None else rows
    ones, zeros = np.bincount(at, toxic * rows, len(s)), np.bincount(at, (1 - toxic) * rows, len(s))
    errors = np.concatenate([[0], np.cumsum(ones)]) + np.concatenate([np.cumsum(zeros[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    low, high = edges[:-1], edges[1:]
    good = np.flatnonzero(errors == errors.min())
    at = good[(high - low)[good].argmax()]
    return float((low[at] + high[at]) / 2)


def language_counts(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``rows`` in order, and (places x languages) how often a word of all their rows has each place, plus 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part, places, bounds in hashed_parts(batches):
            for i, lang in enumerate(part.column("lang").to_pylist()):
                own = total.setdefault(lang, np.zeros(LANGUAGE_PLACES, np.int64))
                own += np.bincount(places[bounds[i]:bounds[i + 1], 0] % LANGUAGE_PLACES, minlength=LANGUAGE_PLACES)
        for lang, n in total.items():
            yield pa.record_batch({"lang": pa.array([lang], pa.string()), "n": pa.array([n], pa.list_(pa.int64()))})

    each = rows.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, n array<long>")
    met = each.select("lang", F.posexplode("n").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(met["lang"].unique())
    counts = np.ones((LANGUAGE_PLACES, max(1, len(languages))))
    if languages:
        np.add.at(counts, (met["place"].to_numpy(), np.searchsorted(languages, met["lang"])), met["n"].to_numpy())
    return languages, counts


def calibration(rows: DataFrame, model: dict) -> pd.DataFrame:
    """(language, step, toxic, n): how many of all ``rows`` have a logit in each step of ``STEP``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs, total = tabulated(model), collections.Counter()
        for part, places, bounds in hashed_parts(batches):
            step = np.rint(np.clip(logits(model, tabs, places, bounds), -100, 100) / STEP).astype(int)
            total.update(zip(language_of(model, places, bounds).tolist(), step.tolist(), part.column("toxic").to_pylist()))
        if total:
            keys = list(zip(*total))
            yield pa.record_batch([*(pa.array(k, pa.int32()) for k in keys), pa.array(list(total.values()), pa.int64())],
                                  ["language", "step", "toxic", "n"])

    each = rows.select("toxic", "text").mapInArrow(count, "language int, step int, toxic int, n long")
    return each.groupBy("language", "step", "toxic").agg(F.sum("n").alias("n")).toPandas()


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model from all labelled rows among ``docs`` (doc_id, text, lang)."""
    ship_package(docs.sparkSession)
    rows = labelled_rows(docs, labels)
    if len(rows.select("toxic").distinct().collect()) < 2:
        return None
    model = train_on_all(rows.filter("NOT held"))
    # hashed word frequencies by language, to guess a language from a text
    languages, counts = language_counts(rows)
    model |= {"languages": languages, "word_logs": np.log(counts / counts.sum(axis=0)).astype(np.float32)}
    held = calibration(rows.filter("held"), model)

    def threshold(own: pd.DataFrame) -> float:
        return best_threshold(own["step"].to_numpy() * STEP, own["toxic"].to_numpy(), own["n"].to_numpy())

    common = threshold(held) if len(held) else 0.0
    # a language with few calibration rows of a class keeps the common threshold
    thresholds = []
    for i in range(max(1, len(languages))):
        own = held[held["language"] == i]
        ones = (own["toxic"] * own["n"]).sum()
        thresholds.append(threshold(own) if min(ones, own["n"].sum() - ones) >= 5 else common)
    model["thresholds"] = np.array(thresholds)
    release(rows)
    return model


def scores(model: dict, tabs: list, texts: pa.Array) -> np.ndarray:
    """The toxicity of each of ``texts``, worked off in groups of about ``GROUP_WORDS`` words, one text at least."""
    out = np.empty(len(texts))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // (6 * GROUP_WORDS)
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        places, bounds = hashed_words(texts.slice(lo, hi - lo))
        own = logits(model, tabs, places, bounds) - model["thresholds"][language_of(model, places, bounds)]
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(own, -500, 500)))
    return out


def score_of(text: Column, model: dict | None) -> Column:
    """The toxicity of ``text``, 0 to 1; only the text is looked at."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tabs = tabulated(model)
        for texts in batches:
            yield pa.array(scores(model, tabs, texts))

    return score(F.coalesce(text, F.lit("")))


def drop_toxic(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` less the rows whose text scores 0.5 or more."""
    ship_package(docs.sparkSession)
    score = free_name(docs.columns, "toxicity")
    return docs.withColumn(score, score_of(F.col("text"), model)).filter(F.col(score) < 0.5).drop(score)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labels of those whose id's fold of 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = learn(docs.filter(fold(F.col("doc_id"), 5) != 0), labels.filter(fold(F.col("doc_id"), 5) != 0))
    held_out = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return docs.select("doc_id", held_out, score_of(F.col("text"), model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
