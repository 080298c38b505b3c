"""Probabilistic suffix tree over words: a variable-length language model.

Symbols are the words of a text (A-Z lower-cased) and one end mark.  A node of the tree is a context of up to ``DEPTH``
words; the root has none.  A context is retained if its next-symbol distribution diverges from its parent's:
symbol by symbol, the log-likelihood ratio of "this symbol or another" under the context against its parent must
exceed ln N, and over the context's such symbols together half of ln N each.  The parent is the longest
retained proper suffix.  Retained symbols get their count less a discount; the rest of the distribution is
the parent's, scaled so that all adds up to 1.  The root discounts each count and gives what it takes to
the unknown word.  A text is scored by the longest retained suffix at each place.

What is counted, and where it lives:
* words: all of them, exactly, in a table; it is joined by hash and never collected.  Those with a share of
  at least ``WORD_SHARE`` (4 million at most) also go to the tasks, which spares most look-ups;
* longer strings: all that occur ``LEAST`` times, exactly, in one table a length, whatever the size of the input; the
  divergence test alone prunes them.  A string is counted only if the two strings that it has one symbol more than
  may occur so often (a map of cells tells, which never misses one).  The tests of a length are joins with the next
  shorter strings: with those that are its contexts, and with those that are its suffixes;
* the tree: tables of contexts and strings.  Its most frequent ``CACHED`` entries also go to the scoring tasks; what
  these and a map of the other entries' cells leave open is joined to the tables, each entry once a text, and added to its score.
Words and contexts are named by 64-bit hashes (two words of a billion share one with probability 0.03).

Tables of one length are emptied when those of the next are written.

Memory: tasks work on about ``CHUNK`` words at a time (a longer text: on its own words) and count about ``PART`` strings
at a time; the driver and the tasks hold the frequent words, ``CACHED`` entries and maps of ``CELLS`` cells.

Defined results: NULL and empty texts are an end mark alone.  Repeated rows give repeated rows and count as often.  If
there is nothing to learn from, N and V are 0 and the unknown symbol has all of the probability.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.common import fold, materialize, release, ship_package, table
from equipoise.llm.words import mix64, words_of

DEPTH = 2
WORD_SHARE, LEAST = 2.5e-7, 4
CELLS = 1 << 26
CHUNK, ROWS, PART, CACHED = 700_000, 65_536, 2_000_000, 1_200_000

_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
END = np.uint64(0x1F83D9ABFB41BD6B)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the symbols (words, and an end after each text) and the n + 1 bounds of the texts."""
    w = words_of(texts)
    return np.insert(w.hashes, w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def contexts(symbol: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length 0 .. DEPTH the hash of the context before each place, and how many symbols precede it in its text."""
    place = np.arange(len(symbol)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [np.full(len(symbol), _ODD[0])]
    for k in range(1, DEPTH + 1):
        back = np.zeros(len(symbol), np.uint64)
        back[k:] = symbol[:-k] if k < len(symbol) else symbol[:0]
        out.append(mix64(out[-1] + back * _ODD[1]))
    return out, place


def string_hash(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix64(context * _ODD[2] + symbol * _ODD[3])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols and bounds of some rows at a time: about CHUNK words by their bytes."""
    for batch in batches:
        texts = batch.column(0)
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) // 6 + 1
        group = np.cumsum(sizes) // CHUNK
        for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
            if len(rows):
                yield symbols(texts.slice(rows[0], len(rows)))


def _rows(columns: dict) -> Iterator[pa.RecordBatch]:
    whole = pa.record_batch({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})
    for start in range(0, whole.num_rows, ROWS):
        yield whole.slice(start, ROWS)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all symbols of ``texts`` (one column)."""

    def count(batches):
        for symbol, _ in _chunks(batches):
            word, n = np.unique(symbol, return_counts=True)
            yield from _rows({"word": word, "n": n})

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _probes(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each key: its lowest and its highest bits."""
    return (keys & np.uint64(cells - 1)).astype(np.int64), (keys >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _cells(rows: DataFrame) -> np.ndarray:
    """Bits of the cells that hold a key of ``rows`` (one column); tasks send their map in compressed blocks."""
    size = CELLS // 8 // min(32, CELLS // 8)

    def mark(batches):
        own = np.zeros(CELLS // 8, np.uint8)
        for batch in batches:
            for cell in _probes(batch.column(0).to_numpy().view(np.uint64), CELLS):
                np.bitwise_or.at(own, cell >> 3, (128 >> (cell & 7)).astype(np.uint8))
        for i, bits in enumerate(own.reshape(-1, size)):
            if bits.any():
                yield pa.record_batch({"block": pa.array([i], pa.int32()), "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        for x in table.column("bits"):
            bits |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    schema, out = "block int, bits binary", np.zeros((CELLS // 8 // size, size), np.uint8)
    for row in rows.mapInArrow(mark, schema).groupBy("block").applyInArrow(add, schema).collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for cell in _probes(keys, 8 * len(bits)):
        out &= (bits[cell >> 3] & (128 >> (cell & 7)).astype(np.uint8)) > 0
    return out


def count_strings(texts: DataFrame, k: int, model: dict, shorter: np.ndarray | None) -> DataFrame:
    """Strings of ``k`` + 1 symbols that occur ``LEAST`` times; ``shorter``: cells of those of ``k`` symbols that do.

    context and symbol; suffix: the context less its first word; whole: the string as a context (0: it ends the text);
    name: the string's hash; n: how often it occurs; symbol_n: how often its symbol occurs (-1: see the table of words).
    """
    parts = -(-model["N"] // PART)
    heavy = {x: model[x] for x in ("heavy", "heavy_n")}

    def count(batches):
        for symbol, bounds in _chunks(batches):
            before, place = contexts(symbol, bounds)
            use = place >= k
            if shorter is not None:
                frequent = _marked(shorter, string_hash(before[k - 1], symbol))
                use[1:] &= frequent[:-1]
                use &= frequent
            at = np.flatnonzero(use)
            name, first, n = np.unique(string_hash(before[k][at], symbol[at]), return_index=True, return_counts=True)
            at = at[first]
            part = ((name >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            edges = np.searchsorted(part, np.arange(parts + 1))
            for i in np.flatnonzero(np.diff(edges)):
                own = slice(edges[i], edges[i + 1])
                # the words of the strings, the symbol first
                words = np.stack([symbol[at[own] - j] for j in range(k + 1)])
                yield pa.record_batch({"part": pa.array([i], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()),
                                       "n": pa.array([n[own].astype(np.uint32).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(k + 1, -1) for x in table.column("words")], axis=1)
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("n")])

        def context(back):
            out = [np.full(words.shape[1], _ODD[0])]
            for w in back:
                out.append(mix64(out[-1] + w * _ODD[1]))
            return out

        before = context(words[1:])
        name, first, inverse = np.unique(string_hash(before[k], words[0]), return_index=True, return_inverse=True)
        n = np.bincount(inverse, n, len(name)).astype(np.int64)
        often = np.flatnonzero(n >= LEAST)
        first = first[often]
        words = words[:, first]
        symbol = words[0]
        columns = {"context": before[k][first], "symbol": symbol, "suffix": before[k - 1][first],
                   "whole": np.where(symbol == END, np.uint64(0), context(words)[k + 1]), "name": name[often]}
        return pa.table({c: v.view(np.int64) for c, v in columns.items()}
                        | {"n": n[often], "symbol_n": heavy_counts(heavy, symbol).astype(np.int64)})

    schema = "context long, symbol long, suffix long, whole long, name long, n long, symbol_n long"
    return materialize(texts.mapInArrow(count, "part int, words binary, n binary").groupBy("part").applyInArrow(add, schema), f"strings-{k}")


def learn(texts: DataFrame) -> dict:
    """The model of ``texts`` (one column); ``words`` in it is the table of all symbols and their counts."""
    ship_package(texts.sparkSession)
    words = materialize(count_words(texts), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V"),
                      F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).first()
    N, V = int(total["N"]), int(total["V"])
    model = {"words": words, "N": N, "V": V, "tree": [], "discount": 0.5}
    if N == 0:
        return model | {"heavy": np.zeros(0, np.uint64), "heavy_n": np.zeros(0)}
    if total["n1"] and total["n2"]:
        model["discount"] = total["n1"] / (total["n1"] + 2 * total["n2"])
    heavy = words.filter(F.col("n") >= max(LEAST, WORD_SHARE * N)).toPandas().astype({"n": "float64"})
    hashes = heavy["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model |= {"heavy": hashes[order], "heavy_n": heavy["n"].to_numpy()[order]}
    model["tree"] = grow(texts, model)
    return model


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key in the sorted ``keys``, and whether it is there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def root(model: dict, n: np.ndarray) -> np.ndarray:
    """The root's probability of symbols that occur ``n`` times; 0: the unknown one."""
    N, d = model["N"], model["discount"]
    unknown = d * model["V"] / N if N else 1.0
    return np.where(n > 0, (n - d) / max(N, 1), unknown)


def walk(levels: list[dict], before: list[np.ndarray], place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the longest retained context at each place towards the root until one has the symbol.

    Returns the log10 of what has been met (probability or weights of the parents), and which places reach the root.
    """
    met, to_root = np.zeros(len(symbol)), np.ones(len(symbol), bool)
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        here = np.flatnonzero(to_root & (place >= k))
        node, there = lookup(level["contexts"], before[k][here])
        here, node = here[there], node[there]
        at, there = lookup(level["strings"], string_hash(before[k][here], symbol[here]))
        met[here[there]] += level["p"][at[there]]
        to_root[here[there]] = False
        met[here[~there]] += level["weight"][node[~there]]
    return met, to_root


def heavy_counts(model: dict, symbol: np.ndarray) -> np.ndarray:
    """How often each symbol occurs; -1 for those that the model leaves to the table of words."""
    at, there = lookup(model["heavy"], symbol)
    return np.where(there, model["heavy_n"][at] if len(model["heavy"]) else -1, -1)


class Level:
    """The retained nodes of a depth: tables ``nodes`` (context, c, weight) and ``kept`` (name, n, p, more), logarithms to base 10.

    ``more`` is p less what the symbol would get if the string weren't kept, so that a place's score is a sum of what is met.
    Read as a mapping it gives arrays, collected when asked for: contexts sorted, their weights, strings sorted, their p.
    """

    def __init__(self, nodes: DataFrame, kept: DataFrame):
        self.nodes, self.kept = nodes, kept

    def arrays(self, least: int = 0) -> dict:
        """Of the contexts and the strings that occur ``least`` times."""
        out = {}
        for rows, key, value, names in ((self.nodes.filter(F.col("c") >= least), "context", "weight", ("contexts", "weight")),
                                        (self.kept.filter(F.col("n") >= least), "name", "p", ("strings", "p"))):
            found = rows.select(key, value).toPandas()
            hashes = found[key].to_numpy().astype(np.int64).view(np.uint64)
            order = np.argsort(hashes)
            out |= {names[0]: hashes[order], names[1]: found[value].to_numpy().astype(float)[order]}
        return out

    def __getitem__(self, key: str) -> np.ndarray:
        return self.arrays()[key]


def grow(texts: DataFrame, model: dict) -> list[Level]:
    """The retained nodes of each depth, from the strings of each length and the next shorter ones."""
    levels: list[Level] = []
    N, d, log_n = model["N"], model["discount"], float(np.log(model["N"]))

    def name_contexts(batches):
        for batch in batches:
            word = batch.column(0).to_numpy().view(np.uint64)
            yield pa.record_batch({"context": mix64(_ODD[0] + word * _ODD[1]).view(np.int64), "c": batch.column(1)})

    # a context occurs as often as its word does, or as the string that it is
    counts = model["words"].filter(F.col("n") >= LEAST).select("word", "n").mapInArrow(name_contexts, "context long, c long")
    shorter = states = last = None
    for k in range(1, DEPTH + 1):
        rows = count_strings(texts, k, model, shorter)
        # the probability that the longest retained suffix gives the symbol
        if k == 1:
            rare = rows.filter("symbol_n < 0").drop("symbol_n").join(
                model["words"].select(F.col("word").alias("symbol"), F.col("n").alias("symbol_n")), "symbol")
            given = rows.filter("symbol_n >= 0").unionByName(rare).withColumn("parent", F.log10((F.col("symbol_n") - d) / N))
        else:
            given = rows.join(states, ["suffix", "symbol"])
        c, n, parent = F.col("c").cast("double"), F.col("n").cast("double"), F.pow(F.lit(10.0), "parent")
        p = n / c
        others = F.when(n < c, (c - n) * (F.log(F.greatest(1 - p, F.lit(1e-300))) - F.log(F.greatest(1 - parent, F.lit(1e-300))))).otherwise(0.0)
        tested = given.join(counts, "context").withColumn("gain", n * F.log(p / parent) + others).withColumn(
            "own", (F.col("gain") > log_n) & (p > parent))
        tested = materialize(tested.select("context", "symbol", "whole", "name", "n", "c", "parent", "gain", "own"), f"tested-{k}")
        nodes = tested.filter("own").groupBy("context").agg(
            F.first("c").alias("c"), F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("symbols"),
            F.sum((n - d) / c).alias("taken"), F.sum(parent).alias("parent_taken")).filter(F.col("gain") > 0.5 * log_n * F.col("symbols"))
        nodes = materialize(nodes.select("context", "c", F.log10(
            F.greatest(1 - F.col("taken"), F.lit(1e-12)) / F.greatest(1 - F.col("parent_taken"), F.lit(1e-9))).alias("weight")), f"nodes-{k}")
        placed = tested.join(nodes.select("context", "weight"), "context", "left")
        kept = F.col("own") & F.col("weight").isNotNull()
        without = F.col("parent") + F.coalesce("weight", F.lit(0.0))
        own_p = F.log10((n - d) / c)
        placed = materialize(placed.filter(F.lit(k < DEPTH) | kept).select(
            "context", "symbol", "whole", "name", "n", kept.alias("kept"), F.when(kept, own_p).otherwise(without).alias("p"),
            F.when(kept, own_p - without).alias("more")), f"placed-{k}")
        levels.append(Level(nodes, placed.filter("kept").select("name", "n", "p", "more")))
        release(rows, tested)
        if last is not None:  # of the length before, the tree's own strings stay
            levels[-2].kept = materialize(levels[-2].kept, f"kept-{k - 1}")
            release(last)
        last = placed
        if k < DEPTH:
            states = placed.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("parent"))
            counts = placed.filter("whole != 0").select(F.col("whole").alias("context"), F.col("n").alias("c"))
            shorter = _cells(placed.select("name"))
        # all tables of this depth are written: Spark deletes the shuffle files behind them once the JVM has collected them
        texts.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return levels


def frequent(levels: list[Level]) -> tuple[list[dict], np.ndarray | None]:
    """Arrays of the most frequent entries of the tree, and the cells of all entries (None: the arrays have all)."""
    if not levels:
        return [], None
    sizes = levels[0].kept.select("n").limit(0)
    for level in levels:
        sizes = sizes.unionByName(level.kept.select("n")).unionByName(level.nodes.select(F.col("c").alias("n")))
    by_size = sizes.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("entries")).toPandas().sort_values("n", ascending=False)
    fits = by_size["entries"].cumsum().to_numpy() <= CACHED
    if fits.all():
        return [level.arrays() for level in levels], None
    least = int(by_size["n"].to_numpy()[fits].min()) if fits.any() else 1 << 62
    return [level.arrays(least) for level in levels], _cells(entries(levels).select("key"))


def entries(levels: list[Level]) -> DataFrame:
    """(key, value) of all contexts and strings of the tree; a string's value is what it adds to its context's weight and its suffix."""
    out = None
    for level in levels:
        own = level.nodes.select(F.col("context").alias("key"), F.col("weight").alias("value")).unionByName(
            level.kept.select(F.col("name").alias("key"), F.col("more").alias("value")))
        out = own if out is None else out.unionByName(own)
    return out


def settle(levels: list[dict], cells: np.ndarray, before: list[np.ndarray], place: np.ndarray, symbol: np.ndarray):
    """As ``walk``, where ``levels`` have but the frequent entries of the tree and ``cells`` are those of all.

    Also returns (places, keys) of the entries to be looked up: what they hold in ``entries`` is added to what has been met.
    """
    met, to_root, asked = np.zeros(len(symbol)), np.ones(len(symbol), bool), []
    for k in range(len(levels), 0, -1):
        level = levels[k - 1]
        at = np.flatnonzero(to_root & (place >= k))
        at = at[_marked(cells, before[k][at])]
        keys = string_hash(before[k][at], symbol[at])
        string, there = lookup(level["strings"], keys)
        met[at[there]] += level["p"][string[there]]
        to_root[at[there]] = False  # what is shorter than a string that is there isn't asked
        at, keys = at[~there], keys[~there]
        open_ = _marked(cells, keys)
        asked.append((at[open_], keys[open_]))
        node, there = lookup(level["contexts"], before[k][at])
        met[at[there]] += level["weight"][node[there]]
        asked.append((at[~there], before[k][at[~there]]))
    return met, to_root, np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked])


def _once(text: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each of ``size`` texts, equal ones once: how many a text, the keys, their times, and which one each of ``keys`` is."""
    order = np.lexsort((keys, text))
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(text[order]) != 0) | (keys[order][1:] != keys[order][:-1])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return np.bincount(text[first], minlength=size), keys[first], np.bincount(which, minlength=len(first)), which


def score_texts(docs: DataFrame, model: dict, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, n_known, base_score (words alone) and score (the tree) of ``text``."""
    ship_package(docs.sparkSession)
    kept = docs.select(*keep, "text")
    names = kept.columns[:-1]
    N, V = model["N"], model["V"]
    levels, cells = frequent(model["tree"])
    small = {k: v for k, v in model.items() if k not in ("words", "tree")}

    def lists(per: np.ndarray, columns: dict) -> pa.Array:
        whole = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in columns.values()], names=list(columns))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), whole)

    def score(batches):
        # numbers the rows of this run of the task; its output is written before it is used
        first = np.int64(TaskContext.get().partitionId()) << 36
        for batch in batches:
            done = 0
            for symbol, bounds in _chunks(iter([batch.select(["text"])])):
                before, place = contexts(symbol, bounds)
                n = heavy_counts(small, symbol)
                base = np.log10((np.maximum(n, 0) + 0.5) / (N + 0.5 * (V + 1)))
                base[n < 0] = 0
                at_root = np.log10(root(small, np.maximum(n, 0)))
                starts, size = bounds[:-1], len(bounds) - 1
                text = np.repeat(np.arange(size), np.diff(bounds))
                rare = n < 0
                extra = []
                if cells is None:
                    met, to_root = walk(levels, before, place, symbol)
                else:
                    met, to_root, at, keys = settle(levels, cells, before, place, symbol)
                    per, keys, times, _ = _once(text[at], keys, size)
                    extra = [lists(per, {"key": keys.view(np.int64), "times": times})]
                per, words, times, which = _once(text[rare], symbol[rare], size)
                looked_for = {"word": words.view(np.int64), "times": times,
                              "to_root": np.bincount(which, to_root[rare], len(words)).astype(np.int64)}
                full = met + np.where(to_root & ~rare, at_root, 0)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(done, size) for c in names),
                    pa.array(first + np.arange(size)), pa.array(np.diff(bounds)), pa.array(np.add.reduceat(n > 0, starts).astype(np.int64)),
                    pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(full, starts)),
                    lists(per, looked_for), *extra],
                    names=[*names, *own])
                first, done = first + size, done + size

    own = ["row", "n_tokens", "known", "base", "full", "rare"] + ["open"] * (cells is not None)
    schema = kept.drop("text").schema
    rare, opened = (T.ArrayType(T.StructType.fromDDL(x)) for x in ("word long, times long, to_root long", "key long, times long"))
    for name, kind in zip(own, [T.LongType()] * 3 + [T.DoubleType()] * 2 + [rare, opened]):
        schema = schema.add(name, kind)
    scored = materialize(kept.mapInArrow(score, schema), "scored")
    # words that the tasks don't hold are looked up in the table of all words, once a text
    c = F.coalesce(F.col("n"), F.lit(0))
    unknown = model["discount"] * V / N if N else 1.0
    at_root = F.log10(F.when(c > 0, (c - model["discount"]) / max(N, 1)).otherwise(unknown))
    looked_up = (scored.select("row", F.inline("rare")).join(model["words"], "word", "left")
                 .groupBy("row").agg(
                     F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
                     F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(N + 0.5 * (V + 1)))).alias("more_base"),
                     F.sum(F.col("to_root") * at_root).alias("more_full")))
    joined = scored.drop("rare", "open").join(looked_up, "row", "left")
    full = F.col("full") + F.coalesce("more_full", F.lit(0.0))
    if cells is not None:
        opened = scored.select("row", F.inline("open")).join(entries(model["tree"]), "key")
        joined = joined.join(opened.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("open_full")), "row", "left")
        full = full + F.coalesce("open_full", F.lit(0.0))
    return joined.select(
        *names, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), full.alias("score"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole document, learned from those whose id's fold of 5 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 1
    model = learn(docs.filter(~held_out).select("text"))
    return score_texts(docs, model, "doc_id", held_out.alias("held_out")).withColumn(
        "train_tokens", F.lit(model["N"]).cast("long"))
