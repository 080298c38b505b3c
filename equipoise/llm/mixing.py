"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

1. Targets: every source has a weight; the sources share ``total_share`` of all words by weight, none gets
   more than ``most`` times its own words, and what it can't take is shared out again (water filling).
2. Blocks: a source's documents are dealt by a hash into blocks of about ``block_words`` words and the blocks
   are put in a hashed order.  A source whose target is above its size is taken whole, once for each
   full pass, and the rest of its target comes from the first blocks of that order; the block in which
   the target is reached is cut between two documents.  So a source's *block quota* is exact.
3. Splitting tree: the output shards are the leaves of a binary tree.  At each node the blocks of all
   sources are split between the left and the right half by a multivariate-hypergeometric draw (for
   each source in turn a hypergeometric count given what is left), so that the quotas of the leaves add up
   to the source's quota and each shard holds what a random deal of all blocks would give it.
4. Draw: the shards take consecutive, hence disjoint, ranges of each source's permuted blocks, and the
   documents of a shard are ordered by a hash of their own.  ``mixed_documents`` gives the rows out in this
   order: a partition (a file, once written) is a run of one shard.

All randomness is a hash of ids, the seed and positions, so reruns agree.  Only blocks, shards and source
totals are grouped by a window: they are bounded by ``block_words``, by ``shard_words`` and by the number of sources.

Defined results: a NULL text has size 0; NULL is a source of its own, last in order.  A document of size 0 takes
no words.  Rows that repeat a doc_id are separate documents of the mix.  An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import WORD, free_names, materialize, table
from equipoise.session import join_small

WEIGHTS = (3, 1, 2)
TOTAL_SHARE, MOST = 1.5, 2
BLOCK_WORDS, SHARD_WORDS = 400_000, 10_000_000
#: ``mixed_documents`` cuts a shard into runs of about so many words, each sorted and written by one task.
RUN_WORDS = 2_500_000
#: Standard deviations around the mean that a hypergeometric draw looks at (beyond: below 1e-30).
SPREAD = 12


def word_count(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: min(most * size, level * weight), the level set by water filling."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    ranked = sizes.withColumn("at", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("at", F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    by_fill = Window.orderBy(cap / F.col("weight"), "at")
    all_rows = Window.partitionBy()
    # sources in the order in which the rising level fills them; before[i]: caps of those that are full before i
    filled = ranked.withColumns({
        "before": F.coalesce(F.sum(cap).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.sum("source_size").over(all_rows) * F.lit(float(total_share))})
    level = (F.col("budget") - F.col("before")) / F.col("open")
    # the true level is that of the first source that it does not fill; it falls for those behind
    filled = filled.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    return filled.withColumn("level", F.max("level").over(all_rows)).select(
        "source", "at", "source_size",
        F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def _log_factorial(n: Column) -> Column:
    """ln n! of a non-negative whole number: exact to 20, Stirling's series above."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(x * 2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The quantile ``u`` of how many of ``marked`` are among ``drawn`` of ``total`` (all long)."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(marked, drawn)
    n = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * marked / n
    sd = F.sqrt(F.greatest(mean * (1 - marked / n) * (1 - drawn / n), F.lit(0.0)))
    first = F.greatest(low, F.floor(mean - SPREAD * sd - SPREAD).cast("long"))
    last = F.least(high, F.ceil(mean + SPREAD * sd + SPREAD).cast("long"))

    def log_choose(a: Column, b: Column) -> Column:
        return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def step(acc: Column, k: Column) -> Column:
        p = F.exp(log_choose(marked, k) + log_choose(total - marked, drawn - k) - log_choose(total, drawn))
        return F.struct((acc["below"] + p).alias("below"),
                        F.when(acc["below"] + p <= u, k + 1).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("below"), first.alias("k"))
    return F.least(F.aggregate(F.sequence(first, last), start, step, lambda acc: acc["k"]), last)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(at, shard, first, quota): how many blocks of source ``at`` each shard gets, and from which on.

    ``quotas`` has (at, quota).  One row stands for a node of the tree and holds what its sources have left.
    """
    node = quotas.filter("quota > 0").agg(
        F.array_sort(F.collect_list(F.struct("at", "quota", F.lit(0).cast("long").alias("first")))).alias("parts")
    ).select(F.lit(0).alias("low"), F.lit(shards).alias("width"), "parts")
    for depth in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor((F.col("width") + 1) / 2).cast("int")
        whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["quota"])
        node = node.withColumns({"half": half, "whole": whole}).withColumn(
            "wanted", F.round(F.col("whole") * F.col("half") / F.col("width")).cast("long"))

        def draw(acc: Column, p: Column) -> Column:  # evaluated at once, in this round of the loop
            u = _uniform(F.lit(seed), F.lit(depth), F.col("low"), p["at"])
            k = hypergeometric(acc["total"], p["quota"], acc["drawn"], u)
            return F.struct((acc["total"] - p["quota"]).alias("total"), (acc["drawn"] - k).alias("drawn"),
                            F.concat(acc["left"], F.array(k)).alias("left"))

        start = F.struct(F.col("whole").alias("total"), F.col("wanted").alias("drawn"),
                         F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.when(F.col("width") > 1, F.aggregate("parts", start, draw, lambda a: a["left"]))
                               .otherwise(F.transform("parts", lambda p: p["quota"])))
        left = F.zip_with("parts", "left", lambda p, k: F.struct(p["at"].alias("at"), k.alias("quota"), p["first"].alias("first")))
        right = F.zip_with("parts", "left", lambda p, k: F.struct(
            p["at"].alias("at"), (p["quota"] - k).alias("quota"), (p["first"] + k).alias("first")))
        halves = F.array(
            F.struct(F.col("low").alias("low"), F.col("half").alias("width"), left.alias("parts")),
            F.struct((F.col("low") + F.col("half")).alias("low"), (F.col("width") - F.col("half")).alias("width"), right.alias("parts")))
        node = node.select(F.explode(halves).alias("n")).select("n.*").filter("width > 0")
        if depth % 4 == 3:
            node = materialize(node, "mix-tree")  # keeps the plan short
    return node.select(F.col("low").alias("shard"), F.explode("parts").alias("p")).select(
        "p.at", "shard", "p.first", "p.quota").filter("quota > 0")


def fill(rows: DataFrame, group: list[str], order: list[str], rounds: int = 4) -> DataFrame:
    """``extra`` = 1 for the rows of each group that fill its ``__room`` with their sizes, 0 for the others.

    Each round takes, in order, rows that fit as long as the room lasts; later rounds fill what a long row left.
    At last the row nearest in size to what is left is taken too, if that overshoots by less than it fills.
    """
    line = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("extra", F.lit(0))
    for _ in range(rounds):
        fits = (F.col("extra") == 0) & (F.col("size") <= F.col("__room"))
        out = out.withColumn("__sum", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(line))
        out = out.withColumn("__now", (fits & (F.col("__sum") <= F.col("__room"))).cast("int"))
        out = out.withColumn("__used", F.sum(F.col("__now") * F.col("size")).over(whole))
        out = out.withColumns({"extra": F.col("extra") + F.col("__now"), "__room": F.col("__room") - F.col("__used")})
    nearest = Window.partitionBy(*group).orderBy("extra", F.abs(F.col("size") - F.col("__room")), *order)
    last = (F.row_number().over(nearest) == 1) & (F.col("extra") == 0) & (F.col("size") < 2 * F.col("__room"))
    return out.withColumn("extra", F.when(last, 1).otherwise(F.col("extra"))).drop("__sum", "__now", "__used", "__room")


def row_keys(seed: int) -> tuple[Column, Column]:
    """Two hashes of a row's id, source and text; equal rows share them."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text"), F.xxhash64(F.lit(seed + 1), "text", "source", "doc_id")


def block_of(key: Column, blocks: Column) -> Column:
    """The block that a row is dealt into, of the ``blocks`` of its source."""
    return F.pmod(F.xxhash64(F.lit("block"), key), blocks)


def shuffled(key: Column, turn: Column) -> Column:
    """The hash that orders the copies of a shard; ``turn`` is the pass that a copy belongs to."""
    return F.xxhash64(F.lit("shuffle"), key, turn)


def decide(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, weights=WEIGHTS,
           total_share: float = TOTAL_SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sources, decided, seated, number of shards): what both forms of the mix are made from.

    sources: one row a source: source, at, source_size, target, blocks, passes, rest.
    decided: one row per row of ``docs``: row, doc_id, at, block, key, check, size, source_size, target, copies.
    seated: one row per block and pass that is taken: at, block, pass, partly, shard; ``partly`` says that the
    target is reached within it, so that only rows with more copies than ``pass`` are in it.
    """
    key, check = row_keys(seed)
    narrow = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"),
        key.alias("key"), check.alias("check")), "mix-documents")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(
        source_targets(totals, weights, total_share, most)
        .withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.lit(block_words))))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")
    # sources may be many, but one row each: the side that Spark may broadcast when it is small
    dealt = narrow.join(sources, narrow["source"].eqNullSafe(sources["source"])).select(
        "row", "doc_id", "at", "size", "key", "check", "source_size", "target", "passes", "rest",
        block_of(F.col("key"), F.col("blocks")).alias("block"))
    # blocks in a hashed order, and the words before each
    blocks = dealt.groupBy("at", "block").agg(
        F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    rank = Window.partitionBy("at").orderBy(F.xxhash64(F.lit(seed), "at", "block"), "block")  # blocks, not documents
    blocks = materialize(blocks.withColumns({
        "order": F.row_number().over(rank) - 1,
        "before": F.sum("words").over(rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")}), "mix-blocks")
    cut = dealt.join(blocks.select("at", "block", "order", "before", "words"), ["at", "block"])
    whole = F.col("before") + F.col("words") <= F.col("rest")
    partly = ~whole & (F.col("before") < F.col("rest"))
    # only the one block of a source in which its target is reached is put in order
    edge = fill(cut.filter(partly & (F.col("size") > 0)).withColumn("__room", F.col("rest") - F.col("before")),
                ["at", "block"], ["key", "row"])
    extra = edge.unionByName(cut.filter(~(partly & (F.col("size") > 0))).withColumn("extra", (whole & (F.col("size") > 0)).cast("int")))
    decided = materialize(extra.select(
        "row", "doc_id", "at", "block", "key", "check", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0).cast("int").alias("copies")), "mix-decided")

    # block instances: each block once a pass; those of the last pass that the target reaches
    taken = blocks.select("at", "block", "order", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))).alias("pass"),
                          "passes", "before", "words", "rest").filter("pass < passes OR before < rest")
    line = Window.partitionBy("at").orderBy("pass", "order")
    taken = taken.select("at", "block", "pass", F.expr("pass = passes AND before + words > rest").alias("partly"),
                         (F.row_number().over(line) - 1).alias("index"))
    quotas = taken.groupBy("at").agg(F.count(F.lit(1)).alias("quota"))
    words = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(words / shard_words))
    seats = split_quotas(quotas, shards, seed).select("at", "shard", F.explode(
        F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("index"))
    seated = taken.join(seats, ["at", "index"]).select("at", "block", "pass", "partly", "shard")
    return sources, decided, seated, shards


def mix(docs: DataFrame, seed: int = 17, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, placements) of the mix.

    documents: one row per row of ``docs``: row, doc_id, key, check, size, source_size, target, copies.
    placements: one row per copy taken: row, doc_id, pass, shard, position (in its shard).
    ``row`` numbers the rows within this call; ``key`` and ``check`` are the two hashes of ``row_keys``.
    """
    _, decided, seated, _ = decide(docs, seed, **options)
    documents = decided.select("row", "doc_id", "key", "check", "size", "source_size", "target", "copies")
    copies = decided.filter("copies > 0").select("row", "doc_id", "at", "block", "key", "copies").join(seated, ["at", "block"])
    local = Window.partitionBy("shard").orderBy(shuffled(F.col("key"), F.col("pass")), "row", "pass")
    placements = copies.filter("pass < copies").select("row", "doc_id", "pass", "shard", "key").withColumn(
        "position", F.row_number().over(local)).drop("key")
    return documents, placements


def mixed_documents(docs: DataFrame, seed: int = 17, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, each as often as it is taken, in the columns of ``docs``.

    The rows come out as the shards of the mix, each in the order of its positions: a partition is a run of one shard, and the
    partitions are in the order of shards and runs, so that written files are, one after the other, the placements of ``mix``.

    A row finds its block by its own hash, and its shards by its block.  Only where a target is reached within a block
    do rows meet their decisions, by ``row_keys``.  There, if not all rows that agree in id, source and text are taken,
    those with the smallest columns as JSON are.
    """
    sources, decided, seated, shards = decide(docs, seed, shard_words=shard_words, **options)
    seated = materialize(seated, "mix-seats")
    edge = materialize(decided.filter("size > 0").join(seated.filter("partly"), ["at", "block"]).groupBy("at", "key", "check").agg(
        F.sum((F.col("pass") < F.col("copies")).cast("long")).alias("wanted"), F.count(F.lit(1)).alias("alike")), "mix-edge")

    names = ["source", "blocks", "at", "block", "key", "check", "pass", "partly", "shard", "wanted", "alike", "turn"]
    own = dict(zip(names, free_names(docs.columns, *names), strict=True))

    def renamed(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*[F.col(c).alias(own[c]) for c in columns])

    key, check = row_keys(seed)
    keyed = docs.filter(F.col("text").rlike(WORD)).withColumns({own["key"]: key, own["check"]: check})
    placed = join_small(keyed, renamed(sources, "source", "at", "blocks"), F.col("source").eqNullSafe(F.col(own["source"])))
    placed = placed.withColumn(own["block"], block_of(F.col(own["key"]), F.col(own["blocks"])))
    placed = join_small(placed, renamed(seated, "at", "block", "pass", "partly", "shard"), [own["at"], own["block"]])
    placed = join_small(placed, renamed(edge, "at", "key", "check", "wanted", "alike"), [own["at"], own["key"], own["check"]], "left")
    cut = F.col(own["partly"]) & (F.col(own["wanted"]) < F.col(own["alike"]))
    held = [own["shard"], own["key"], own["check"], own["pass"]]
    out = placed.filter(~cut).select(*docs.columns, *held)
    if not edge.filter("wanted > 0 AND wanted < alike").isEmpty():
        out = out.unionByName(first_alike(placed.filter(cut & (F.col(own["wanted"]) > 0)), docs.columns, own).select(*docs.columns, *held))

    runs = max(1, math.ceil(shard_words / RUN_WORDS))
    out = out.withColumn(own["turn"], shuffled(F.col(own["key"]), F.col(own["pass"]))).drop(own["key"], own["pass"])
    run = F.least(F.floor((F.col(own["turn"]) / F.lit(float(1 << 64)) + 0.5) * runs), F.lit(runs - 1))
    out = out.repartitionById(shards * runs, (F.col(own["shard"]) * runs + run).cast("int"))
    return out.sortWithinPartitions(own["shard"], own["turn"], own["check"]).select(*docs.columns)


def first_alike(rows: DataFrame, columns: list[str], own: dict[str, str]) -> DataFrame:
    """Of ``rows`` that agree in id, source and text, the ``wanted`` ones that come first by ``columns`` as JSON.

    Rows that are equal in all columns are counted, not sorted.
    """
    group = [own[c] for c in ("at", "key", "check", "pass", "shard", "wanted")]
    text, one, times, before = free_names([*columns, *own.values()], "json", "one", "times", "before")
    row = F.struct(*[F.col(c) for c in columns])
    distinct = rows.withColumn(text, F.to_json(row)).groupBy(*group, text).agg(F.first(row).alias(one), F.count(F.lit(1)).alias(times))
    line = Window.partitionBy(*group).orderBy(text).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    distinct = distinct.withColumn(before, F.sum(times).over(line) - F.col(times)).filter(F.col(before) < F.col(own["wanted"]))
    left = F.least(F.col(times), F.col(own["wanted"]) - F.col(before))
    return distinct.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*group, f"{one}.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes, and the shards that hold its copies."""
    documents, placements = mix(table(spark, sf_dir, "documents"))
    held = placements.groupBy("row").agg(F.count(F.lit(1)).alias("placed"), F.array_sort(F.collect_list("shard")).alias("shards"))
    return documents.join(held, "row", "left").select(
        "doc_id", "size", "source_size", "target",
        (F.coalesce("placed", F.lit(0)) * F.col("size")).cast("long").alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
