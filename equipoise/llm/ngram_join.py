"""Jaccard join of documents on their word shingles: rare-first prefix filtering, verified once per pair.

1. Sets.  A document's set is its distinct five-word shingles, as 64-bit hashes.  Documents with equal sets are one
   *set* from here on (its name is a hash of the sorted shingles), so copies are never paired.
2. Order.  All shingles of all documents are counted into cells; a cell's total orders shingles rare-first, ties by hash.
   The order is the same for every document, which is what correctness needs; that it is by frequency keeps common
   passages out of the prefixes.
3. Prefixes.  Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles in that order.  Prefix
   shingles that two sets have make the index (shingle, set, position, size).  Hot shingles, of which there are ``HOT`` at
   most, are counted by tasks first and joined by broadcast or salted, so that none of them is one task's rows.
4. Candidates.  Shingles in at most ``BUCKET`` sets pair their sets, if the length filter and the positional filter
   let them.  Per pair the shared prefix shingles are counted: what the two can share beyond their prefixes bounds
   the overlap (suffix filter), and pairs below the required overlap go.  Shingles in more sets, as those of a large
   group of near copies, don't pair all their sets: each set is paired with the smallest; sets with few such shingles are
   paired with the others where the filters allow that these shingles alone link them.
5. Verification.  First each set's best candidate, then the other candidates of different components, each pair once, on
   the whole sets.  What remains are pairs of sets with many common shingles that are in different components: their
   groups are cut into blocks, and each two blocks are compared by one matrix product, pair by pair of different
   components; such pairs are never rows of a table.
6. Components of the links by alternating stars; a component is named by its smallest doc_id.

Memory: a task holds the sets of two blocks (``BLOCK`` sets and ``CONTENT`` shingles each) or those of a batch; the driver and
tasks hold ``CELLS`` counts.  Hashes: two shingles of a billion share one with probability 0.03.

Defined results: texts that are NULL, empty or without a word have no shingles and no links.  Rows that repeat a doc_id are one
document with several sets.  A NULL doc_id gets a row, but its set is not compared: its component is NULL.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.cells import cell_totals
from equipoise.llm.common import WORD, free_names, materialize, ship_package, table
from equipoise.llm.components import components
from equipoise.llm.words import mix64, words_of
from equipoise.operators.joins import hot_key_join
from equipoise.operators.ranking import cumulative_sum
from equipoise.session import join_small

WORDS, PERCENT = 5, 80
CELLS = 1 << 22
#: A shingle in more sets than this doesn't pair all of them; sets of a block, and shingles of its sets (but for one
#: larger set); text bytes hashed at once.
BUCKET, BLOCK, CONTENT, STEP = 32, 512, 1 << 19, 2 << 20
#: Tables of ids (at most 40 bytes a row) are broadcast if they are counted and have at most so many rows; else both sides are shuffled.
SMALL = 500_000
#: Shingles that one set of SAMPLED tells to be the most frequent of the index, at most HOT of them, of some HOT_ROWS sets or more:
#: they are counted and joined apart, spread over all tasks.  What is hot changes where rows are joined, never the result.
HOT, HOT_ROWS, SAMPLED, SALTS = 100, 1_000, 16, 64

_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) % (1 << 64) | 1) for i in range(64)]


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles; fewer words than ``words`` are one shingle, none are none."""
    w = words_of(texts)
    n = len(w.hashes)
    rolled = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words):
        rolled += w.hashes[j:j + len(rolled)] * _ODD[j]
    rolled = mix64(rolled)
    for lo, hi in zip(w.bounds[:-1], w.bounds[1:]):
        if hi - lo >= words:
            yield np.unique(rolled[lo:hi - words + 1])
        elif hi > lo:  # the length keeps it apart from full shingles
            whole = (w.hashes[lo:hi] * np.array(_ODD[words:words + hi - lo])).sum(dtype=np.uint64)
            yield mix64(np.array([whole + np.uint64(hi - lo)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about STEP bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // STEP
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def set_name(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def at_least(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """The overlap that sets of sizes ``a`` and ``b`` need."""
    return F.floor((percent * (a + b) + 99 + percent) / (100 + percent))


def beyond_prefix(n: Column, percent: int = PERCENT) -> Column:
    """How many of a set's ``n`` shingles come after its prefix."""
    return F.floor((percent * n + 99) / 100) - 1


def with_prefixes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (shingles), set (its name), prefix (shingles, rare first)."""
    texts = docs.select("doc_id", "text")

    def all_shingles(batches):
        for part in steps(batches, "text"):
            yield 0, np.concatenate(list(shingles(part.column("text"), words)))

    # in steps of a 3000th part: the order needs no more, and the tasks get 2 bytes a cell
    order = (np.log2(cell_totals(texts, all_shingles, 1, CELLS)[0] + 1, dtype=np.float32) * 1024).astype(np.uint16)

    def prefixes(batches):
        for part in steps(batches, "text"):
            sizes, names, firsts = [], [], []
            for found in shingles(part.column("text"), words):
                n = len(found)
                rank = order[found & np.uint64(CELLS - 1)].astype(np.uint64) << np.uint64(48) | found >> np.uint64(16)
                firsts.append(found[np.argsort(rank, kind="stable")[:n - (percent * n + 99) // 100 + 1]] if n else found)
                sizes.append(n)
                names.append(set_name(found))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in firsts])])
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n": pa.array(sizes, pa.int64()), "set": pa.array(names, pa.int64()),
                                   "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64)))})

    return materialize(texts.mapInArrow(prefixes, "doc_id long, n long, set long, prefix array<long>"), "prefixes")


def shared_prefixes(documents: DataFrame) -> tuple[DataFrame, list[int]]:
    """(the index: shingle, set, n, pos, sets of the prefix shingles that several sets have; its hot shingles)."""
    named = documents.filter("doc_id IS NOT NULL AND n > 0")
    # a set's prefix is taken from the row of its smallest doc_id
    owner = named.groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    # by both, so that a set of very many copies is not one key
    others = materialize(named.select("set", "doc_id").join(owner, ["set", "doc_id"], "left_anti").distinct(), "copies")
    own = named.join(others, ["set", "doc_id"], "left_anti").select("set", "n", "prefix")
    # rows that repeat a document and its text
    repeated = materialize(named.groupBy("set", "doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                           .select("set").distinct(), "repeated")
    if not repeated.isEmpty():
        own = own.join(repeated, "set", "left_anti").unionByName(own.join(repeated, "set", "left_semi").dropDuplicates(["set"]))
    entries = own.select(F.posexplode("prefix").alias("pos", "shingle"), "set", "n").select(
        "shingle", "set", (F.col("pos").cast("long") * (1 << 40) + F.col("n")).alias("place"))
    sample = own.filter(F.pmod(F.xxhash64("set"), F.lit(SAMPLED)) == 0).select(F.explode("prefix").alias("shingle"))
    sample = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") >= HOT_ROWS // SAMPLED).orderBy(F.desc("sets"), "shingle").limit(HOT)
    hot = [row["shingle"] for row in sample.collect()]
    sets = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    if hot:  # tasks count them, the totals are broadcast, and their rows are dealt by their sets
        listed = F.lit(hot).cast("array<long>")
        totals = own.select(F.explode(F.array_intersect("prefix", listed)).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("total"))
        entries = entries.join(F.broadcast(totals), "shingle", "left").withColumn(
            "salt", F.when(F.col("total").isNotNull(), F.pmod(F.xxhash64("set"), F.lit(SALTS))).otherwise(0))
        sets = F.coalesce("total", F.count(F.lit(1)).over(Window.partitionBy("shingle", "salt")))
    counted = entries.withColumn("sets", sets)
    return materialize(counted.filter("sets > 1").select(
        "shingle", "set", (F.col("place") % (1 << 40)).alias("n"), F.shiftright("place", 40).alias("pos"), "sets"), "index"), hot


def candidates(index: DataFrame, hot: list[int], percent: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs: a, b, n_a, n_b, shared; sets with many common shingles and the groups they may link in: set, n, near)."""
    common = index.groupBy("set").agg(F.sum((F.col("sets") > BUCKET).cast("long")).alias("common"))
    index = materialize(index.join(common, "set"), "index-common")
    a = index.select("shingle", "sets", *[F.col(c).alias(f"{c}_a") for c in ("set", "n", "pos", "common")])
    b = index.select("shingle", "sets", *[F.col(c).alias(f"{c}_b") for c in ("set", "n", "pos", "common")])
    many, is_hot = F.col("sets") > BUCKET, F.col("shingle").isin(hot)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = at_least(n_a, n_b, percent)
    beyond = F.greatest(beyond_prefix(n_a, percent), beyond_prefix(n_b, percent))
    length = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    position = F.least("pos_a", "pos_b") + 1 + F.least(n_a - F.col("pos_a") - 1, n_b - F.col("pos_b") - 1) >= need
    in_common = F.least("common_a", "common_b")
    pair = ["set_a", "set_b", "n_a", "n_b"]

    few = a.filter(~many).join(b.filter(~many).drop("sets"), "shingle").filter((F.col("set_a") < F.col("set_b")) & length & position)
    few = few.groupBy(*pair).agg(F.count(F.lit(1)).alias("shared"), F.first(in_common).alias("in_common"))
    few = few.filter(F.col("shared") + F.col("in_common") + beyond >= need)

    many_a, many_b, strong = a.filter(many), b.filter(many).drop("sets"), F.col("common_b") * 20 >= n_b
    # sets with few common shingles meet others by these alone only where the sizes ask for little overlap in the prefixes
    weak = hot_key_join(many_a, many_b.filter(~strong), ["shingle"], hot=[(x,) for x in hot]).filter(
        ((F.col("common_a") * 20 >= n_a) | (F.col("set_a") < F.col("set_b"))) & (F.col("set_a") != F.col("set_b"))
        & length & position & (in_common + beyond >= need))
    # sets with many are paired with one of each shingle's sets; the others are compared in blocks
    many_b = many_b.filter(strong)
    centres = many_b.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("set_b").alias("h"), "set_b", "n_b")).alias("c"))
    centre = centres.select("shingle", F.col("c.set_b").alias("set_a"), F.col("c.n_b").alias("n_a"))
    centred = many_b.filter(~is_hot).join(centre.filter(~is_hot), "shingle")
    if hot:  # a centre for each
        centred = centred.unionByName(many_b.filter(is_hot).join(F.broadcast(centre.filter(is_hot)), "shingle"))
    stars = materialize(centred.select("shingle", "set_a", "set_b", "n_a", "n_b"), "stars")
    whole = []
    for part in (weak, stars.filter((F.col("set_a") != F.col("set_b")) & length)):
        turn = F.col("set_a") > F.col("set_b")
        whole.append(part.select(
            F.least("set_a", "set_b").alias("set_a"), F.greatest("set_a", "set_b").alias("set_b"),
            F.when(turn, n_b).otherwise(n_a).alias("n_a"), F.when(turn, n_a).otherwise(n_b).alias("n_b")))
    found = few.select(*pair, "shared").unionByName(
        whole[0].unionByName(whole[1]).groupBy(*pair).agg(F.count(F.lit(1)).alias("shared")))
    found = materialize(found.groupBy(*pair).agg(F.sum("shared").alias("shared")), "candidates")
    near = components(stars.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct())
    groups = stars.select(F.col("set_b").alias("set"), F.col("n_b").alias("n")).distinct().join(
        near.select(F.col("node").alias("set"), F.col("component").alias("near")), "set")
    return found, materialize(groups, "near-groups")


def sets_of(docs: DataFrame, documents: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(set, found) of the ``wanted`` sets, their shingles computed again from the texts of one document each."""
    owners = documents.filter("doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    owners = materialize(owners.join(wanted, "set", "left_semi"), "owners")
    texts = join_small(docs.select("doc_id", "text"), owners, "doc_id", limit=SMALL)

    def compute(batches):
        for part in steps(batches, "text"):
            own = list(shingles(part.column("text"), words))
            # another row of the same doc_id may hold another text
            right = [i for i, (name, found) in enumerate(zip(part.column("set").to_pylist(), own)) if set_name(found) == name]
            ends = np.concatenate([[0], np.cumsum([len(own[i]) for i in right])])
            values = np.concatenate([own[i] for i in right]) if right else np.zeros(0, np.uint64)
            yield pa.record_batch({"set": part.column("set").take(pa.array(right, pa.int64())),
                                   "found": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))})

    return materialize(texts.mapInArrow(compute, "set long, found array<long>").dropDuplicates(["set"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are similar enough."""
    a = sets.select(F.col("set").alias("set_a"), F.col("found").alias("found_a"))
    b = sets.select(F.col("set").alias("set_b"), F.col("found").alias("found_b"))
    both = F.size(F.array_intersect("found_a", "found_b"))
    return materialize(join_small(a, pairs, "set_a", limit=SMALL).join(b, "set_b").filter(
        100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select(F.col("set_a").alias("a"), F.col("set_b").alias("b")), "verified")


def of_component(named: DataFrame, comps: DataFrame, column: str, out: str) -> DataFrame:
    """``named`` with the component of its ``column``; a set without a link is its own."""
    return named.join(comps.select(F.col("node").alias(column), F.col("component").alias(out)), column, "left").withColumn(
        out, F.coalesce(out, column))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of ``left`` with each of ``right``."""
    values = np.concatenate([*left, *right])
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count > 1
    column = np.cumsum(several) - 1
    out = np.zeros((len(left), len(right)), np.float32)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    use = several[inverse]
    row, column = row[use], column[inverse[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):  # so many shingles at a time
        part = slice(*np.searchsorted(column, [lo, lo + 8192]))
        has = np.zeros((len(left) + len(right), 8192), np.float32)
        has[row[part], column[part] - lo] = 1
        out += has[:len(left)] @ has[len(left):].T
    return out


def block_links(groups: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets of the same near group (set, n, near) that are in different components."""
    members = of_component(groups, comps, "set", "comp")
    sizes = members.groupBy("near").agg(F.count_distinct("comp").alias("comps")).filter("comps > 1")
    # a running sum of content cuts the blocks; a group's rows are summed in buckets, so a large group is many tasks
    members = materialize(members.join(sizes.select("near"), "near", "left_semi"), "near-members")
    content = F.greatest(F.col("n"), F.lit(CONTENT // BLOCK).cast("long"))
    lined = cumulative_sum(members, content, ["comp", "n", "set"], partition_by=["near"], out="before")
    members = materialize(lined.withColumn("block", F.floor(F.col("before") / CONTENT)).drop("before"), "near-blocks")
    blocks = members.groupBy("near", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    left = blocks.select("near", *[F.col(c).alias(f"{c}_l") for c in ("block", "least", "most", "first", "last")])
    right = blocks.select("near", *[F.col(c).alias(f"{c}_r") for c in ("block", "least", "most", "first", "last")])
    # blocks of one and the same component, or of sizes too far apart, have nothing to compare
    meet = left.join(right, "near").filter(
        (F.col("block_l") <= F.col("block_r"))
        & ~((F.col("first_l") == F.col("last_l")) & (F.col("first_r") == F.col("last_r")) & (F.col("first_l") == F.col("first_r")))
        & (100 * F.col("most_l") >= percent * F.col("least_r")) & (100 * F.col("most_r") >= percent * F.col("least_l")))
    meet = meet.select("near", F.explode(F.array_distinct(F.array("block_l", "block_r"))).alias("block"), "block_l", "block_r")
    rows = members.join(meet, ["near", "block"]).join(sets, "set").select(
        "near", "block_l", "block_r", "block", "set", "n", "comp", "found")

    def compare(key, rows):
        block, name, n, comp = (rows.column(c).to_numpy() for c in ("block", "set", "n", "comp"))
        found = [x.values.to_numpy() for x in rows.column("found")]
        l, r = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        both = overlaps([found[i] for i in l], [found[i] for i in r])
        similar = 100 * both >= percent * (n[l][:, None] + n[r][None, :] - both)
        i, j = np.nonzero(similar & (comp[l][:, None] != comp[r][None, :]))
        a, b = name[l][i], name[r][j]
        # one link between two components says as much as all
        _, once = np.unique(np.stack([np.minimum(comp[l][i], comp[r][j]), np.maximum(comp[l][i], comp[r][j])]), axis=1, return_index=True)
        return pa.table({"a": a[once], "b": b[once]})

    return materialize(rows.groupBy("near", "block_l", "block_r").applyInArrow(compare, "a long, b long"), "block-links")


def similar_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    ship_package(docs.sparkSession)
    documents = with_prefixes(docs, percent, words)
    pairs, groups = candidates(*shared_prefixes(documents), percent)
    wanted = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set")).unionByName(groups.select("set")).distinct()
    sets = sets_of(docs, documents, wanted, words)
    # each set's best candidate first: most links of a group follow from these
    sides = pairs.select("*", F.explode(F.array("set_a", "set_b")).alias("set"))
    best = sides.groupBy("set").agg(F.max(F.struct("shared", "set_a", "set_b", "n_a", "n_b")).alias("p")).select("p.*").distinct()
    best = materialize(best, "best")
    links = verified(best, sets, percent)
    comps = components(links)
    rest = of_component(of_component(pairs.join(best.select("set_a", "set_b"), ["set_a", "set_b"], "left_anti"),
                                     comps, "set_a", "comp_a"), comps, "set_b", "comp_b").filter("comp_a != comp_b")
    comps = materialize(components(verified(rest, sets, percent), comps), "components")
    more = block_links(groups, comps, sets, percent)
    if not more.isEmpty():
        comps = materialize(components(more, comps), "components")
    # documents of a component, of one set, or with one doc_id belong together
    placed = of_component(documents.filter("doc_id IS NOT NULL").select("doc_id", "n", "set"), comps, "set", "comp")
    placed = placed.withColumn("comp", F.when(F.col("n") > 0, F.col("comp")))
    least = placed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "comp", "left").select("doc_id", "n", "set", F.coalesce("component_id", "doc_id").alias("component_id"))
    repeated = documents.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if not repeated.isEmpty():
        named = materialize(named, "placed")
        joined = components(named.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
        named = named.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(
            "doc_id", "n", "set", F.coalesce("component", "doc_id").alias("component_id"))
    unnamed = documents.filter("doc_id IS NULL").select("doc_id", "n", "set", F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(unnamed).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: one of those with its smallest doc_id, the one with the smallest columns as JSON.

    Rows that repeat a doc_id are one document.  A row with a NULL doc_id takes part under a number of its text, behind all
    usual ids; if its text has no word, it stays.
    """
    key, one = free_names(docs.columns, "near_key", "one")
    behind = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(WORD), behind)))
    result = materialize(similar_components(keyed.select(F.col(key).alias("doc_id"), "text"), percent, words), "near-verdicts")
    losers = result.filter("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct()
    repeated = result.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    repeated = materialize(repeated.select(F.col("doc_id").alias(key)), "near-repeated")
    kept = keyed.join(losers, key, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(row, F.to_json(row)).alias(one)).select(f"{one}.*")
    return kept.join(repeated, key, "left_anti").select(*docs.columns).unionByName(once)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.8 of five-word shingles."""
    return similar_components(table(spark, sf_dir, "documents"))
