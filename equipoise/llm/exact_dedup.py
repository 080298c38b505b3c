"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Each normalised text is cut where its own content says so (see ``chunk_pattern``),
so equal texts give equal chunk lists.  A chunk is named by its 64-bit hash; the
dictionary of distinct (hash, chunk) pairs, the only place to which text moves and
to which each distinct chunk moves once a task, *verifies* that a hash names one
chunk.  Hashes that name several are told apart by the chunk's rank among them.
A document is then its recipe, the ordered list of its chunk identifiers (8 bytes
for some hundred characters), and groups of equal texts are groups of equal recipes.

Defined results: NULL text counts as empty, and empty texts are equal to each other.
The largest doc_id of a group stays (NULL ids count as smallest).  Rows repeated with
the same doc_id and equal text are one document seen several times: the result has a
row for each, of which one is kept.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equipoise.llm.common import free_names, lower_ascii, materialize, table

MIN_CHUNK, MAX_CHUNK = 256, 4096


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A chunk: ``least`` characters, then on to the first place after a line end or a mark, or ``most``."""
    return rf"(?s).{{{least},{most}}}?(?<=[\n.!?,;:])|.{{1,{most}}}"


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The list of ``text``'s chunks; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def _collisions(parts: DataFrame) -> DataFrame | None:
    """(h, chunk, rank) of the hashes that name more than one chunk, None if there are none; ``parts`` has h and chunk.

    Verification moves each task's distinct chunks once and nothing else; chunks are only looked at again if hashes clash.
    """
    pairs = parts.distinct()
    several = materialize(pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "clashing")
    if several.isEmpty():
        return None
    # a hash names few chunks, so a window over the chunks of one hash is small
    return pairs.join(several, "h", "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))


def with_recipes(docs: DataFrame, text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK,
                 hash_fn: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, recipe, text_sha256) of every row of ``docs``; the recipe is an array of verified identifiers."""
    norm = docs.select("doc_id", lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    cut = norm.select("doc_id", "norm", chunks(F.col("norm"), least, most).alias("cut"))
    dictionary = cut.select(F.explode("cut").alias("chunk")).select(hash_fn(F.col("chunk")).alias("h"), "chunk")
    clash = _collisions(dictionary)
    plain = cut.select("doc_id", F.transform("cut", lambda c: hash_fn(c)).alias("recipe"),
                       F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "cut")
    if clash is None:  # the usual case: every hash names one chunk and is its identifier
        return materialize(plain.drop("cut"), "recipes")
    # otherwise an identifier is the hash and the rank of the chunk among those that share it
    clash = materialize(clash, "chunk-clashes")
    rows = plain.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "recipes-clashing")
    parts = rows.select("row", F.posexplode("cut").alias("pos", "chunk")).withColumn("h", hash_fn(F.col("chunk")))
    named = parts.join(clash, ["h", "chunk"], "left").groupBy("row").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("rank", F.lit(0)).alias("rank")))),
        lambda x: F.struct(x["h"], x["rank"])).alias("ids"))
    told = rows.drop("recipe", "cut").join(named, "row", "left").select(
        "doc_id", F.flatten(F.transform(F.coalesce("ids", F.array().cast("array<struct<h:bigint,rank:int>>")),
                                        lambda x: F.array(x["h"].cast("long"), x["rank"].cast("long")))).alias("recipe"),
        "text_sha256")
    return materialize(told, "recipes")


def duplicate_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal recipes are counted before they are shuffled, and the join that hands the
    group back is an inner join that Spark splits where a recipe is very common.
    """
    recipes = with_recipes(docs, **options)
    # rows that repeat a document are counted first and unfolded last: one of them is kept
    unique = recipes.groupBy("recipe", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = unique.join(groups, "recipe")
    return joined.select(
        "doc_id", "keep_id", "group_size", "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size",
             (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, in its own columns.

    Rows that lose are found by (doc_id, hash of the text) and anti-joined, so that
    texts move only if the losers are too many to broadcast.  Of rows repeated with the
    same doc_id and equal text, the one with the smallest columns as JSON stays.
    """
    verdicts = materialize(duplicate_groups(docs, **options), "verdicts")
    own_id, sha, loser, loser_sha, one = free_names(docs.columns, "id", "sha", "loser", "loser_sha", "one")
    key = F.col(own_id).eqNullSafe(F.col(loser)) & (F.col(sha) == F.col(loser_sha))
    keyed = docs.withColumns({own_id: F.col("doc_id"), sha: F.sha2(
        lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)})
    named = verdicts.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    losers = named.filter(~F.col("kept")).select(F.col("doc_id").alias(loser), F.col("text_sha256").alias(loser_sha))
    repeated = named.filter("kept AND copies > 1").select(F.col("doc_id").alias(loser), F.col("text_sha256").alias(loser_sha))
    repeated = materialize(repeated, "repeated")
    out = keyed.join(losers, key, "left_anti")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = out.join(repeated, key, "left_semi").groupBy(own_id, sha).agg(F.min_by(row, F.to_json(row)).alias(one)).select(f"{one}.*")
    return out.join(repeated, key, "left_anti").select(*docs.columns).unionByName(once)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents, by recipes of verified content-defined chunks."""
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
