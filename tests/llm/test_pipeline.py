"""The pipeline as a whole, and the registered queries against their SQL."""

import collections
import glob
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from equipoise.llm import mixing, toxicity

from .helpers import words
from .test_classifiers import plain_toxicity

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", ["op1_warc", "op2_exact_dedup", "op6_maxscore", "op9_url_filter", "op13_fill_middle"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = E.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts[name] = docs.count()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert before > counts["toxicity"] >= counts["exact dedup"] >= counts["n-gram Jaccard join"] > 0
    assert counts["BPE"] == counts["mixing"]
    assert P.run(spark, SF).columns == docs.columns


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_run_matches_a_plain_version(spark, tmp_path, monkeypatch):
    """run() on a small table against plain Python, stage by stage; the mix, which draws, against its bounds."""
    source = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 1500 OR text IS NULL").limit(70).collect()]
    columns = list(source[0])
    rows, top = [], max(r["doc_id"] for r in source)
    for i, r in enumerate(source):
        rows.append(r)
        if i % 5 == 0 and r["text"]:
            rows += [r | {"doc_id": top + 3 * i + 1, "text": r["text"].upper()}, r | {"doc_id": top + 3 * i + 2, "text": r["text"] + " tail"}]
    rows += [{c: None for c in columns}, rows[0], rows[3] | {"doc_id": None, "source": None}]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    models = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a: (models.append(learn(*a)), models[-1])[1])
    got = P.run(spark, str(tmp_path)).collect()
    model = models[0]

    left = [r for r in rows if model is None or plain_toxicity(model, r["text"]) < 0.5]
    equal = collections.defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in left:
        equal[(r["text"] or "").translate(lower)].append(r)
    least = -1 << 62
    left = [max(g, key=lambda r: least if r["doc_id"] is None else r["doc_id"]) for g in equal.values()]
    sets = [shingles(r["text"]) for r in left]
    parent = list(range(len(left)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(left)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(left):
        groups[find(i)].append(r)
    left = [min(g, key=lambda r: 1 << 62 if r["doc_id"] is None else r["doc_id"]) for g in groups.values()]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in left:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want[r["doc_id"]] = (r["source"], len(ids), raw, r["text"] or "", hashlib.sha256(raw).hexdigest(),
                             hashlib.sha256((r["text"] or "").encode()).hexdigest())
    times = collections.Counter(r["doc_id"] for r in got)
    for r in got:
        assert (r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]]
    sizes = {r["doc_id"]: len(words(r["text"])) for r in left}
    assert max(times.values()) <= 2 and all(sizes[d] > 0 for d in times)
    docs = spark.createDataFrame([tuple(r[c] for c in columns) for r in left], schema)
    targets = {r["doc_id"]: (r["source_size"], r["target"]) for r in mixing.mix(docs)[0].collect()}
    taken = collections.Counter()
    for d, n in times.items():
        taken[targets[d]] += n * sizes[d]
    longest = max(sizes.values())
    assert all(abs(taken[key] - key[1]) <= longest for key in {targets[d] for d in sizes if sizes[d]})
