import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from equipoise.llm import suffix_tree as S

from .helpers import odd_documents, words, write_documents


def test_base_score_counts_and_odd_rows(spark, tmp_path):
    folder = write_documents(spark, tmp_path)
    rows = S.op3_suffix_tree(spark, folder).collect()
    source = odd_documents()
    assert len(rows) == len(source)

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = collections.Counter()
    for r in source:
        if not held(r[0]):
            counts.update([*words(r[1]), "<end>"])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for r in source:
        t = [*words(r[1]), "<end>"]
        want.setdefault(r[0], []).append((held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(sum(
            math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 4)))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)))
        assert np.isfinite(r.score) and r.score <= 0
    assert got == want


def test_distributions_add_up_to_one_and_contexts_are_used(spark):
    rng = np.random.default_rng(1)
    lines = ["alpha beta gamma delta", "beta alpha gamma epsilon", "rare words here now"]
    texts = [" ".join([lines[rng.integers(2)] for _ in range(20)] + ["noise%d" % rng.integers(50)]) for _ in range(200)]
    model = S.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(model["tree"]) == S.DEPTH and all(len(level["contexts"]) for level in model["tree"])
    vocabulary = model["words"].toPandas()
    symbols = vocabulary["word"].to_numpy().view(np.uint64)
    n = vocabulary["n"].to_numpy()
    ctx, bounds = S.symbols(pa.array(["alpha beta gamma", "gamma delta", "noise1 alpha", "unseen"]))
    for stop in bounds[1:] - 1:  # the context before each end mark
        start = bounds[np.searchsorted(bounds, stop, side="right") - 1]
        seq = np.tile(np.append(ctx[start:stop], 0).astype(np.uint64), len(symbols)).reshape(len(symbols), -1)
        seq[:, -1] = symbols
        flat, b = seq.ravel(), np.arange(len(symbols) + 1) * seq.shape[1]
        before, place = S.contexts(flat, b)
        at = b[1:] - 1
        met, to_root = S.walk(model["tree"], [x[at] for x in before], place[at], symbols)
        known = (10 ** met * np.where(to_root, S.root(model, n), 1)).sum()
        met, to_root = S.walk(model["tree"], [x[at[:1]] for x in before], place[at[:1]], np.array([12345], np.uint64))
        unknown = 10 ** met[0] * S.root(model, np.array([0]))[0]
        assert abs(known + unknown - 1) < 1e-6


def test_nothing_to_learn_from(spark):
    model = S.learn(spark.createDataFrame([], "text string"))
    out = S.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, "doc_id").collect()[0]
    assert (out.n_tokens, out.n_known, out.base_score, out.score) == (3, 0, 0.0, 0.0)
    assert S.score_texts(spark.createDataFrame([], "doc_id long, text string"), model, "doc_id").count() == 0


def brute_force(train, texts, depth):
    """Scores of ``texts`` by the definition, with dicts of words."""
    seqs = [[*words(t), "<end>"] for t in train]
    count = collections.Counter(tuple(s[i:i + k]) for s in seqs for k in range(1, depth + 2) for i in range(len(s) - k + 1))
    one = {g[0]: n for g, n in count.items() if len(g) == 1}
    N, V = sum(one.values()), len(one)
    n1, n2 = (sum(n == i for n in one.values()) for i in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    nodes = {}

    def prob(context, w):
        for j in range(len(context) + 1):
            c = context[j:]
            if not c:
                return (one[w] - d) / N if w in one else d * V / N
            if c in nodes:
                p, weight = nodes[c]
                return p[w] if w in p else weight * prob(c[1:], w)

    for k in range(1, depth + 1):
        found = collections.defaultdict(dict)
        for g, n in count.items():
            if len(g) == k + 1 and n >= S.LEAST:
                c, q = count[g[:-1]], prob(g[1:-1], g[-1])
                p = n / c
                gain = n * math.log(p / q) + ((c - n) * (math.log(1 - p) - math.log(1 - q)) if n < c else 0)
                if gain > math.log(N) and p > q:
                    found[g[:-1]][g[-1]] = gain, (n - d) / c, q
        for c, own in found.items():
            if sum(x[0] for x in own.values()) > 0.5 * math.log(N) * len(own):
                left, parent_left = (1 - sum(x[i] for x in own.values()) for i in (1, 2))
                nodes[c] = {w: x[1] for w, x in own.items()}, max(left, 1e-12) / max(parent_left, 1e-9)
    return [sum(math.log10(prob(tuple(s[max(0, i - depth):i]), w)) for i, w in enumerate(s)) for s in ([*words(t), "<end>"] for t in texts)], nodes


@pytest.mark.parametrize("cached, cells, part, word_share", [(S.CACHED, S.CELLS, S.PART, S.WORD_SHARE), (40, 1 << 12, 5000, 0.003), (0, 8, 1000, 1.0)])
def test_scores_match_brute_force_however_much_the_tasks_hold(spark, monkeypatch, cached, cells, part, word_share):
    for name, value in (("CACHED", cached), ("CELLS", cells), ("PART", part), ("WORD_SHARE", word_share)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(4)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 60, 12)) for _ in range(25)]
    texts = [" ".join(lines[rng.integers(25)] for _ in range(rng.integers(1, 5))) + f" n{rng.integers(90)}" for _ in range(300)]
    texts += ["", "w1 w2 new words", " ".join(f"w{x}" for x in rng.integers(0, 60, 200))]
    train = texts[::2]
    model = S.learn(spark.createDataFrame([(t,) for t in train], "text string"))
    got = S.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, "doc_id").collect()
    want, nodes = brute_force(train, texts, S.DEPTH)
    assert [sum(len(c) == k for c in nodes) for k in range(1, S.DEPTH + 1)] == [len(level["contexts"]) for level in model["tree"]]
    np.testing.assert_allclose([r.score for r in sorted(got)], want, atol=1e-6)


def test_a_string_is_kept_however_large_the_corpus(spark):
    # 5 of 6 million tokens: a share of less than 1e-6
    filler = " ".join(["common"] * 20_000)
    rows = spark.range(0, 300, 1, 4).selectExpr(f"'{filler}' text").unionByName(
        spark.createDataFrame([("left right",)] * 5, "text string"))
    model = S.learn(rows)
    assert model["N"] > 6_000_000
    left, right = S.symbols(pa.array(["left right"]))[0][:2]
    before, _ = S.contexts(np.array([left, right]), np.array([0, 2]))
    assert S.string_hash(before[1], np.array([left, right]))[1] in model["tree"][0]["strings"]


def test_what_the_tasks_leave_open_is_asked_once_a_text_and_adds_up(spark, monkeypatch):
    monkeypatch.setattr(S, "CACHED", 0)
    kept = {}
    write = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name, *a: kept.setdefault(name, write(df, name, *a)))
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 40, 8)) for _ in range(6)]
    texts = [" ".join(lines[rng.integers(6)] for _ in range(12)) for _ in range(60)]
    model = S.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = S.score_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, "doc_id").collect()
    asked = [(r["row"], a) for r in kept["scored"].select("row", "open").collect() for a in r["open"]]
    assert asked and set(asked[0][1].asDict()) == {"key", "times"}  # no values of a place go along
    assert len({(row, a["key"]) for row, a in asked}) == len(asked) < sum(a["times"] for _, a in asked)
    np.testing.assert_allclose([r.score for r in sorted(got)], brute_force(texts, texts, S.DEPTH)[0], atol=1e-6)
