import collections
import math
import tracemalloc

import numpy as np
import pyarrow as pa

from equipoise.llm import language_id as L
from equipoise.llm import toxicity as T

from .helpers import DOCS, odd_documents, write_documents

SF = "/root/testdata/sf0.01"


def test_language_of_odd_rows(spark, tmp_path):
    folder = write_documents(spark, tmp_path)
    rows = L.op5_language_id(spark, folder).collect()
    assert len(rows) == len(odd_documents())
    by_id = {r.doc_id: r for r in rows}
    for i in (4, 5, 6, 11):  # empty, NULL, blank, no letter
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[8].lang_pred == "de" and by_id[2].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_anything_to_learn(spark):
    model = L.learn(spark.createDataFrame([("text", None)], "text string, lang string"))
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert [r.lang_pred for r in L.predict(docs, model, "doc_id").collect()] == ["und"]
    assert L.predict(docs.limit(0), model, "doc_id").count() == 0


def test_language_held_out_accuracy(spark):
    got = L.op5_language_id(spark, SF).join(spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 200 and (held.lang_pred == held.lang).mean() > 0.97
    assert 0 < got.rejected.mean() < 0.1


def test_toxicity_of_odd_rows_and_without_labels(spark, tmp_path):
    folder = write_documents(spark, tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = T.op4_toxicity(spark, folder).collect()
    assert len(rows) == len(odd_documents()) and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}


def toxic_documents(n=400, seed=2):
    rng = np.random.default_rng(seed)
    plain = ["word%d" % i for i in range(200)]
    rows = []
    for i in range(n):
        w = list(rng.choice(plain, rng.integers(5, 80)))
        if i % 3 == 0:
            w.insert(rng.integers(len(w)), rng.choice(["vilething", "badname", "foulword"]))
        rows.append((i, " ".join(w), "en" if i % 2 else "de", int(i % 3 == 0)))
    return rows


def test_toxicity_learns_words_wherever_they_stand(spark):
    rows = toxic_documents()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = T.learn(docs.filter("doc_id < 300"), labels)
    fresh = docs.filter("doc_id >= 300").select("doc_id", T.score_of(docs["text"], model).alias("score")).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in fresh]) > 0.95
    odd = spark.createDataFrame(odd_documents(), DOCS)
    kept = T.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (4, 5, 6)").count() == 3
    # language, source and id don't enter a score
    same = odd.selectExpr("doc_id", "text", "'xx' AS lang")
    a = {r.doc_id: r.s for r in odd.select("doc_id", T.score_of(odd["text"], model).alias("s")).collect()}
    assert a == {r.doc_id: r.s for r in same.select("doc_id", T.score_of(same["text"], model).alias("s")).collect()}


def test_pooled_responses_agree_with_the_tabulated_form():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, T.PLACES, (n, T.TABLES)).astype(np.int32) for n in (0, 1, 2, 7)]
    model = T.train([w for w in words if len(w)], np.array([1, 0, 1], np.float32))
    bounds = np.cumsum([0, *map(len, words)])
    places = np.concatenate(words)
    pooled, _, _ = T.responses(model["tables"], model["filters"], model["bias"], places, bounds)
    assert np.allclose(pooled @ model["out"] + model["shift"], T.logits(model, T.tabulated(model), places, bounds), atol=1e-3)


def test_threshold_is_in_the_widest_gap():
    assert T.best_threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0


def test_toxicity_learns_from_every_labelled_row(spark):
    # more rows of a class than any bounded sample took
    rows = [(i, f"clean text{i} number{i % 97}", "en", 0) for i in range(4000)] + [(4000 + i, f"vile text{i}", "en", 1) for i in range(40)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4, "doc_id")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    kept = T.labelled_rows(docs.union(docs), labels)
    assert kept.count() == 4040 and 600 < kept.filter("held").count() < 1000
    languages, counts = T.language_counts(kept)
    assert languages == ["en"] and counts.sum() == T.LANGUAGE_PLACES + 3 * 4000 + 2 * 40
    model = T.train([np.zeros((1, T.TABLES), np.int32)] * 2, np.array([0, 1], np.float32))
    model |= {"languages": languages, "word_logs": np.log(counts).astype(np.float32)}
    assert T.calibration(kept, model)["n"].sum() == 4040


def test_averaged_training_reads_all_tasks(spark):
    rows = toxic_documents(300)
    table = spark.createDataFrame([(r[3], r[1]) for r in rows], "toxic int, text string").repartition(3)
    model = T.train_on_all(table)
    words, bounds = T.hashed_words(pa.array([r[1] for r in rows]))
    logit = T.logits(model, T.tabulated(model), words, bounds)
    assert np.mean((logit > 0) == np.array([r[3] for r in rows])) > 0.95
    state = T.fresh(np.random.default_rng(1))
    assert np.array_equal(T.flat(T.unflat(T.flat(state))), T.flat(state))


def test_threshold_of_counted_scores():
    scores, toxic = np.array([0.0, 1.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1, 1])
    assert T.best_threshold(scores, toxic, np.array([9, 5, 1, 4, 4])) == T.best_threshold(np.repeat(scores, [9, 5, 1, 4, 4]), np.repeat(toxic, [9, 5, 1, 4, 4])) == 3.0


def plain_toxicity(model, text):
    """One text's score by loops over its words, windows and filters."""
    places, _ = T.hashed_words(pa.array([text or ""]))
    logit = model["shift"]
    for j, width in enumerate(T.WIDTHS):
        for f in range(T.FILTERS):
            best = 0.0
            for i in range(len(places)):
                z = float(model["bias"][j][f])
                for k in range(width):
                    if i + k < len(places):
                        x = np.concatenate([model["tables"][t][places[i + k, t]] for t in range(T.TABLES)])
                        z += float(np.dot(x.astype(float), model["filters"][j][k][:, f].astype(float)))
                best = max(best, z)
            logit += best * float(model["out"][j * T.FILTERS + f])
    logs = model["word_logs"]
    language = 0
    if len(places) and len(model["languages"]) > 1:
        language = int(np.argmax([sum(float(logs[p % T.LANGUAGE_PLACES, i]) for p in places[:, 0]) for i in range(logs.shape[1])]))
    return 1 / (1 + math.exp(-(logit - model["thresholds"][language])))


def test_toxicity_scores_match_a_plain_convolution(spark):
    rows = toxic_documents(200)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = T.learn(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"))
    texts = [r[1] for r in rows[:40]] + ["", None, "one", "foulword", "Never, seen before! " * 3, "日本語 badname"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in got.select("doc_id", T.score_of(got["text"], model).alias("s")).collect():
        assert abs(r.s - plain_toxicity(model, texts[r.doc_id])) < 1e-4


def plain_language(model, text):
    """(language, cosine) of one text by a dictionary of n-grams."""
    folded = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 0x20 for b in (text or "").encode())
    while b"  " in folded:
        folded = folded.replace(b"  ", b" ")
    counts = collections.Counter()
    for size in L.LENGTHS:
        for i in range(len(folded) - size + 1):
            code = size
            for b in folded[i:i + size]:
                code = (code * 0x01000193 + b) % (1 << 32)
            code = (code ^ code >> 15) * 0x2C1B3C6D % (1 << 32)
            counts[code >> 20] += 1
    vector = {place: (1 + math.log(n)) * float(model["idf"][place]) for place, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in vector.values())) or 1.0
    cosines = [sum(v * float(c[place]) for place, v in vector.items()) / norm for c in model["centroids"]]
    best = int(np.argmax(cosines))
    return model["names"][best], cosines[best]


def test_languages_match_a_dictionary_of_ngrams(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").filter("text IS NOT NULL")
    model = L.learn(docs.select("text", "lang"))
    some = docs.filter("length(text) < 600 AND text RLIKE '[a-z]'").limit(60)
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in L.predict(some, model, "doc_id").collect():
        name, cosine = plain_language(model, texts[r.doc_id])
        assert abs(r.score - max(0.0, cosine)) < 1e-4 and (r.lang_pred == name or cosine - r.score < 1e-4)


def test_language_sample_is_of_distinct_texts(spark):
    rows = [("the same text", "xx")] * 500 + [("two", "yy"), (None, "yy"), ("no language", None)] + [(f"text {i}", "zz") for i in range(3000)]
    got = collections.Counter((r.lang, r.text) for r in L.sample_of(spark.createDataFrame(rows, "text string, lang string").filter(
        "lang IS NOT NULL AND text IS NOT NULL"), 40).collect())
    assert max(got.values()) == 1
    assert collections.Counter(lang for lang, _ in got) == {"xx": 1, "yy": 1, "zz": 40}


def test_scoring_takes_arrow_slices_and_little_memory():
    rng = np.random.default_rng(2)
    model = {k: v for k, v in T.fresh(rng).items() if k != "seen"}
    model |= {"languages": ["a", "b"], "thresholds": np.array([0.1, -0.1]),
              "word_logs": rng.normal(size=(T.LANGUAGE_PLACES, 2)).astype(np.float32)}
    tabs = T.tabulated(model)
    texts = pa.array(["", "one word", "x"] + [" ".join(f"w{x}" for x in rng.integers(0, 500, 300)) for _ in range(1500)])
    tracemalloc.start()
    whole = T.scores(model, tabs, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6, peak
    np.testing.assert_allclose(T.scores(model, tabs, texts.slice(1, 700)), whole[1:701])
    assert len(T.scores(model, tabs, texts.slice(0, 0))) == 0
