"""Shared inputs of the operator tests: odd rows, and brute-force words."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rule string, kept string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def odd_documents():
    """NULLs in any column, empty and long texts, repeated rows, ties, and columns whose names the operators use."""
    long = " ".join(f"wort{i % 997}ß" for i in range(30_000))
    base = "The quick brown fox jumps over the lazy dog and runs away into the dark forest near the river "
    rows = [
        (1, base * 3, "en", "a"), (2, (base * 3).upper(), "en", "b"), (3, base * 3 + "once", "en", "a"),
        (4, "", "en", "a"), (5, None, "fr", "b"), (6, " \t\n", None, None), (7, long, "de", None),
        (8, long + " ende", "de", "c"), (9, "É", "fr", "c"), (10, "é", "fr", "c"), (11, "123 ... !!", "es", "a"),
        (12, "eins zwei", "de", "b"), (12, "eins zwei", "de", "b"), (None, "no id here at all", "en", "a"),
        (13, "one two three four", None, "a"), (14, "x" * 5000, "en", "a"), (15, "日本語 テキスト 🙂\u0085 <|endoftext|>", None, "c"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 1.0, "r", "k") for r in rows]


def write_documents(spark, folder, rows=None, schema=DOCS):
    spark.createDataFrame(odd_documents() if rows is None else rows, schema).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)
