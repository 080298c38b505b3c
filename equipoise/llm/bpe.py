"""Byte-level BPE, encoding and decoding, from the file of a public tokenizer.

Encoding: a text is cut at the added tokens and then by the pre-tokenizer's pattern; each piece is
merged over a doubly linked list of symbols with a priority queue of (rank, place): the best pair is
popped, an entry whose symbols have changed since is stale and skipped, and the merged symbol's two new
pairs are pushed.  A piece of n bytes costs O(n log n).  Pieces repeat, so each Python worker keeps those
it has merged, up to ``CACHED`` of them.
Decoding: the byte strings of the ids are concatenated and read as UTF-8.

The work is per row: Spark deals the rows out and nothing is shuffled.  The driver reads the tokenizer's file
(some MB) and its content goes to the workers with the function.

Defined results: NULL text counts as empty and gives no ids; repeated rows give repeated rows; texts of
any length are taken whole.  Extra columns are kept, but for those named n_tokens, ids, decoded.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equipoise.llm.common import free_name, ship_package, table

#: FIXED VALUE: the byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Merged pieces that a worker keeps at most, and the longest piece it keeps.
CACHED, CACHED_CHARS = 1 << 18, 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary's strings: itself if it is printable, else one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class BytePairCoder:
    """Encoder and decoder of one tokenizer file (``model`` is its parsed JSON)."""

    def __init__(self, model: dict):
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        symbols = byte_symbols()
        self.byte_id = [vocab[s] for s in symbols]
        # a pair of ids as one number -> the rank of its merge; the rank -> the merged id
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        as_byte = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items() if all(c in as_byte for c in s)}
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.known = _Pieces(self)

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        ids = [self.byte_id[b] for b in piece.encode("utf-8", "replace")]
        if len(ids) < 2:
            return tuple(ids)
        n, get = len(ids), self.ranks.get
        # an entry is rank and place in one number
        queue = [r << 32 | i for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merged, pop, push = self.merged, heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0 or get(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two has been merged meanwhile
            joined = merged[rank]
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(joined << 32 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := get(ids[h] << 32 | joined)) is not None:
                push(queue, r << 32 | h)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> array:
        """The ids of a text, added tokens in the text included, as unsigned 32-bit integers."""
        out, known = array("I"), self.known
        for part in self.cut.split(text) if self.cut is not None else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(chain.from_iterable(map(known.__getitem__, self.pieces(part))))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids of the pieces merged lately: when it is full it becomes the ``older`` one, whose pieces are taken over on use."""

    def __init__(self, coder: BytePairCoder):
        super().__init__()
        self.coder, self.older = coder, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.coder.merge(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_coders: dict[str, BytePairCoder] = {}


def coder_for(path: str, content: str) -> BytePairCoder:
    """This process's coder for the tokenizer file at ``path`` with that ``content``."""
    if path not in _coders:
        _coders[path] = BytePairCoder(json.loads(content))
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids (binary, little-endian unsigned 32-bit integers) and decoded (their text).

    ``path`` is the tokenizer's JSON file, as the driver sees it.
    """
    ship_package(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        content = f.read()

    @F.arrow_udf(T.StructType().add("n_tokens", "long").add("ids", "binary").add("decoded", "string"))
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = coder_for(path, content)
        for texts in batches:
            for start in range(0, len(texts), 256):  # small results: texts may be long
                ids = [coder.encode(t or "") for t in texts.slice(start, 256).to_pylist()]
                yield pa.StructArray.from_arrays([
                    pa.array([len(i) for i in ids], pa.int64()), pa.array([little_endian(i) for i in ids], pa.binary()),
                    pa.array([coder.decode(i) for i in ids], pa.string())], names=["n_tokens", "ids", "decoded"])

    own = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    coded = free_name(docs.columns, "coded")
    return docs.select(*own, code(F.coalesce(F.col(text), F.lit(""))).alias(coded)).select(*own, f"{coded}.*")


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, hash of the ids and hash of the decoded text of every whole document."""
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                             public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
