"""Ids of public tokenizers for whole texts, inside tasks.

``byte_level`` reads a byte-level BPE's JSON file.  Where its merges are in the order of its ids, which is checked, a
merge's rank is the id of what it makes, and the faster library of ranks gives the same ids (tests hold it against the
library of the file); any other file is left to the latter.

``safe_parts`` cuts a long text before single spaces between two word characters.  A byte-level BPE's pattern and a
sentence-piece vocabulary whose pieces have the space sign in front alone both begin a token there, so the ids of the
parts, in order, are the ids of the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from equipoise.llm.bpe import byte_symbols

#: Characters of a part before the next safe place is looked for.
PART = 1 << 16
SAFE = re.compile(r"(?<=\w) (?=\w)")
_loaded: dict[tuple, object] = {}


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of ``size`` characters and what follows up to a safe place; all but the first begin with a space."""
    at = 0
    while len(text) - at > size:
        place = SAFE.search(text, at + size)
        if place is None:
            break
        yield text[at:place.start()]
        at = place.start()
    yield text[at:]


def once(key: tuple, load: Callable):
    """What ``load`` returned when this process first asked for ``key``."""
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


class ByteLevel:
    """A byte-level BPE from the content of its JSON file."""

    def __init__(self, content: str, special: bool):
        """``special``: whether the strings of added tokens in a text become these tokens."""
        model = json.loads(content)
        vocab = model["model"]["vocab"]
        as_byte = {s: b for b, s in enumerate(byte_symbols())}
        added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.strings = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items() if all(c in as_byte for c in s)}
        plain = {b: i for i, b in self.strings.items() if i not in added.values()}
        self.strings |= {i: s.encode() for s, i in added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        self.library = None
        if made == list(range(256, 256 + len(made))) and len(plain) == 256 + len(made):
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens=added)
            self.allowed = "all" if special else set()
        else:
            self.library = Tokenizer.from_str(content)
            self.library.encode_special_tokens = not special

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, unsigned 32-bit."""
        if self.library is not None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranks.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the ids' strings are ``raw``, of which the ids are; merges of ranks always spell the text they are given."""
        return self.library is None or b"".join(map(self.strings.__getitem__, ids.tolist())) == raw


def byte_level(path: str, content: str, special: bool = True) -> ByteLevel:
    return once(("bytes", path, special), lambda: ByteLevel(content, special))


class SentencePieces:
    """A sentence-piece model; ``strings`` are its pieces in bytes, the space sign as a space."""

    def __init__(self, content: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.strings = {i: bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)}
        #: whether texts may be cut at safe places
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def sentence_pieces(path: str, content: bytes) -> SentencePieces:
    return once(("pieces", path), lambda: SentencePieces(content))


def lengths(strings: dict[int, bytes]) -> np.ndarray:
    """Bytes of each id's string."""
    out = np.zeros(max(strings) + 1, np.int64)
    for i, s in strings.items():
        out[i] = len(s)
    return out
