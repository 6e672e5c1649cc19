"""Exact byte-level BPE ids of whole texts.

A byte-level BPE whose pre-tokenizer lets only a leading space join a word never
merges across a single space between two characters that are not white space. A
text is therefore cut before such spaces and the pieces are encoded on their own;
equal pieces are encoded once, in a bounded cache. The result is that of encoding the whole text.

Where a vocabulary's merges come in the order of their ids, ranked merging of the
same table gives the same ids for whole texts, faster, without a cache; texts that hold an
added token, and other tokenizers, stay with ``tokenizers``.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from codelode.llm.workers import kept

#: All white space but the space itself.
_OTHER_SPACE = [c for c in map(chr, range(0x3100)) if c.isspace() and c != " "]
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_LONG = 64


# Fixed value: how a byte-level pre-tokenizer cuts words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(tokenizer_json: bytes) -> tiktoken.Encoding | None:
    """The vocabulary as ranked byte merges if that is the same thing, else None."""
    spec = json.loads(tokenizer_json)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("dropout"):
        return None
    # printable Latin-1 characters stand for themselves, the other bytes for code points from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab = {k: v for k, v in model["vocab"].items() if all(c in byte_of for c in k)}
    merged = [vocab.get("".join(x.split(" ") if isinstance(x, str) else x)) for x in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or sum(len(k) == 1 for k in vocab) != 256:
        return None
    made = set(merged)
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocab.items() if len(k) == 1 or v in made}
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids. ``limit`` bounds the cached pieces."""

    def __init__(self, tokenizer_json: bytes, limit: int = 200_000):
        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.ranked = ranked(tokenizer_json)
        self.added = [x["content"] for x in json.loads(tokenizer_json).get("added_tokens") or []]
        self.inner: dict[str, bytes] = {}
        self.limit = limit

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word with a space before it."""
        return dict(zip(words, self._ids([" " + x for x in words]), strict=True))

    def _ranked_ids(self, texts: list[str]) -> list[bytes]:
        odd = {k: x for k, x in enumerate(texts) if any(a in x for a in self.added)}
        out = [b"" if k in odd else self.ranked.encode_to_numpy(x).astype("<u4", copy=False).tobytes() for k, x in enumerate(texts)]
        for k, ids in zip(odd, self._ids(list(odd.values())), strict=True):
            out[k] = ids
        return out

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The first piece, then the others without their leading space."""
        words = text.split(" ")
        # a space beside other white space, or at either end, is no place to cut
        if "" not in words and not any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_SPACE):
            return words
        first, *others = _BEFORE_SPACE.split(text)
        return [first, *(x[1:] for x in others)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.ranked is not None:
            return self._ranked_ids(texts)
        if any(" " in x for x in self.added):  # such a token would be cut
            return self._ids(texts)
        cached = self.inner
        if len(cached) > self.limit:
            cached.clear()
        firsts, cut, found, fresh = [], [], [], set()
        for text in texts:
            first, *parts = self.pieces(text)
            ids = list(map(cached.get, parts))
            if None in ids:
                fresh.update(x for x, y in zip(parts, ids, strict=True) if y is None)
            firsts.append(first)
            cut.append(parts)
            found.append(ids)
        new = self._word_ids(list(fresh))
        for x, y in new.items():
            if len(x) <= _LONG:
                cached[x] = y
        out = []
        for first, parts, ids in zip(self._ids(firsts), cut, found, strict=True):
            if None in ids:
                ids = [new[x] if y is None else y for x, y in zip(parts, ids, strict=True)]
            out.append(first + b"".join(ids))
        return out


def encoder(source: Broadcast) -> PieceEncoder:
    """The worker's encoder for a broadcast vocabulary; kept between tasks of one Python worker."""
    return kept(("encoder", hash(source.value)), lambda: PieceEncoder(source.value))


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read on the driver and broadcast; a vocabulary's size does not grow with the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
