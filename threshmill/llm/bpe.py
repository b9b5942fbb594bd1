"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition's texts are read in runs of about CHUNK_CHARS characters, so that
memory is bounded whatever the partition's size. The words of a run that aren't
known yet are encoded together: an index maps each pair of neighbouring symbols
to all its positions in them, active ranks are applied in ascending order, and
each merge updates the lists of the pairs it touches. A word's ids are kept in a
bounded table, so a frequent word is encoded once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshmill.llm.common import lean, short_batches

#: Fixed value of the format: how byte-level BPE splits a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed values of the format: the parts of a tokenizer file that this codec implements, as the library writes them.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
WORDS_KEPT = 400_000
CHUNK_CHARS = 1 << 20


def byte_symbols() -> dict[str, int]:
    """The byte that each printable stand-in of the vocabulary's format means: visible Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def unlike(spec: dict) -> list[str]:
    """What a tokenizer file asks for that this codec doesn't do; an option that the file leaves out has the listed value."""
    out = [f"{name} is set" for name in ("normalizer", "post_processor") if spec.get(name) and spec[name].get("type") != "ByteLevel"]
    tokens = [(f"added token {t['content']!r}", t, ADDED) for t in spec.get("added_tokens", ())]
    for name, got, want in [("pre_tokenizer", spec.get("pre_tokenizer") or {"type": None}, PRE_TOKENIZER), ("model", spec["model"], MODEL), *tokens]:
        out += [f"{name}: {k} is {got[k]!r}" for k, v in want.items() if k in got and got[k] != v]
    affixes = ("continuing_subword_prefix", "end_of_word_suffix")
    return out + [f"model: {k} is {spec['model'][k]!r}" for k in affixes if spec["model"].get(k)]


class Codec:
    """A tokenizer read from a tokenizers-library file; ValueError if the file asks for anything that this codec doesn't do."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if unlike(spec):
            raise ValueError(f"{path}: " + "; ".join(unlike(spec)))
        vocab, stand = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(stand[c] for c in token) if all(c in stand for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(stand.items(), key=lambda x: x[1])], np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        total = int(length.sum())
        ends = np.cumsum(length)
        first = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        symbols: list[int] = first.tolist()
        after = np.arange(1, total + 1)
        after[ends[length > 0] - 1] = -1
        before = np.arange(-1, total - 1)
        before[(ends - length)[length > 0]] = -1
        inner = np.flatnonzero(after >= 0)
        code = first[inner] << 32 | first[inner + 1]
        order = np.argsort(code, kind="stable")
        at, code = inner[order], code[order]
        # words of one byte have no pair: then there are no runs of equal pairs either
        edges = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True]))) if len(code) else np.zeros(1, np.int64)
        merges = self.merges
        index: dict[int, list[int]] = {}
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            pair = int(code[x])
            if pair in merges:
                index[pair] = at[x:y].tolist()
        right, left = after.tolist(), before.tolist()
        active = [(merges[p][0], p) for p in index]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            places = index.pop(pair, None)
            if places is None:
                continue
            places.sort()
            a, b, new = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
            for i in places:
                j = right[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -1
                k = right[i] = right[j]
                right[j] = -1
                if k >= 0:
                    left[k] = i
                    made = new << 32 | symbols[k]
                    if made in merges:
                        if made in index:
                            index[made].append(i)
                        else:
                            index[made] = [i]
                            heapq.heappush(active, (merges[made][0], made))
                h = left[i]
                if h >= 0:
                    made = symbols[h] << 32 | new
                    if made in merges:
                        if made in index:
                            index[made].append(h)
                        else:
                            index[made] = [h]
                            heapq.heappush(active, (merges[made][0], made))
        out = np.array(symbols, np.int64)
        alive = out >= 0
        ids = out[alive].astype("<u4").tobytes()
        stop = 4 * np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]
        return [ids[x:y] for x, y in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]

    def pieces(self, text: str) -> list[str]:
        """The words of a text between special tokens, and those tokens."""
        if self.cut is None or not self.cut.search(text):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, as bytes; a null is empty."""
        split = [self.pieces(t) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = set().union(*split)
        for word in [w for w in new if w in self.special]:
            self.known[word] = self.special[word].to_bytes(4, "little")
            new.discard(word)
        if new:
            words = list(new)
            self.known.update(zip(words, self.encode_words(words), strict=True))
        look = self.known.__getitem__
        return [b"".join(map(look, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Read once in each process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """Whole texts in runs of about so many characters."""
    some: list[str | None] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t or "")
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def bpe_round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Each whole text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with with_ids).

    Strings of the file's special tokens become those tokens, as the file's own
    library does by default; none are added. A null text is empty. Repeated
    rows give repeated rows, an empty table none; other columns are ignored.
    """
    short_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            n, ids_hash, text_hash, all_ids = [], [], [], []
            for some in chunks(batch.column("text").to_pylist()):
                for ids in own.encode(some):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(rows), schema)
