"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles. Two documents link when
their token sets have a Jaccard similarity of at least the threshold. The join
is exact and takes these steps:

0. Census. Each document's set gets a name of 64 bits and a check of 64 more;
   sets whose names clash are named by their checks. Hot tokens, those that a
   share of all documents has, are found: they stand last in every set's order
   and travel with the sets alone, so no task gets the documents of a hot token.
1. Counts. The other tokens of each different set are dealt to buckets, packed
   in binary rows (so a shuffle moves bytes, not a row for each token); each
   bucket counts in how many different sets each token occurs. Equal sets are
   one set.
2. Sets that can link. Tokens found in one set only can't be shared. A set in
   which fewer than threshold * n tokens occur elsewhere links with nothing.
3. Prefixes. A set's tokens stand in the order of their counts, rarest first.
   Two sets that link share k tokens among the first n - need + k of each, and
   the first that they share is among the first n - need + 1. It tells what is
   indexed: a rare token alone; with a frequent one, the prefix is extended and
   combinations of two tokens that begin with it; with a very frequent one,
   combinations of three. Sets with too many combinations take fewer tokens to
   each, and sets whose partners may do so take both.
4. Candidates. Each list of the index first pairs its members with one hub.
   What links by verified pairs is one component, and only members of one list
   that are then in different components are paired. Thus a group of g near
   copies costs g pairs and not g * g, and no link between components is lost.
5. Verification of each pair on its whole sets; then connected components.
6. Numbers of links. All links lie within components. Each component's sets are
   dealt to blocks, and each two blocks meet once: all intersections of their
   sets are counted by inverted lists, and each set's links are added up where
   they are found. So every link counts, but no row is made for a pair.

Nothing is sampled or capped. Tokens are 64-bit hashes of their words, all bits
of which are compared; two sets of a thousand tokens each share a token by
chance alone with a probability of about 5e-14.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshmill.llm.common import among, bucket_of, buckets, cut, discard, heavy_hitters, lean, lean_group, mix, short_batches, spans_hash, text_chunks, U, window_hashes, WORD_BASE, word_hashes
from threshmill.llm.components import components

FLUSH_TOKENS = 1_000_000
#: Buckets that a task deals to at once. If there are more, rows are dealt twice: first to so many, then, many tasks' rows together, to all.
FIRST_BUCKETS = 1 << 14
AGAIN_BYTES = 32 << 20
#: Sets that a token of each class may stand in: alone up to the first, in twos up to the second, else in threes.
CLASSES = (32, 1024)
#: Most tokens of a set that is indexed by combinations of two and of three.
WIDEST = (128, 40)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each document's sorted distinct k-word shingles; fewer words are one shingle, none give an empty set."""
    words, first = word_hashes(raw, offsets, lower)
    all_windows = window_hashes(words, k)
    short = spans_hash(words, first[:-1], first[1:], WORD_BASE) if len(words) else np.zeros(len(first) - 1, U)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            yield np.unique(all_windows[a : b - k + 1])
        else:
            yield short[i : i + 1] if b > a else short[:0]


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    """(name, check) of a set, both signed 64-bit; 0 if it is empty."""
    return struct.unpack("<qq", hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()) if len(tokens) else (0, 0)


def token_bytes(n_buckets: int) -> int:
    """Bytes of a token that travel; its bucket, of a power of two, is its upper bits."""
    return -(-(64 - (n_buckets.bit_length() - 1)) // 8)


def _pack(keys: np.ndarray, tokens: np.ndarray, n_buckets: int) -> bytes:
    """Postings of one bucket, sorted by set: a table of sets with how many tokens follow for each, and the tokens' low bytes."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys)))
    wide = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    low = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, : token_bytes(n_buckets)]
    return struct.pack("<III", len(first), len(tokens), wide) + keys[first].tobytes() + counts.astype(f"<u{wide}").tobytes() + low.tobytes()


def _unpack(blob: bytes, bucket: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, token) of each posting."""
    n, m, wide = struct.unpack_from("<III", blob)
    low = token_bytes(n_buckets)
    counts = np.frombuffer(blob, f"<u{wide}", n, 12 + 8 * n)
    tokens = np.zeros((m, 8), np.uint8)
    tokens[:, :low] = np.frombuffer(blob, np.uint8, low * m, 12 + (8 + wide) * n).reshape(m, low)
    return np.repeat(np.frombuffer(blob, U, n, 12), counts), tokens.view(U).ravel() | U(bucket << 64 - (n_buckets.bit_length() - 1))


def in_buckets(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of sorted hashes, for buckets that have some."""
    bucket = bucket_of(hashes, n_buckets)
    cuts = np.flatnonzero(np.concatenate((np.ones(min(len(bucket), 1), bool), bucket[1:] != bucket[:-1])))
    return zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False)


#: The count that hot tokens get: they stand last in every set, in the order of their hashes.
HOT_COUNT = 0xFFFFFFFF


def _by_set(keys: np.ndarray, tokens: np.ndarray, df: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed (bucket of sets, tokens of its sets with their counts) of postings that are sorted by set."""
    for b, x, y in in_buckets(keys, n_buckets):
        first = np.flatnonzero(np.concatenate(([True], keys[x + 1 : y] != keys[x : y - 1])))
        counts = np.diff(np.append(first, y - x)).astype(np.uint32)
        yield b, struct.pack("<II", len(first), y - x) + keys[x:y][first].tobytes() + counts.tobytes() + tokens[x:y].tobytes() + df[x:y].tobytes()


def _heads(keys: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Packed (bucket of sets, sizes and hot tokens of its sets) of all sets of a flush, sorted by set; a set may have no hot token."""
    ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    for b, x, y in in_buckets(keys, n_buckets):
        yield b, struct.pack("<II", y - x, int(ends[y] - ends[x])) + keys[x:y].tobytes() + sizes[x:y].tobytes() + counts[x:y].astype(np.uint32).tobytes() + tokens[ends[x] : ends[y]].tobytes()


#: Kinds of packed rows: sizes and hot tokens of sets (their buckets are below 0 while postings have the others), postings, counted postings.
HEADS, POSTINGS, COUNTED = 0, 1, 2
BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
CENSUS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("hash", pa.int64())])
SETS = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64())), ("index", pa.list_(pa.struct([("k", pa.int64()), ("most", pa.int32())])))])


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[i] for x in out], f.type) for i, f in enumerate(BLOBS)], schema=BLOBS)


def _read_heads(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, size, number of hot tokens) of each set, and all hot tokens."""
    out: list[list[np.ndarray]] = [[np.zeros(0, U)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], [np.zeros(0, U)]]
    for blob in blobs:
        n, m = struct.unpack_from("<II", blob)
        for x, part in zip(out, (np.frombuffer(blob, U, n, 8), np.frombuffer(blob, np.uint32, n, 8 + 8 * n), np.frombuffer(blob, np.uint32, n, 8 + 12 * n), np.frombuffer(blob, U, m, 8 + 16 * n)), strict=True):
            x.append(part)
    return tuple(map(np.concatenate, out))


def _read_counted(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, token, count) of each posting."""
    out: list[list[np.ndarray]] = [[np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.uint32)]]
    for blob in blobs:
        n, m = struct.unpack_from("<II", blob)
        keys = np.repeat(np.frombuffer(blob, U, n, 8), np.frombuffer(blob, np.uint32, n, 8 + 8 * n))
        for x, part in zip(out, (keys, np.frombuffer(blob, U, m, 8 + 12 * n), np.frombuffer(blob, np.uint32, m, 8 + 12 * n + 8 * m)), strict=True):
            x.append(part)
    return tuple(map(np.concatenate, out))


def _split_again(bucket: int, kind: int, blobs: list[bytes], before: int, n_buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """The same rows, dealt to n_buckets instead of `before`."""
    if kind == HEADS:
        keys, sizes, counts, tokens = _read_heads(blobs)
        order = np.argsort(keys, kind="stable")
        n = counts[order].astype(np.int64)
        starts = (np.cumsum(counts, dtype=np.int64) - counts)[order]
        tokens = tokens[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for b, blob in _heads(keys[order], sizes[order], counts[order], tokens, n_buckets):
            yield -1 - b if bucket < 0 else b, kind, blob
    elif kind == POSTINGS:
        keys, tokens = (np.concatenate(x) for x in zip(*(_unpack(x, bucket, before) for x in blobs), strict=True))
        order = np.lexsort((keys, bucket_of(tokens, n_buckets)))
        keys, tokens = keys[order], tokens[order]
        for b, x, y in in_buckets(tokens, n_buckets):
            yield b, kind, _pack(keys[x:y], tokens[x:y], n_buckets)
    else:
        keys, tokens, df = _read_counted(blobs)
        order = np.argsort(keys, kind="stable")
        for b, blob in _by_set(keys[order], tokens[order], df[order], n_buckets):
            yield b, kind, blob


def _deal_again(batches: Iterator[pa.RecordBatch], before: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and kind: those of one go on together, at most AGAIN_BYTES at a time."""
    held: list[bytes] = []
    now, size = None, 0
    for batch in batches:
        for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
            if held and ((bucket, kind) != now or size >= AGAIN_BYTES):
                yield _rows(list(_split_again(*now, held, before, n_buckets)))
                held, size = [], 0
            now = bucket, kind
            held.append(blob.as_py())
            size += len(held[-1])
    if held:
        yield _rows(list(_split_again(*now, held, before, n_buckets)))


def in_two_levels(dealt: DataFrame, before: int, n_buckets: int) -> DataFrame:
    """Rows dealt to `before` buckets, dealt on to n_buckets, each a power of two, if those are more."""
    if before == n_buckets:
        return dealt
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lean(lambda it: _deal_again(it, before, n_buckets)), "bucket int, kind int, blob binary")


def _census(batches: Iterator[pa.RecordBatch], k: int, share: float) -> Iterator[pa.RecordBatch]:
    """A row for each document: its set's name, check and size. And rows of tokens (hash, n) that a share of the documents of a flush has; hash 0 counts the documents. Equal sets of a flush count once."""
    kept: dict[int, np.ndarray] = {}
    docs = waiting = 0

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(list(kept.values())), return_counts=True) if kept else (np.zeros(0, U), np.zeros(0, np.int64))
        often = counts >= max(4, share * docs)
        kept.clear()
        none = pa.nulls(int(often.sum()) + 1, pa.int64())
        return pa.record_batch([none, none, none, pa.array([docs, *counts[often].tolist()], pa.int64()), pa.array([0, *values[often].view(np.int64).tolist()], pa.int64())], schema=CENSUS)

    for batch in batches:
        ids, names, checks, sizes = batch.column("doc_id"), [], [], []
        for _, raw, offsets in text_chunks(batch.column("text")):
            for tokens in shingle_sets(raw, offsets, k):
                docs += 1
                key, other = set_name(tokens)
                names.append(key)
                checks.append(other)
                sizes.append(len(tokens))
                if len(tokens) and key not in kept:
                    kept[key] = tokens
                    waiting += len(tokens)
            if waiting >= FLUSH_TOKENS:
                yield flush()
                docs = waiting = 0
        yield pa.record_batch([ids, *(pa.array(x, pa.int64()) for x in (names, checks, sizes)), pa.nulls(len(ids), pa.int64())], schema=CENSUS)
    if docs:
        yield flush()


def _deal(batches: Iterator[pa.RecordBatch], k: int, n_buckets: int, hot: np.ndarray, clashes: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """The sets' sizes and hot tokens (buckets below 0) and postings of the other tokens (from 0) of the documents of a partition."""
    kept: list[np.ndarray] = []
    table: dict[int, int] = {}
    waiting = 0

    def flush() -> pa.RecordBatch:
        out: list[tuple[int, int, bytes]] = []
        keys = np.fromiter(table, np.int64, len(table)).view(U)
        counts = np.array([len(x) for x in kept], np.uint32)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        tokens = np.concatenate([kept[i] for i in order.tolist()])
        kept.clear()
        table.clear()
        known = among(tokens, hot)
        # a hot token goes straight to its sets, never to a bucket of its own
        per = np.add.reduceat(known.astype(np.int64), np.cumsum(counts, dtype=np.int64) - counts)
        out += [(-1 - b, HEADS, blob) for b, blob in _heads(keys, counts, per, tokens[known], n_buckets)]
        at = np.repeat(np.arange(len(keys), dtype=np.int32), counts - per)
        tokens = tokens[~known]
        order = np.argsort(bucket_of(tokens, n_buckets).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint64), kind="stable")
        tokens, at = tokens[order], at[order]
        out += [(b, POSTINGS, _pack(keys[at[x:y]], tokens[x:y], n_buckets)) for b, x, y in in_buckets(tokens, n_buckets)]
        return _rows(out)

    for batch in batches:
        for _, raw, offsets in text_chunks(batch.column("text")):
            for tokens in shingle_sets(raw, offsets, k):
                if len(tokens):
                    key, other = set_name(tokens)
                    key = other if key in clashes else key
                    if key not in table:
                        table[key] = len(table)
                        kept.append(tokens)
                        waiting += len(tokens)
            if waiting >= FLUSH_TOKENS:
                waiting = 0
                yield flush()
    if kept:
        yield flush()


def _count(part: pa.Table, n_buckets: int, first_buckets: int) -> pa.Table:
    """Of one bucket: the postings of tokens that two sets or more have, dealt to the sets."""
    bucket = part.column("bucket")[0].as_py()
    blobs = part.column("blob")
    if bucket < 0:
        heads = list(_split_again(0, HEADS, blobs.to_pylist(), n_buckets, first_buckets))
        return pa.Table.from_batches([_rows(heads)])
    keys, tokens = (np.concatenate(x) for x in zip(*(_unpack(x.as_py(), bucket, n_buckets) for x in blobs), strict=True))
    order = np.argsort(tokens)
    ordered = tokens[order]
    same = ordered[1:] == ordered[:-1]
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order = order[again]
    del ordered, same, again
    keys, tokens = keys[order], tokens[order]
    order = np.lexsort((keys, tokens))
    keys, tokens = keys[order], tokens[order]
    df = np.zeros(0, np.int64)
    if len(keys):
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])))
        keys, tokens = keys[new], tokens[new]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        counts = np.diff(np.append(first, len(tokens)))
        df = np.repeat(counts, counts)
        more = df >= 2
        keys, tokens, df = keys[more], tokens[more], df[more]
    order = np.argsort(keys, kind="stable")
    return pa.Table.from_batches([_rows([(b, COUNTED, blob) for b, blob in _by_set(keys[order], tokens[order], np.minimum(df[order], HOT_COUNT - 1).astype(np.uint32), first_buckets)])])


@lru_cache(maxsize=4096)
def _chosen(starts: int, end: int, k: int) -> np.ndarray:
    """All combinations of k places below end whose first is below starts."""
    return np.array([c for c in combinations(range(end), k) if c[0] < starts], np.int64).reshape(-1, k)


def orders_of(n: int, percent: int, widest: tuple[int, int], most: int) -> set[int]:
    """How many tokens a key of a set of n tokens has, where the token's class wants `most`: as its own size allows, and as those of its partners do."""
    def best(size: int) -> int:
        # a partner of a set shares percent of it at least; a key can't have more tokens than that
        return max(k for k in range(1, most + 1) if k == 1 or size <= widest[k - 2] and k <= -(-percent * size // 100))

    edges = [w + d for w in (*widest, *(100 * k // percent for k in range(1, most))) for d in (0, 1)]
    low, high = -(-percent * n // 100), 100 * n // percent
    return {best(m) for m in (n, low, high, *(e for e in edges if low <= e <= high))}


def index_keys(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, classes: tuple[int, int], widest: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, most tokens that a pair whose first common key each is can share) of a set's prefix.

    tokens: those that other sets have too, rarest first; the n - len(tokens) others come before them.
    """
    alone, shared = n - len(tokens), len(tokens)
    single = min(max(n + 1 + -percent * n // 100 - alone, 0), shared)
    keys, most = [], []
    wants = np.searchsorted(classes, df[:single], side="left") + 1
    for want in np.unique(wants).tolist():
        x, y = int(np.searchsorted(wants, want)), int(np.searchsorted(wants, want, side="right"))
        for k in sorted(orders_of(n, percent, widest, want)):
            if k == 1:
                keys.append(tokens[x:y])
                most.append(n - alone - np.arange(x, y))
                continue
            end = min(n + k + -percent * n // 100 - alone, shared)
            places = _chosen(y - x, end - x, k) + x
            name = tokens[places[:, 0]]
            for i in range(1, k):
                name = mix(name * U(0x9E3779B97F4A7C15) + mix(tokens[places[:, i]] + U(i)))
            keys.append(name)
            most.append(n - alone - places[:, -1] + k - 1)
    return (np.concatenate(keys), np.concatenate(most)) if keys else (np.zeros(0, U), np.zeros(0, np.int64))


def _sets(part: pa.Table, percent: int, classes: tuple[int, int], widest: tuple[int, int]) -> pa.Table:
    """Of one bucket of sets: a row for each set that can link, with its index keys."""
    of_kind = {k: [x.as_py() for x, kind in zip(part.column("blob"), part.column("kind").to_pylist(), strict=True) if kind == k] for k in (HEADS, COUNTED)}
    heads, sizes, many, hot_tokens = _read_heads(of_kind[HEADS])
    keys, tok, freq = _read_counted(of_kind[COUNTED])
    del of_kind
    # copies of a set in other tasks brought the same hot tokens
    per = np.repeat(heads, many)
    order = np.lexsort((hot_tokens, per))
    per, hot_tokens = per[order], hot_tokens[order]
    new = np.concatenate((np.ones(min(len(per), 1), bool), (per[1:] != per[:-1]) | (hot_tokens[1:] != hot_tokens[:-1])))
    keys, tok, freq = np.concatenate((keys, per[new])), np.concatenate((tok, hot_tokens[new])), np.concatenate((freq, np.full(int(new.sum()), HOT_COUNT, np.uint32)))
    first, lead = np.unique(heads, return_index=True)
    n_of = sizes[lead].astype(np.int64)
    at = np.searchsorted(first, keys)
    shared = np.bincount(at, minlength=len(first))
    can = 100 * shared >= percent * n_of
    keep = can[at]
    at, tok, freq = at[keep], tok[keep], freq[keep]
    order = np.lexsort((tok, freq, at))
    at, tok, freq = at[order], tok[order], freq[order]
    chosen = np.flatnonzero(can)
    ends = np.searchsorted(at, np.append(chosen, len(first)))
    found = [index_keys(tok[x:y], freq[x:y], int(n_of[i]), percent, classes, widest) for i, x, y in zip(chosen.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    index_ends = np.concatenate(([0], np.cumsum([len(a) for a, _ in found]))).astype(np.int32)
    index_keys_, index_most = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    entries = pa.StructArray.from_arrays([pa.array(index_keys_.view(np.int64), pa.int64()), pa.array(index_most, pa.int32())], names=["k", "most"])
    columns = [pa.array(first[chosen].view(np.int64), pa.int64()), pa.array(n_of[chosen], pa.int32()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tok.view(np.int64), pa.int64())), pa.ListArray.from_arrays(pa.array(index_ends), entries)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, SETS, strict=True)], schema=SETS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of set keys whose sets reach the similarity, with it: an exact intersection of the shared tokens."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("common"), (F.col("na") + F.col("nb") - both).alias("all"))
        .where(100 * F.col("common").cast("long") >= percent * F.col("all").cast("long"))
        .select("a", "b", (F.col("common") / F.col("all")).alias("similarity"))
    )


#: Tokens of a block of a component's sets.
BLOCK_TOKENS = 1 << 18
#: Intersections, and places in lists, that are counted at once.
AT_ONCE = 1 << 22


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all runs of `counts` from `starts`, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _linked(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whether each set from it on links with each of the right ones); a side has its sets' sizes, and the starts of their tokens with the end, and the tokens."""
    (n, starts, tokens), (other_n, other_starts, other_tokens) = left, right
    order = np.argsort(other_tokens, kind="stable")
    ordered, owner = other_tokens[order], np.repeat(np.arange(len(other_n)), np.diff(other_starts))[order]
    low = np.searchsorted(ordered, tokens, side="left")
    many = np.searchsorted(ordered, tokens, side="right") - low
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(many)))[starts]
    x = 0
    while x < len(n):
        y = max(x + 1, min(x + AT_ONCE // len(other_n), int(np.searchsorted(upto, upto[x] + AT_ONCE, side="right")) - 1))
        a, b = starts[x], starts[y]
        row = np.repeat(np.repeat(np.arange(y - x), np.diff(starts[x : y + 1])), many[a:b])
        both = np.bincount(row * len(other_n) + owner[_spans(low[a:b], many[a:b])], minlength=(y - x) * len(other_n)).reshape(y - x, -1)
        yield x, 100 * both >= percent * (n[x:y, None] + other_n[None, :] - both)
        x = y


def _count_links(part: pa.Table, percent: int) -> pa.Table:
    """Of one bucket: for each set of two blocks that meet, the sets of the other block that it links with, and their documents."""
    label, one, two, side, key, n, copies = (part.column(c).to_numpy() for c in ("label", "one", "two", "side", "key", "n", "copies"))
    lists = part.column("tokens").combine_chunks()
    at, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    order = np.lexsort((key, side, two, one, label))
    new = np.any([x[order][1:] != x[order][:-1] for x in (label, one, two)], axis=0)
    sets, documents = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    for rows in np.split(order, np.flatnonzero(new) + 1):
        same = one[rows[0]] == two[rows[0]]
        halves = [rows, rows] if same else [rows[side[rows] == 0], rows[side[rows] == 1]]
        if not all(map(len, halves)):
            continue
        a, b = ((n[x].astype(np.int64), np.concatenate(([0], np.cumsum(at[x + 1] - at[x]))), values[_spans(at[x], at[x + 1] - at[x])]) for x in halves)
        for x, linked in _linked(a, b, percent):
            mine = halves[0][x : x + len(linked)]
            if same:
                linked[np.arange(len(linked)), x + np.arange(len(linked))] = False
            else:
                sets[halves[1]] += linked.sum(axis=0)
                documents[halves[1]] += copies[mine] @ linked
            sets[mine] += linked.sum(axis=1)
            documents[mine] += linked @ copies[halves[1]]
    return pa.table({"key": pa.array(key), "set_links": pa.array(sets), "links": pa.array(documents)})


def link_counts(sets: DataFrame, labels: DataFrame, copies: DataFrame, percent: int, n_buckets: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """(key, set_links, links) of each set of a component: the sets that it links with, and their documents. Each two blocks of a component meet in one task."""
    blocks = labels.join(sets.select("key", "n"), "key").groupBy("label").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    mine = labels.join(blocks, "label").join(copies, "key").withColumn("own", F.pmod("key", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = mine.select("key", "label", "copies", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    dealt = sets.join(met, "key").withColumn("bucket", F.pmod(F.xxhash64("label", "one", "two"), F.lit(n_buckets)))
    counted = dealt.groupBy("bucket").applyInArrow(lean_group(lambda t: _count_links(t, percent)), "key long, set_links long, links long")
    return counted.groupBy("key").agg(F.sum("set_links").alias("set_links"), F.sum("links").alias("links"))


def _fits(n: str, most: str, other_n: str, other_most: str, percent: int) -> F.Column:
    """Whether the sizes of two sets and the places of a common key allow the similarity."""
    shared, total = F.least(most, other_most).cast("long"), F.col(n).cast("long") + F.col(other_n).cast("long")
    return (100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)) & ((100 + percent) * shared >= percent * total)


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def on_lists(entries: DataFrame, lists: DataFrame, long: list[int]) -> DataFrame:
    """Entries with what is known of their list. The longest lists, of which there are few, go to every task, so none of them is one task's."""
    if not long:
        return entries.join(lists, "k")
    far = F.col("k").isin(long)
    return entries.where(~far).join(lists.where(~far), "k").unionByName(entries.where(far).join(F.broadcast(lists.where(far)), "k"))


def useful_entries(index: DataFrame, percent: int, share: float, least: int) -> tuple[DataFrame, list[int]]:
    """Entries of lists with two or more sets, with their list's hub: the set with most tokens left to share; and the lists that hold a share of all entries (at most 1 / share).

    From a set's size and the place of the key follows the largest size that a
    partner may have. Entries that admit no size in their list, or whose size
    no entry of the list admits, are dropped: in a group of near copies of like
    size these are all but the first ones of each prefix.
    """
    sized = index.withColumn("up_to", F.floor(F.col("most").cast("long") * (100 + percent) / percent) - F.col("n"))
    lists = cut(sized.groupBy("k").agg(F.max(F.struct("most", "n", "key")).alias("hub"), F.count("*").alias("c"), F.min("n").alias("low"), F.max("up_to").alias("high")).where("c > 1"))
    total = lists.agg(F.sum("c")).first()[0] or 0
    long = [r.k for r in lists.where(F.col("c") >= max(least, share * total)).select("k").collect()]
    useful = cut(on_lists(sized, lists.select("k", "hub", "low", "high"), long).where("up_to >= low AND n <= high").select("k", "key", "n", "most", "hub"))
    discard(lists)
    return useful, long


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, classes: tuple[int, int] = CLASSES, widest: tuple[int, int] = WIDEST, hot_share: float = 1 / 512, hot_least: int = 2048, first_buckets: int = FIRST_BUCKETS, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), set_links and n_links.

    docs needs doc_id and text; other columns are ignored, whatever their names.
    A null or blank text has the empty set, links with nothing and is its own
    component. A document of fewer than k words has one shingle. Repeated rows
    give repeated rows. A null doc_id keeps its row; its component is the
    smallest known doc_id that it reaches, else null. set_links counts the other
    token sets that a document's set links with, n_links the other documents
    that it links with, copies and repeated rows included. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = 1 << (buckets(spark, least=256) - 1).bit_length()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    census = cut(rows.mapInArrow(lean(lambda it: _census(it, k, hot_share)), "doc_id long, key long, other long, n long, hash long"))
    hot = heavy_hitters(census.where("hash IS NOT NULL").select("hash", "n"), hot_share, hot_least)
    named = census.where("hash IS NULL")
    # names of two different sets: by chance one in 2 ** 65 pairs
    clashes = [r.key for r in named.groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").select("key").collect()]
    members = named.select("doc_id", F.when(F.col("key").isin(clashes), F.col("other")).otherwise(F.col("key")).alias("key") if clashes else F.col("key"), "n")
    one = min(n, first_buckets)
    dealt = rows.select("text").mapInArrow(lean(lambda it: _deal(it, k, one, hot, frozenset(clashes))), "bucket int, kind int, blob binary")
    found = in_two_levels(dealt, one, n).groupBy("bucket").applyInArrow(lean_group(lambda t: _count(t, n, one)), "bucket int, kind int, blob binary")
    sets = cut(in_two_levels(found, one, n).groupBy("bucket").applyInArrow(lean_group(lambda t: _sets(t, percent, classes, widest)), "key long, n int, tokens array<long>, index array<struct<k long, most int>>"))
    index = sets.select("key", "n", F.explode("index").alias("i")).select("key", "n", "i.k", "i.most")
    lists, long = useful_entries(index, percent, hot_share, hot_least)
    sets = sets.select("key", "n", "tokens")
    first = lists.where((F.col("key") != F.col("hub.key")) & _fits("n", "most", "hub.n", "hub.most", percent)).select(*_pair("key", "hub.key")).distinct()
    links = cut(verified(first, sets, percent))
    labels = components(links)
    # lists whose members are not yet in one component: those outside the hub's are paired with the others
    split_lists = lists.join(labels, "key", "left").select("k", "key", "n", "most", F.coalesce("label", "key").alias("label"))
    split = split_lists.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max_by("label", F.struct("most", "n", "key")).alias("main")).where("low <> high").select("k", "main")
    apart = cut(on_lists(split_lists, split, long))
    x, y = apart.where("label <> main").alias("x"), apart.alias("y")
    second = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.label") != F.col("y.label")) & _fits("x.n", "x.most", "y.n", "y.most", percent)).select(*_pair("x.key", "y.key")).distinct()
    rest = cut(verified(second, sets, percent))
    links = links.unionByName(rest)
    if not rest.isEmpty():
        labels = components(links)
    copies = cut(members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    counts = link_counts(sets, labels, copies.select("key", "copies"), percent, n, block)
    keys = copies.join(labels, "key", "left").join(counts, "key", "left").select("key", "least", "copies", F.coalesce("label", "key").alias("label"), F.coalesce("set_links", F.lit(0)).alias("set_links"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keys = cut(keys)
    lowest = keys.groupBy("label").agg(F.min("least").alias("component"))
    classes_of = cut(keys.join(lowest, "label").select("key", "component", "set_links", "n_links", "copies"))
    discard(lists, apart, copies, keys)
    # sets that a share of all documents has are few, and their documents take no part in the shuffle
    documents = members.count()
    many = F.col("copies") >= max(hot_least, hot_share * documents)
    big = [r.key for r in classes_of.where(many).select("key").collect()]
    blank = members.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("set_links"), F.lit(0).cast("long").alias("n_links"))
    out = blank.unionByName(members.where("n > 0").where(~F.col("key").isin(big) if big else F.lit(True)).join(classes_of.where(~many), "key").select("doc_id", "n", "component", "set_links", "n_links"))
    if big:
        out = out.unionByName(members.where(F.col("key").isin(big)).join(F.broadcast(classes_of.where(many)), "key").select("doc_id", "n", "component", "set_links", "n_links"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), "set_links", "n_links")
