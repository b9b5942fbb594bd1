"""Substring dedup by De Bruijn compaction of token k-mers.

The graph's nodes are the runs of k - 1 words of all documents, its edges their
windows of k words (from their first k - 1 words to their last k - 1). An edge
that starts at two places or more is repeated; only those are kept.

1. Nodes and edges, packed. Each node has a minimizer, the smallest hash among
   its s-word runs, the leftmost of equal ones. Neighbouring nodes of a document
   with the same minimizer, and one more on each side, are one posting: the
   minimizer, the source coordinates (document, word) and a print of each node.
   All edges into and out of a node thus meet in the bucket of its minimizer.
2. Repeats and degrees. In a bucket, an edge is a pair of neighbouring nodes; its
   multiplicity is the number of places that it starts at. A node with one
   repeated edge in and one out doesn't branch. Edges that meet at such nodes are
   pieces of paths. An edge whose two nodes lie in different buckets ends a piece
   in one and begins a piece in the other.
3. Compaction through Spark joins. Pieces are joined where one ends with the
   edge that another begins with, then each finds the head of its chain by
   doubling joins: whole nonbranching paths, a ring's pieces too.
4. Source coordinates. Each piece's places come back to their documents with
   their path. The words at these coordinates are hashed again and must give the
   nodes' prints; then they are removed, judged on the input alone. Neighbouring
   pieces of one path are one span.

No pairs of occurrences are made: a passage in n documents costs n postings.
Runs of s words that a share of all documents has are found first. A node
prefers minimizers that aren't among them, so phrases in many contexts are dealt
by their contexts. Nodes that hold nothing else stand inside passages that many
documents share: their postings are alike, so a task sends each different one
once, with its number, as a document of its own, and the documents' coordinates
come to its pieces in a last join. A path ends where such a passage does.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshmill.llm.common import among, bucket_of, buckets, cut, discard, heavy_hitters, lean, lean_group, mix, short_batches, spans_hash, text_chunks, U, window_hashes, WORD_BASE, word_hashes
from threshmill.llm.components import chains

FLUSH_NODES = 1_000_000
#: Bytes of a node's print that travel; an edge has two.
PRINT = 5
PRINT_MASK = U((1 << 8 * PRINT) - 1)
#: Places in one row of a piece; a piece that stands at more has more rows.
PLACES = 1 << 14
OPEN_LEFT, OPEN_RIGHT = 1, 2
BLOBS = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("blob", pa.binary())])
#: Kinds of rows that buckets give: pieces of paths, places of pieces in documents, the same in shared runs, coordinates of shared runs.
PIECE, PLACED, SHARED, COORDINATES = 0, 1, 2, 3
FOUND = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("first_edge", pa.int64()), ("last_edge", pa.int64()), ("edges", pa.int32()), ("blob", pa.binary())])
#: A place: document, its first word, edges, times that the rarest edge occurs, sum of the nodes' prints.
PLACE = np.dtype([("key", "<i8"), ("start", "<u4"), ("edges", "<u4"), ("times", "<u4"), ("check", "<u4")])
#: The same in the row of a document, with its path.
SPAN = np.dtype([("path", "<i8"), ("start", "<u4"), ("edges", "<u4"), ("times", "<u4"), ("check", "<u4")])
COORDINATE = np.dtype([("key", "<i8"), ("start", "<u4")])
ROWS = pa.schema([("row_key", pa.int64()), ("spans", pa.binary())])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    step, least = 1, values
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - step :]) if width > step else least


class Postings:
    """Runs of nodes with the prints of their nodes, one after the other."""

    FIELDS = ("seed", "key", "start", "nodes", "place", "flags", "rows")
    TYPES = (U, np.int64, np.uint32, np.uint16, np.uint16, np.uint8, np.uint32)

    def __init__(self, columns: dict[str, np.ndarray], prints: np.ndarray) -> None:
        self.columns, self.prints = columns, prints

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.columns["seed"])

    @property
    def begin(self) -> np.ndarray:
        """The first print of each posting, with the end."""
        return np.concatenate(([0], np.cumsum(self.columns["nodes"], dtype=np.int64)))

    def take(self, order: np.ndarray) -> Postings:
        """Those postings, in that order (numbers or a mask)."""
        if order.dtype == bool:
            order = np.flatnonzero(order)
        n = self.columns["nodes"][order].astype(np.int64)
        shift = self.begin[:-1][order] - (np.cumsum(n) - n)
        return Postings({f: x[order] for f, x in self.columns.items()}, self.prints[np.repeat(shift, n) + np.arange(int(n.sum()))])

    def pack(self) -> bytes:
        low = np.ascontiguousarray(self.prints).view(np.uint8).reshape(-1, 8)[:, :PRINT]
        return struct.pack("<II", len(self), len(self.prints)) + b"".join(self.columns[f].astype(t).tobytes() for f, t in zip(self.FIELDS, self.TYPES, strict=True)) + low.tobytes()

    @staticmethod
    def unpack(blobs: list[bytes]) -> Postings:
        columns: dict[str, list] = {f: [] for f in Postings.FIELDS}
        prints = []
        for blob in blobs:
            n, m = struct.unpack_from("<II", blob)
            at = 8
            for f, t in zip(Postings.FIELDS, Postings.TYPES, strict=True):
                columns[f].append(np.frombuffer(blob, t, n, at))
                at += n * np.dtype(t).itemsize
            wide = np.zeros((m, 8), np.uint8)
            wide[:, :PRINT] = np.frombuffer(blob, np.uint8, PRINT * m, at).reshape(m, PRINT)
            prints.append(wide.view(U).ravel())
        return Postings({f: np.concatenate(x) for f, x in columns.items()}, np.concatenate(prints))

    @staticmethod
    def concatenate(some: list[Postings]) -> Postings:
        return Postings({f: np.concatenate([p.columns[f] for p in some]) for f in Postings.FIELDS}, np.concatenate([p.prints for p in some]))


def node_prints(words: np.ndarray, k: int) -> np.ndarray:
    return window_hashes(words, k - 1) & PRINT_MASK


def postings(words: np.ndarray, first: np.ndarray, keys: np.ndarray, k: int, s: int, hot: np.ndarray) -> tuple[Postings, np.ndarray, np.ndarray]:
    """The postings of some documents, which of them lie inside shared passages, and the number of each one's document."""
    length = np.diff(first)
    nodes = len(words) - k + 2
    none = Postings({f: np.zeros(0, t) for f, t in zip(Postings.FIELDS, Postings.TYPES, strict=True)}, np.zeros(0, U)), np.zeros(0, bool), np.zeros(0, np.int64)
    if nodes <= 0 or not (length >= k).any():
        return none
    seeds = window_hashes(words, s)
    # an order that doesn't depend on where a run stands: hot ones last, then 31 bits of the hash, then the leftmost
    rank = seeds >> U(33) | among(seeds, hot).astype(U) << U(31)
    least = sliding_min(rank << U(32) | np.arange(len(seeds), dtype=U), k - s)[:nodes]
    doc = np.repeat(np.arange(len(length)), length)[:nodes]
    at = np.arange(nodes)
    valid = np.flatnonzero((at + k - 1 <= first[doc + 1]) & (length[doc] >= k))
    where, own = (least[valid] & U(0xFFFFFFFF)).astype(np.int64), doc[valid]
    inside = (least[valid] >> U(63)).astype(bool)
    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 0) | (np.diff(own) != 0) | (np.diff(valid) != 1))))
    a, b = valid[cuts], valid[np.append(cuts[1:], len(valid)) - 1]
    owner, shared, mark = own[cuts], inside[cuts], where[cuts]
    # one more node on each side, if the document has it; a shared run takes none from outside
    same = owner[1:] == owner[:-1]
    left = np.concatenate(([False], same & (~shared[1:] | shared[:-1])))
    right = np.concatenate((same & (~shared[:-1] | shared[1:]), [False]))
    a, b = a - left, b + right
    keep = b > a
    a, b, owner, shared, mark, left, right = (x[keep] for x in (a, b, owner, shared, mark, left, right))
    if not len(a):
        return none
    n = b - a + 1
    prints = node_prints(words, k)[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    columns = {"seed": seeds[mark], "key": keys[owner], "start": a - first[owner], "nodes": n, "place": mark - a + 1, "flags": left * OPEN_LEFT + right * OPEN_RIGHT, "rows": np.ones(len(a), np.int64)}
    return Postings({f: columns[f].astype(t) for f, t in zip(Postings.FIELDS, Postings.TYPES, strict=True)}, prints), shared, owner


def _heavy(batches: Iterator[pa.RecordBatch], s: int, share: float) -> Iterator[pa.RecordBatch]:
    """Runs of s words that stand as often as a share of the documents of a flush, with their count in it; one row with hash 0 says how many documents there were."""
    kept: list[np.ndarray] = []
    docs = waiting = 0

    def flush() -> pa.RecordBatch:
        seen = np.sort(np.concatenate(kept)) if kept else np.zeros(0, U)
        kept.clear()
        cuts = np.flatnonzero(np.concatenate((np.ones(min(len(seen), 1), bool), seen[1:] != seen[:-1])))
        counts = np.diff(np.append(cuts, len(seen)))
        often = counts >= max(4, share * docs)
        return pa.record_batch([pa.array([0, *seen[cuts[often]].view(np.int64).tolist()], pa.int64()), pa.array([docs, *counts[often].tolist()], pa.int64())], names=["hash", "n"])

    for batch in batches:
        for _, raw, offsets in text_chunks(batch.column("text")):
            words, first = word_hashes(raw, offsets)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            if len(words) >= s:
                kept.append(window_hashes(words, s)[doc[: len(words) - s + 1] == doc[s - 1 :]])
                waiting += len(kept[-1])
            docs += len(offsets) - 1
            if waiting >= FLUSH_NODES:
                yield flush()
                docs = waiting = 0
    if docs:
        yield flush()


def _deal(batches: Iterator[pa.RecordBatch], k: int, s: int, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed postings by bucket; below 0, coordinates of shared runs."""
    held: list[Postings] = []
    held_shared: list[np.ndarray] = []
    times: dict[int, int] = {}
    waiting = 0

    def flush() -> pa.RecordBatch:
        every, shared = Postings.concatenate(held), np.concatenate(held_shared)
        held.clear()
        held_shared.clear()
        # equal rows are one document that counts as often
        every.columns["rows"] = np.array([times[x] for x in every.key.tolist()], np.uint32)
        times.clear()
        out: list[tuple[int, int, bytes]] = []
        if shared.any():
            mine, every = every.take(shared), every.take(~shared)
            name = spans_hash(mine.prints, mine.begin[:-1], mine.begin[1:], WORD_BASE) ^ mix(mine.seed + (mine.place.astype(U) << U(8)) + mine.flags.astype(U))
            order = np.argsort(name, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
            ends = np.append(cuts[1:], len(order))
            rows = np.add.reduceat(mine.rows[order].astype(np.int64), cuts)
            where = np.zeros(len(order), COORDINATE)
            where["key"], where["start"] = mine.key[order], mine.start[order]
            names = name[order][cuts]
            for x, y, c, b in zip(cuts.tolist(), ends.tolist(), names.view(np.int64).tolist(), bucket_of(mix(names), n_buckets).tolist(), strict=True):
                out.append((-1 - b, c, where[x:y].tobytes()))
            once = mine.take(order[cuts])
            once.columns |= {"key": names.view(np.int64), "start": np.zeros(len(cuts), np.uint32), "rows": rows.astype(np.uint32), "flags": once.flags | 4}
            every = Postings.concatenate([every, once])
        # minimizers are small hashes; mixed again, they fall evenly
        bucket = bucket_of(mix(every.seed), n_buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        every, bucket = every.take(order), bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        begin = every.begin
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
            part = Postings({f: v[x:y] for f, v in every.columns.items()}, every.prints[begin[x] : begin[y]])
            out.append((int(bucket[x]), 0, part.pack()))
        return pa.record_batch([pa.array([x[i] for x in out], f.type) for i, f in enumerate(BLOBS)], schema=BLOBS)

    for batch in batches:
        row_keys = batch.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64)
        for row, raw, offsets in text_chunks(batch.column("text")):
            words, first = word_hashes(raw, offsets)
            own = row_keys[row : row + len(offsets) - 1]
            found, shared, owner = postings(words, first, own, k, s, hot)
            if len(found):
                # only the first of equal rows brings its postings
                fresh = np.zeros(len(own), bool)
                for i, key in enumerate(own.tolist()):
                    fresh[i] = key not in times
                    times[key] = times.get(key, 0) + 1
                if not fresh.all():
                    found, shared = found.take(fresh[owner]), shared[fresh[owner]]
                held.append(found)
                held_shared.append(shared)
                waiting += len(found.prints)
            if waiting >= FLUSH_NODES:
                waiting = 0
                yield flush()
    if held:
        yield flush()


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of each value among the different ones, the first place of each, how many there are)."""
    order = np.argsort(values, kind="stable")
    new = np.concatenate((np.ones(min(len(values), 1), bool), values[order][1:] != values[order][:-1]))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new], int(new.sum())


def _chunked(kind: int, ids: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows of up to PLACES places of one piece; ids are sorted."""
    number = np.arange(len(ids))
    begins = np.flatnonzero(np.concatenate((np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1])))
    inner = number - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    cuts = np.flatnonzero(inner % PLACES == 0)
    return _rows(kind, ids[cuts], blob=packed(places, cuts))


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values from each cut to the next as one binary."""
    offsets = np.append(cuts, len(values)).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _rows(kind: int, ids: np.ndarray, first: pa.Array | None = None, last: pa.Array | None = None, edges: np.ndarray | None = None, blob: pa.Array | None = None) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(ids, pa.int64()), *(x if x is not None else pa.nulls(n, pa.int64()) for x in (first, last)), pa.array(edges, pa.int32()) if edges is not None else pa.nulls(n, pa.int32()), blob if blob is not None else pa.nulls(n, pa.binary())]
    return pa.record_batch(columns, schema=FOUND)


def _repeated(part: pa.Table) -> pa.Table:
    """Of one bucket: pieces of paths with the edges they begin and end with, and their places."""
    nothing = pa.table([pa.array([], f.type) for f in FOUND], schema=FOUND)
    if part.column("bucket")[0].as_py() < 0:
        blob = part.column("blob").combine_chunks()
        return pa.Table.from_batches([_rows(COORDINATES, part.column("id").to_numpy(), blob=blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob)])
    every = Postings.unpack([x.as_py() for x in part.column("blob")])
    rank, _, n = _ranks(every.seed)
    every = every.take(np.bincount(rank, every.rows, n)[rank] >= 2)
    if not len(every):
        return nothing
    nodes = every.nodes.astype(np.int64)
    posting = np.repeat(np.arange(len(every)), nodes)
    step = np.arange(len(posting)) - np.repeat(every.begin[:-1], nodes)
    node = mix(every.prints | (every.place[posting].astype(np.int64) - step + 1).astype(U) << U(8 * PRINT)) ^ every.seed[posting]
    tail = np.flatnonzero(step < nodes[posting] - 1)  # each edge by the node that it leaves
    rows = every.rows[posting[tail]].astype(np.int64)
    edge, lead, n = _ranks(mix(node[tail] * U(WORD_BASE) + mix(node[tail + 1])))
    times = np.bincount(edge, rows, n).astype(np.int64)
    again = times >= 2
    if not again.any():
        return nothing
    # the different repeated edges, numbered; at least one place of each
    number = np.cumsum(again) - 1
    place = tail[lead[again]]
    own = posting[place]
    from_node, to_node = node[place], node[place + 1]
    last = step[place] == nodes[own] - 2
    open_left = (step[place] == 0) & (every.flags[own] & OPEN_LEFT > 0)
    open_right = last & (every.flags[own] & OPEN_RIGHT > 0)
    names = mix(every.prints[place] * U(WORD_BASE) + mix(every.prints[place + 1]))
    m = len(place)
    # nodes of this bucket with one edge in and one out
    ids, _, n_ids = _ranks(np.concatenate((to_node, from_node)))
    into, out_of = ids[:m], ids[m:]
    within_in, within_out = ~open_right, ~open_left
    passes = (np.bincount(into[within_in], minlength=n_ids) == 1) & (np.bincount(out_of[within_out], minlength=n_ids) == 1)
    enters, leaves = np.full(n_ids, -1), np.full(n_ids, -1)
    enters[into[within_in]] = np.flatnonzero(within_in)
    leaves[out_of[within_out]] = np.flatnonzero(within_out)
    through = np.flatnonzero(passes)
    before, after = np.arange(m), np.arange(m)
    before[leaves[through]], after[enters[through]] = enters[through], leaves[through]
    linked = np.zeros(m, bool)
    linked[leaves[through]] = True
    # edges that follow each other have the same minimizer ever further to the left, so they are no more than a node's words
    head, end = before, after
    for _ in range((int(nodes.max()) + int(every.place.max())).bit_length()):
        head, end = head[head], end[end]
    heads = np.flatnonzero(head == np.arange(m))
    piece_id = mix(from_node ^ mix(to_node)).view(np.int64)
    first_edge = pa.array(names[heads].view(np.int64), mask=~open_left[heads])
    last_edge = pa.array(names[end[heads]].view(np.int64), mask=~open_right[end[heads]])
    out = [_rows(PIECE, piece_id[heads], first_edge, last_edge, np.bincount(head, minlength=m)[heads])]
    # places: neighbouring repeated edges of a posting in one piece
    hit = again[edge]
    here, which, often = tail[hit], number[edge[hit]], times[edge[hit]]
    whose = head[which]
    joined = (here[1:] == here[:-1] + 1) & (posting[here[1:]] == posting[here[:-1]]) & linked[which[1:]] & (before[which[1:]] == which[:-1])
    begins = np.flatnonzero(np.concatenate(([True], ~joined)))
    count = np.diff(np.append(begins, len(here)))
    total = np.concatenate((np.zeros(1, U), np.cumsum(every.prints, dtype=U)))
    places = np.zeros(len(begins), PLACE)
    at = here[begins]
    places["key"], places["start"], places["edges"] = every.key[posting[at]], every.start[posting[at]] + step[at], count
    places["times"] = np.minimum(np.minimum.reduceat(often, begins), 0xFFFFFFFF)
    places["check"] = (total[at + count + 1] - total[at]) & U(0xFFFFFFFF)
    order = np.lexsort((places["key"], whose[begins]))
    places, mine, shared = places[order], piece_id[whose[begins]][order], (every.flags[posting[at]] & 4 > 0)[order]
    # rows that are equal came from several tasks
    new = np.concatenate(([True], (places[1:] != places[:-1]) | (mine[1:] != mine[:-1])))
    places, mine, shared = places[new], mine[new], shared[new]
    out += [_chunked(PLACED, mine[~shared], places[~shared]), _chunked(SHARED, mine[shared], places[shared])]
    return pa.Table.from_batches(out)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, places of a piece) as rows (document, its places with their paths)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("blob")).to_numpy(zero_copy_only=False) // PLACE.itemsize
        places = np.frombuffer(b"".join(batch.column("blob").to_pylist()), PLACE)
        path = np.repeat(batch.column("path").to_numpy(zero_copy_only=False), sizes)
        yield _spans(places["key"], path, places)


def _spans(key: np.ndarray, path: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    spans = np.zeros(len(order), SPAN)
    spans["path"] = path[order]
    for f in ("start", "edges", "times", "check"):
        spans[f] = places[f][order]
    key = key[order]
    cuts = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return pa.record_batch([pa.array(key[cuts], pa.int64()), packed(spans, cuts)], schema=ROWS)


def _at_coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (spans of a shared run, coordinates of it) as rows of the documents there."""
    for batch in batches:
        keys, all_spans = [np.zeros(0, np.int64)], [np.zeros(0, SPAN)]
        for run, where in zip(batch.column("spans").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            spans, at = np.frombuffer(run, SPAN), np.frombuffer(where, COORDINATE)
            moved = np.tile(spans, len(at))
            moved["start"] += np.repeat(at["start"], len(spans))
            keys.append(np.repeat(at["key"], len(spans)))
            all_spans.append(moved)
        key, spans = np.concatenate(keys), np.concatenate(all_spans)
        yield _spans(key, spans["path"], spans)


def paths(spans: np.ndarray) -> np.ndarray:
    """The places of one document as spans: those of one path that share an edge are one."""
    if len(spans) < 2:
        return spans
    spans = np.sort(spans, order=["start", "edges"])
    end = np.maximum.accumulate(spans["start"].astype(np.int64) + spans["edges"])
    begins = np.flatnonzero(np.concatenate(([True], (spans["path"][1:] != spans["path"][:-1]) | (spans["start"][1:] >= end[:-1]))))
    out = spans[begins].copy()
    out["times"] = np.minimum.reduceat(spans["times"], begins)
    out["edges"] = np.append(end[begins[1:] - 1], end[-1]) - out["start"]
    return out


def _verified(texts: pa.Array, spans: list[list[bytes] | None], k: int) -> dict[int, np.ndarray]:
    """By row, the places whose words, hashed again, give the prints of the path's nodes there."""
    rows = [i for i, x in enumerate(spans) if x]
    out: dict[int, np.ndarray] = {}
    if not rows:
        return out
    for row, raw, offsets in text_chunks(texts.take(pa.array(rows, pa.int64()))):
        words, first = word_hashes(raw, offsets)
        prints = node_prints(words, k) if len(words) >= k - 1 else np.zeros(0, U)
        total = np.concatenate((np.zeros(1, U), np.cumsum(prints, dtype=U)))
        for j in range(len(offsets) - 1):
            at = rows[row + j]
            found = np.frombuffer(b"".join(spans[at]), SPAN)
            a, n = found["start"].astype(np.int64), found["edges"].astype(np.int64)
            fits = a + n + k - 1 <= first[j + 1] - first[j]
            found, a, n = found[fits], a[fits] + first[j], n[fits]
            out[at] = found[(total[a + n + 1] - total[a]) & U(0xFFFFFFFF) == found["check"]]
    return out


def _strip(batches: Iterator[pa.RecordBatch], k: int, rewrite: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        verified = _verified(texts, batch.column("__spans").to_pylist(), k)
        n_words, n_removed, digests, spans, kept_texts = [], [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            words = text.encode().split() if text is not None else []
            found = paths(verified.get(i, np.zeros(0, SPAN)))
            if len(found):
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, found["start"], 1)
                np.add.at(step, found["start"].astype(np.int64) + found["edges"] + k - 1, -1)
                stays = np.cumsum(step[:-1]) == 0
                kept = [w for w, x in zip(words, stays.tolist(), strict=True) if x]
            else:
                kept = words
            body = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(body).hexdigest())
            spans.append([{"start": a, "words": n + k - 1, "times": t, "path": p} for p, a, n, t in zip(*(found[f].tolist() for f in ("path", "start", "edges", "times")), strict=True)])
            if rewrite:
                kept_texts.append(text if len(kept) == len(words) else body.decode())
        out = {name: batch.column(name) for name in batch.schema.names if name not in ("__spans", *([] if rewrite else ["text"]))}
        if rewrite:
            out["text"] = pa.array(kept_texts, pa.string())
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        out["paths"] = pa.array(spans, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "words", "times", "path")])))
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def compacted(pieces: DataFrame) -> DataFrame:
    """(id, path) of the pieces that others follow or go before; pieces has id, first_edge and last_edge, null where a piece can't go on. The path's name is its first piece's id."""
    ends = pieces.where("last_edge IS NOT NULL").groupBy(F.col("last_edge").alias("edge")).agg(F.min("id").alias("before"))
    begins = pieces.where("first_edge IS NOT NULL").groupBy(F.col("first_edge").alias("edge")).agg(F.min("id").alias("id"))
    links = cut(begins.join(ends, "edge").where("id <> before").select("id", "before"))
    return chains(links).select("id", F.col("head").alias("path"))


def remove_repeats(docs: DataFrame, k: int = 35, seed_words: int = 8, carry: tuple[str, ...] = (), rewrite: bool = True, hot_share: float = 1 / 512, hot_least: int = 2048) -> DataFrame:
    """Each document without the words under any k-word window that also starts elsewhere.

    Returns doc_id, the columns named in carry, text (with rewrite: kept words
    joined by one space, or the text as it was if nothing went), n_words,
    n_removed, kept_sha256 and paths (first word, words, how often its rarest
    window occurs, and the path's name, of each span). Other columns of docs are
    ignored, whatever their names. k is 2 or more.

    A null text has no words; its text stays null. Fewer than k words are never
    removed. Equal rows count as different places, so all their windows go. A
    null doc_id is a document like any other. An empty table gives no rows.
    """
    if k < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    short_batches(spark)
    n = buckets(spark, per_partition=4)
    text = F.col("text").cast("string")
    keyed = docs.select(F.xxhash64("doc_id", text).alias("row_key"), "doc_id", text.alias("text"), *[c for c in carry if c not in ("doc_id", "text")])
    s = min(seed_words, k - 1)
    hot = heavy_hitters(docs.select(text.alias("text")).mapInArrow(lean(lambda it: _heavy(it, s, hot_share)), "hash long, n long"), hot_share, hot_least)
    found = cut(
        keyed.select("row_key", "text").mapInArrow(lean(lambda it: _deal(it, k, s, n, hot)), "bucket int, id long, blob binary")
        .groupBy("bucket").applyInArrow(lean_group(_repeated), "kind int, id long, first_edge long, last_edge long, edges int, blob binary")
    )
    of_path = compacted(found.where(F.col("kind") == PIECE).select("id", "first_edge", "last_edge"))
    placed = found.where(F.col("kind").isin(PLACED, SHARED)).select("kind", "id", "blob").join(of_path, "id", "left").select("kind", F.coalesce("path", "id").alias("path"), "blob")
    spans = placed.where(F.col("kind") == PLACED).select("path", "blob").mapInArrow(lean(_by_document), "row_key long, spans binary")
    if not found.where(F.col("kind") == COORDINATES).isEmpty():
        runs = placed.where(F.col("kind") == SHARED).select("path", "blob").mapInArrow(lean(_by_document), "row_key long, spans binary")
        where = found.where(F.col("kind") == COORDINATES).select(F.col("id").alias("row_key"), "blob")
        spans = spans.unionByName(where.join(runs, "row_key").select("spans", "blob").mapInArrow(lean(_at_coordinates), "row_key long, spans binary"))
    spans = spans.groupBy("row_key").agg(F.collect_list("spans").alias("__spans"))
    joined = keyed.join(spans.hint("shuffle_hash"), "row_key", "left").drop("row_key")
    fields = [f for f in joined.schema.fields if f.name not in ("__spans", *([] if rewrite else ["text"]))]
    fields += [T.StructField(x, T.LongType()) for x in ("n_words", "n_removed")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("paths", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "words", "times", "path")])))]
    return joined.mapInArrow(lean(lambda it: _strip(it, k, rewrite)), T.StructType(fields))
