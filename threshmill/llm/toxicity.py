"""Toxicity by nearest labelled examples.

Examples and texts are TF-IDF vectors over all terms (stems of words) of the
examples, each term weighted by its correlation with the label (the root of its
chi-squared a document); similarity is their exact cosine. An inverted index
holds the examples' weights in blocks of examples, with the largest weight of
each term in each block; blocks are searched by falling upper bound until no
other block can hold a nearer example, so the neighbours are exact. Votes are
weighted by nearness; a monotone map fitted on the examples, each against all
others, turns votes into probabilities at the labels' true rate. The nearest
examples are returned as evidence.

The classifier is fitted on a bounded sample: `per_class` learnable labelled
documents of each label, those with the smallest hashes of their doc_id. Every
whole text is scored. Labels, language, source and doc_id are never inputs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threshmill.llm.common import lean, short_batches

PER_CLASS = 2048
#: No term's chi-squared counts as less, so that none is without weight.
LEAST_CHI2 = 0.01
NEIGHBOURS = 15
BLOCK = 32
#: Blocks that are searched first; those of the rest whose bound is high enough for a neighbour are then searched together.
STEP = 8
#: Terms that at least this share of the examples has are also kept as full rows.
DENSE_SHARE = 1 / 16
EVIDENCE = 3
#: Words that begin alike are one term; the length was chosen by five-fold cross-validation on learnable documents.
STEM = 8
#: Texts that are searched for together.
TEXTS = 32
#: ASCII bytes that are neither letters nor digits become spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The stems of all lower-cased runs of letters, digits and non-ASCII bytes: their first STEM bytes."""
    return [w[:STEM] for w in text.lower().encode("utf-8", "replace").translate(TERM_BYTES).split()] if text else []


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0] .. end[0] - 1, start[1] .. end[1] - 1 and so on."""
    n = end - start
    return np.repeat(end - np.cumsum(n), n) + np.arange(n.sum())


@dataclass
class Index:
    """Block-max inverted index of unit TF-IDF vectors. A cell is a term in a block that has it; cells and postings are sorted by term and block."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray  # times the term's correlation with the label
    ids: list[int]
    labels: np.ndarray
    blocks: int
    first: np.ndarray  # of each term, its first cell, with the end
    cell_start: np.ndarray  # first posting, with the end
    posting: np.ndarray  # example
    weight: np.ndarray
    row: np.ndarray  # of each term, its full row or -1
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    empty_score: float = 0.0
    prior: float = 0.5
    # what fill makes of the rest
    cell_block: np.ndarray = field(init=False, repr=False)
    cell_most: np.ndarray = field(init=False, repr=False)  # largest weight
    rows: np.ndarray = field(init=False, repr=False)  # (row, example): weights of the frequent terms
    row_most: np.ndarray = field(init=False, repr=False)  # (row, block): their largest weights

    @property
    def example(self) -> np.ndarray:
        """Of each posting, its place in the block."""
        return self.posting % BLOCK

    @property
    def bounds(self) -> np.ndarray:
        """(term, block): largest weight, as a full table."""
        out = np.zeros((len(self.vocabulary), self.blocks))
        out[np.repeat(np.arange(len(out)), np.diff(self.first)), self.cell_block] = self.cell_most
        return out

    @property
    def begin(self) -> np.ndarray:
        """(term, block): first posting, as a full table with an end for each term."""
        at = np.arange(len(self.vocabulary))[:, None] * self.blocks + np.arange(self.blocks + 1)
        cells = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.first)) * self.blocks + self.cell_block
        return self.cell_start[np.searchsorted(cells, at)]

    def __getstate__(self) -> dict:
        """Without what follows from the rest: an index travels to every task."""
        out = {k: v for k, v in self.__dict__.items() if k not in ("vocabulary", "cell_block", "cell_most", "rows", "row_most")}
        return out | {"terms": zlib.compress(b"\n".join(self.vocabulary), 1)}

    def __setstate__(self, state: dict) -> None:
        names = zlib.decompress(state.pop("terms"))
        self.__dict__ |= state
        self.vocabulary = {t: i for i, t in enumerate(names.split(b"\n"))} if names else {}
        self.fill()

    def fill(self) -> None:
        """Blocks and largest weights of the cells, full rows of the frequent terms and their largest weights by block."""
        start = self.cell_start[:-1]
        self.cell_block = self.posting[start] // BLOCK
        self.cell_most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        full = np.flatnonzero(self.row >= 0)
        self.rows = np.zeros((len(full), self.blocks * BLOCK))
        begin, end = self.cell_start[self.first[full]], self.cell_start[self.first[full + 1]]
        for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            self.rows[i, self.posting[a:b]] = self.weight[a:b]
        self.row_most = self.rows.reshape(len(full), self.blocks, BLOCK).max(axis=2, initial=0.0)

    def vectors(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of the known terms of some texts; each text's weights have length one."""
        ids: list[int] = []
        times: list[int] = []
        ends = [0]
        place = self.vocabulary
        for words in texts:
            counts = Counter(words)
            ids += [place.get(w, -1) for w in counts]
            times += counts.values()
            ends.append(len(ids))
        at, n = np.array(ids, np.int64), np.array(times, np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(ends))[at >= 0]
        at, n = at[at >= 0], n[at >= 0]
        x = (1 + np.log(n)) * self.idf[at]
        return text, at, x / np.sqrt(np.bincount(text, x * x, len(texts)))[text]

    def search(self, texts: int, text: np.ndarray, at: np.ndarray, q: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each of some texts the k examples with the largest cosine above zero, nearest first, ties to the first example; skip: an example that is left out, or -1.

        Block by block: the STEP blocks with the largest bounds are searched
        first, then those whose bound reaches the k-th cosine so far.
        """
        everything = self.blocks * BLOCK
        row = self.row[at]
        frequent = np.zeros((texts, len(self.row_most)))
        frequent[text[row >= 0], row[row >= 0]] = q[row >= 0]
        rare, w, of = at[row < 0], q[row < 0], text[row < 0]
        per = self.first[rare + 1] - self.first[rare]
        cell = ranges(self.first[rare], self.first[rare + 1])
        part, of = np.repeat(w, per), np.repeat(of, per)
        here = of * self.blocks + self.cell_block[cell]
        bound = frequent @ self.row_most + np.bincount(here, part * self.cell_most[cell], texts * self.blocks).reshape(texts, self.blocks)
        # frequent terms count for every example at once; the others' postings are read for chosen blocks alone
        score = frequent @ self.rows
        asked = np.zeros((texts, self.blocks), bool)
        first = np.argpartition(-bound, STEP, axis=1)[:, :STEP] if self.blocks > STEP else np.broadcast_to(np.arange(self.blocks), (texts, self.blocks))
        np.put_along_axis(asked, first, True, axis=1)
        asked &= bound > 0
        new = asked
        for again in (False, True):
            mine = new.ravel()[here]
            start, end = self.cell_start[cell[mine]], self.cell_start[cell[mine] + 1]
            p = ranges(start, end)
            score += np.bincount(np.repeat(of[mine], end - start) * everything + self.posting[p], np.repeat(part[mine], end - start) * self.weight[p], texts * everything).reshape(texts, everything)
            seen = np.round(np.where(np.repeat(asked, BLOCK, axis=1), score, 0.0), 12)
            if skip is not None:
                seen[np.flatnonzero(skip >= 0), skip[skip >= 0]] = 0.0
            least = np.partition(seen, -k, axis=1)[:, -k] if everything >= k else np.zeros(texts)
            if again:
                break
            new = ~asked & (bound > 0) & (bound >= least[:, None] - 1e-9)
            asked = asked | new
        out: list[list[tuple[float, int]]] = [[] for _ in range(texts)]
        t, e = np.nonzero((seen > 0) & (seen >= least[:, None]))
        for i, s, j in zip(t.tolist(), seen[t, e].tolist(), e.tolist(), strict=True):
            out[i].append((-s, j))
        return [[(-s, j) for s, j in sorted(x)[:k]] for x in out]

    def nearest(self, texts: list[list[bytes]], k: int) -> list[list[tuple[float, int]]]:
        return self.search(len(texts), *self.vectors(texts), k)

    def votes(self, near: list[tuple[float, int]]) -> float:
        """Share of the nearness that toxic neighbours have, with a little of the even start."""
        toxic = sum(s**4 for s, e in near if self.labels[e])
        every = sum(s**4 for s, _ in near)
        return (toxic + 0.05) / (every + 0.1)

    def scores(self, texts: list[list[bytes]]) -> list[tuple[float, list[tuple[float, int]]]]:
        """(score, neighbours) of each text."""
        found = [near for i in range(0, len(texts), TEXTS) for near in self.nearest(texts[i : i + TEXTS], NEIGHBOURS)]
        return [(float(np.interp(self.votes(near), *self.knots)) if near else self.empty_score, near) for near in found]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares rising map of x to y (pooling adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([a, a, b, c])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            lo, hi = pools[-2], pools.pop()
            pools[-1] = [lo[0], hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / (lo[3] + hi[3]), lo[3] + hi[3]]
    at, to = [], []
    for lo, hi, value, _ in pools:
        at += [lo] if lo == hi else [lo, hi]
        to += [value] if lo == hi else [value, value]
    return np.array(at), np.array(to)


def build(examples: Iterable[tuple[int, int, Mapping[bytes, int]]], rate: float) -> Index:
    """Of (doc_id, label, term counts); rate: share of label 1 among all learnable labels. The counts are read once and held as numbers."""
    names: dict[bytes, int] = {}
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    known: set[tuple[int, bytes]] = set()
    for doc, label, counts in examples:
        term = np.array([names.setdefault(t, len(names)) for t in counts], np.int32)
        n = np.fromiter(counts.values(), np.int32, len(counts))
        order = np.argsort(term)
        term, n = term[order], n[order]
        # equal texts are one example: a passage that was copied often isn't evidence as often
        mark = label, hashlib.blake2b(term.tobytes() + n.tobytes(), digest_size=16).digest()
        if mark not in known:
            known.add(mark)
            held.append((doc, label, term, n))
    size = {c: sum(1 for e in held if e[1] == c) for c in (0, 1)}
    df = {c: np.bincount(np.concatenate([e[2] for e in held if e[1] == c] or [np.zeros(0, np.int32)]), minlength=len(names)).astype(float) for c in (0, 1)}
    total = size[0] + size[1]
    x, y = df[1], df[0]
    margin = (x + y) * (total - x - y) * size[0] * size[1]
    chi2 = np.maximum(np.divide(total * (x * (size[0] - y) - y * (size[1] - x)) ** 2, margin, out=np.zeros(len(names)), where=margin > 0), LEAST_CHI2)
    # the terms that tell most about the label first
    ranked = sorted(names, key=lambda t: (-chi2[names[t]], t))
    old = np.array([names[t] for t in ranked], np.int64)
    place = np.empty(len(old), np.int64)
    place[old] = np.arange(len(old))
    idf = ((np.log((total + 1) / (x + y + 0.5)) + 0.1) * np.sqrt(chi2 / max(total, 1)))[old]
    own = []
    for doc, label, term, n in held:
        if len(term):
            at = place[term]
            order = np.argsort(at)
            at, w = at[order], (1 + np.log(n[order])) * idf[at[order]]
            own.append((int(at[w.argmax()]), doc, label, at, w / np.sqrt(w @ w)))
    own.sort(key=lambda e: e[:2])  # examples with the same strongest term share blocks, so bounds are tight
    blocks = -(-len(own) // BLOCK)
    term = np.concatenate([e[3] for e in own] or [np.zeros(0, np.int64)])
    example = np.repeat(np.arange(len(own)), [len(e[3]) for e in own])
    order = np.lexsort((example, term))
    term, example = term[order], example[order]
    weight = np.concatenate([e[4] for e in own] or [np.zeros(0)])[order]
    cell, start = np.unique(term * blocks + example // BLOCK, return_index=True)
    first = np.searchsorted(cell, np.arange(len(ranked) + 1) * blocks)
    full = np.flatnonzero(np.bincount(term, minlength=len(ranked)) >= max(DENSE_SHARE * len(own), 1))
    row = np.full(len(ranked), -1)
    row[full] = np.arange(len(full))
    index = Index({t: i for i, t in enumerate(ranked)}, idf, [e[1] for e in own], np.array([e[2] for e in own], bool), blocks, first, np.append(start, len(weight)).astype(np.int32), example.astype(np.int32), weight, row, prior=rate)
    index.fill()
    # weights that bring the sample's labels back to their true rate
    per = {1: rate / size[1] if size[1] else 0.0, 0: (1 - rate) / size[0] if size[0] else 0.0}
    without = {c: size[c] - sum(1 for e in own if e[2] == c) for c in (0, 1)}
    mass = {c: per[c] * without[c] for c in (0, 1)}
    index.empty_score = (mass[1] + rate * 1e-3) / (mass[0] + mass[1] + 1e-3)
    if own:
        vote = []
        for i in range(0, len(own), TEXTS):
            some = own[i : i + TEXTS]
            text = np.repeat(np.arange(len(some)), [len(e[3]) for e in some])
            near = index.search(len(some), text, np.concatenate([e[3] for e in some]), np.concatenate([e[4] for e in some]), NEIGHBOURS, np.arange(i, i + len(some)))
            vote += map(index.votes, near)
        x, y = np.array(vote), np.array([e[2] for e in own], float)
        knots, values = monotone(x, y, np.array([per[int(v)] for v in y]))
        index.knots = knots, np.clip(values, 1e-4, 1 - 1e-4)
    return index


def learnable(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for text in batch.column("text"):
            packed.append(b"\n".join(t + b" %d" % c for t, c in sorted(Counter(terms(text.as_py())).items())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Index:
    """Fitted on at most per_class learnable documents of each label; a document labelled both ways counts as toxic, one whose doc_id repeats has its least text."""
    spark = docs.sparkSession
    can = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rate = can.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = [r for c in (0, 1) for r in can.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "toxic").collect()]
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row of each chosen document: the least text where its doc_id repeats
    one = text.join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = one.mapInArrow(lean(_counts), "doc_id long, toxic int, terms binary").collect()
    rows.sort(key=lambda r: r.doc_id)

    def counted(packed: bytes) -> dict[bytes, int]:
        pairs = (x.rsplit(b" ", 1) for x in packed.split(b"\n") if x)
        return {t: int(c) for t, c in pairs}

    return build(((r.doc_id, r.toxic, counted(bytes(r.terms))) for r in rows), rate)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in carry, held_out, score, predicted and evidence (doc_id, toxic, cosine of the nearest examples).

    A null or empty text, and any that shares no term with the examples, has
    the rate of such examples as its score. Without any usable label all scores
    are 0. Rows with a null doc_id are scored and not held out. Repeated rows
    give repeated rows, an empty table none; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    index = train(docs, labels, per_class)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = dict.fromkeys(texts)  # copies in a batch are scored once
            known.update(zip(known, index.scores([terms(t) for t in known]), strict=True))
            scores = [min(max(known[t][0], 0.0), 1.0) for t in texts]
            evidence = [[{"doc_id": index.ids[e], "toxic": int(index.labels[e]), "cosine": s} for s, e in known[t][1][:EVIDENCE]] for t in texts]
            out = {name: batch.column(name) for name in batch.schema.names if name != "text" or "text" in carry}
            out["held_out"] = pc.fill_null(batch.column("held_out"), False)
            out["score"] = pa.array(scores, pa.float64())
            out["predicted"] = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            out["evidence"] = pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    more = [c for c in carry if c not in ("doc_id", "text")]
    source = docs.select("doc_id", *more, F.col("text").cast("string").alias("text"), (~learnable(F.col("doc_id"))).alias("held_out"))
    order = [f for f in source.schema.fields if f.name != "text" or "text" in carry]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in order), "score double, predicted int, evidence array<struct<doc_id: bigint, toxic: int, cosine: double>>"])
    return source.mapInArrow(lean(rows), schema)
