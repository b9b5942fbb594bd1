"""Similarity of short texts within groups. Operators J14, J15, D3, D4, D5, M1, M2, F1, J13."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threshmill.functions.text import normal_form
from threshmill.functions.urls import suffixes
from threshmill.operators.gate import folded
from threshmill.shared import cut, discard


#: Rows of (number, number, hash) that may be broadcast: 24 MB.
MOST_BROADCAST = 1_000_000


#: Tokens whose order of frequency every task knows; all others count as rare, in the order of their hashes.
RANKED_TOKENS = 1 << 18
#: Rows that a set sends out, each with its bitmap and some of its tokens, at least; and sets of one group of which such a part may be.
PARTS, PART_SETS = 8, 1 << 14
#: Sets that are dealt at once.
DEALT_ROWS = 2000
#: Candidates that are judged at once.
AT_ONCE = 1 << 20


def _need(n: np.ndarray, least: float) -> np.ndarray:
    """Tokens that a set of n shares with a similar one, at least."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all runs of `counts` from `starts`, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _bytes_of(n: np.ndarray) -> np.ndarray:
    """Bytes of the bitmap of a set of n tokens: a power of two of at least 1.5 n bits and 8 bytes."""
    return 1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) * 1.5)).astype(np.int64) - 3, 3)


def _dealt(batches: Iterator[pa.RecordBatch], least: float, ranked: np.ndarray, by_hash: np.ndarray, parts: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, blob) of batches (name, group, hashes): the sets of a batch that have tokens of their prefixes in the bucket, with bitmaps of the whole sets."""
    for batch in (b.slice(i, DEALT_ROWS) for b in batches for i in range(0, len(b), DEALT_ROWS)):
        names, groups = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("name", "g"))
        lists = batch.column("h")
        at = lists.offsets.to_numpy().astype(np.int64)
        hashes = lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
        n, starts = np.diff(at), at[:-1] - at[0]
        row = np.repeat(np.arange(len(n)), n)
        # parities of a bit for each token: bits that differ are tokens that differ, so they count those from below
        wide = _bytes_of(n)
        base = np.cumsum(wide) - wide
        bits = np.bincount(base[row] * 8 + (_mixed(hashes) & (wide[row] * 8 - 1).astype(np.uint64)).astype(np.int64), minlength=int(wide.sum()) * 8)
        bitmaps = np.packbits((bits & 1).astype(np.uint8), bitorder="little")
        # rarest first
        rank = np.zeros(len(hashes), np.int64)
        if len(ranked):
            k = np.minimum(np.searchsorted(ranked, hashes), len(ranked) - 1)
            rank = np.where(ranked[k] == hashes, by_hash[k], 0)
        order = np.lexsort((hashes, rank, row))
        place = np.arange(len(hashes)) - starts[row]
        order, place = order[(first := place < (n - _need(n, least) + 1)[row])], place[first]
        row, hashes = row[order], _mixed(hashes[order] ^ _mixed(groups[row[order]]))
        bucket = (_mixed(_mixed(groups[row]) + hashes % np.uint64(parts)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((row, bucket))
        row, hashes, place, bucket = row[order], hashes[order], place[order], bucket[order]
        out: list[bytes] = []
        cuts = np.flatnonzero(np.concatenate((np.ones(min(len(bucket), 1), bool), bucket[1:] != bucket[:-1])))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
            mine, counts = np.unique(row[x:y], return_counts=True)
            out.append(b"".join((struct.pack("<II", len(mine), y - x), names[mine].tobytes(), n[mine].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), hashes[x:y].astype(np.uint32).tobytes(), np.minimum(place[x:y], 65535).astype(np.uint16).tobytes(), bitmaps[_spans(base[mine], wide[mine])].tobytes())))
        yield pa.record_batch([pa.array(bucket[cuts], pa.int64()), pa.array(out, pa.binary())], names=["bucket", "blob"])


def _candidates(part: pa.Table, least: float) -> pa.Table:
    """Pairs of names of one bucket that share a token of their prefixes, whose sizes, whose places of the token and whose bitmaps allow the similarity."""
    read: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in part.column("blob"):
        b = blob.as_py()
        (k, m), at = struct.unpack_from("<II", b), 8
        for x, kind, size in zip(read, (np.uint64, np.uint32, np.uint32, np.uint32, np.uint16, np.uint8), (k, k, k, m, m, -1), strict=True):
            x.append(np.frombuffer(b, kind, size, at))
            at += x[-1].nbytes
    names, n, counts, tokens, places, bitmaps = map(np.concatenate, read)
    n, counts, wide = n.astype(np.int64), counts.astype(np.int64), _bytes_of(n)
    start, base = np.cumsum(counts) - counts, np.cumsum(wide) - wide
    # equal sets have one name, and one of them stands for all
    names, one = np.unique(names, return_index=True)
    n, wide = n[one], wide[one]
    entries = _spans(start[one], counts[one])
    tokens, places, owner = tokens[entries], places[entries].astype(np.int64), np.repeat(np.arange(len(one)), counts[one])
    order = np.lexsort((n[owner], tokens))
    tokens, places, owner = tokens[order], places[order], owner[order]
    size, left = n[owner], n[owner] - places
    # the partners of an entry are those after it in its list, up to the largest size
    most = int(n.max(initial=0)) + 1
    sorted_by = tokens.astype(np.int64) * most + size
    partners = np.searchsorted(sorted_by, tokens.astype(np.int64) * most + np.minimum(np.floor(size / least + 1e-9).astype(np.int64), most - 1), side="right") - np.arange(len(tokens)) - 1
    # bitmaps by width, and wider ones folded to the widths of smaller partners
    row = np.zeros(len(one), np.int64)
    maps: dict[int, np.ndarray] = {}
    for w in np.unique(wide).tolist():
        sets = np.flatnonzero(wide == w)
        row[sets] = np.arange(len(sets))
        maps[w] = bitmaps[_spans(base[one[sets]], wide[sets])].reshape(-1, w).view(np.uint64)
    narrowed = {(w, far): np.bitwise_xor.reduce(maps[far].reshape(-1, far // w, w // 8), axis=1) for w in maps for far in maps if w <= far <= 2 * w / least}
    found: list[np.ndarray] = []
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(partners)))
    x = 0
    while x < len(tokens):
        y = max(x + 1, int(np.searchsorted(total, total[x] + AT_ONCE, side="right")) - 1)
        a, b = np.repeat(np.arange(x, y), partners[x:y]), _spans(np.arange(x, y) + 1, partners[x:y])
        fits = (1 + least) * np.minimum(left[a], left[b]) >= least * (size[a] + size[b]) - 1e-6
        a, b = owner[a[fits]], owner[b[fits]]
        for (w, far), other in narrowed.items():  # a is no larger than b
            now = (wide[a] == w) & (wide[b] == far)
            i, j, step = a[now], b[now], max(1, AT_ONCE * 8 // w)
            for z in range(0, len(i), step):
                p, q = i[z : z + step], j[z : z + step]
                apart = np.bitwise_count(maps[w][row[p]] ^ other[row[q]]).sum(axis=1, dtype=np.int64)
                # two tokens of one set may have the same 32 bits
                near = (p != q) & ((1 + least) * apart <= (1 - least) * (n[p] + n[q]) + 1e-6)
                found.append(np.minimum(p[near], q[near]) * len(one) + np.maximum(p[near], q[near]))
        if sum(map(len, found)) > 4 * AT_ONCE:
            found = [np.unique(np.concatenate(found))]
        x = y
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pa.table({"x": pa.array(names[pairs // len(one)].view(np.int64)), "y": pa.array(names[pairs % len(one)].view(np.int64))})


def _similar_sets(df: DataFrame, group: str, key: str, tokens: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (group, key, name) with tokens and a group, equal sets of a group having one name; and pairs of names (x, y, jaccard) of similar sets, exactly.

    Prefix filter: tokens stand rarest first; two sets that are similar share
    one of their first n - ceil(least * n) + 1 tokens, and what follows it
    bounds what they share. Sets travel with these tokens and a bitmap of all,
    whose differing bits bound how many tokens differ. What passes both bounds is
    verified once on the whole sets. No row is made for a token or for a pair
    that fails them. Names are 64-bit hashes.
    """
    spark = df.sparkSession
    # the group under a name of its own, so that none clashes
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.col(tokens).alias("__t"))
    hashed = lambda t: F.array_sort(F.transform(F.array_distinct(t), lambda x: F.xxhash64(x)))
    # texts are split into tokens once; what follows reads hashes
    sets = cut(rows.select("__g", "__k", hashed("__t").alias("h")).where(F.size("h") > 0).withColumn("name", F.xxhash64("__g", "h")))
    hashes = sets.select("name", F.xxhash64("__g").alias("g"), "h")
    members = sets.select("__g", "__k", "name")
    largest = members.groupBy("__g").agg(F.countDistinct("name").alias("n")).agg(F.max("n")).first()[0] or 0
    often = hashes.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1").orderBy(F.desc("df"), "h").limit(RANKED_TOKENS).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    by = np.argsort(often)
    ranked, by_hash = often[by], len(often) - by
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(PARTS, -(-largest // PART_SETS))
    dealt = hashes.mapInArrow(lambda it: _dealt(it, least, ranked, by_hash, parts, buckets), "bucket long, blob binary")
    near = cut(dealt.groupBy("bucket").applyInArrow(lambda t: _candidates(t, least), "x long, y long").distinct())
    # one row of each name that has a candidate
    one = cut(members.groupBy("name").agg(F.min("__k").alias("__k")).join(near.select(F.col("x").alias("name")).union(near.select("y")).distinct(), "name"))
    few = F.broadcast(one) if one.count() <= MOST_BROADCAST else one
    whole = rows.join(few, "__k", "left_semi").select("__g", "__k", F.array_distinct("__t").alias("__t")).where(F.size("__t") > 0).withColumn("name", F.xxhash64("__g", hashed("__t")))
    whole = cut(whole.join(few, ["name", "__k"], "left_semi").dropDuplicates(["name"]).select("name", "__g", "__t"))
    left, right = whole.select(F.col("name").alias("x"), F.col("__g").alias("gx"), F.col("__t").alias("tx")), whole.select(F.col("name").alias("y"), F.col("__g").alias("gy"), F.col("__t").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    scored = near.join(left, "x").join(right, "y").where("gx = gy").withColumn("jaccard", both / (F.size("tx") + F.size("ty") - both))
    return members, scored.where(F.col("jaccard") >= least).select("x", "y", "jaccard")


def similar_pairs(df: DataFrame, group: str, key: str, tokens: str, least: float) -> DataFrame:
    """Pairs (a < b) of one group whose token sets have a Jaccard of at least `least`, exactly.

    Different sets are paired once, whichever rows have them; then each pair of
    sets gives the pairs of their rows, and each set those of its own. A null
    group has no pairs.
    """
    members, near = _similar_sets(df, group, key, tokens, least)
    p, q = members.select("__g", F.col("name").alias("x"), F.col("__k").alias("p")), members.select(F.col("name").alias("y"), F.col("__k").alias("q"))
    own = p.join(q, F.col("x") == F.col("y")).where("p < q").withColumn("jaccard", F.lit(1.0))
    others = near.join(p, "x").join(q, "y").where("p <> q")
    out = ["__g", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "jaccard"]
    return own.select(*out).unionByName(others.select(*out)).withColumnRenamed("__g", group)


def greedy_keep(df: DataFrame, group: str, key: str, tokens: str, least: float) -> DataFrame:
    """D3: rows in order of key; one is dropped if it is similar to an earlier row that was kept. An empty token set is never similar, nor is a row without a group.

    Equal to the fold over the rows: each round settles the rows without an
    undecided earlier neighbour, and drops the neighbours of kept ones. The
    first undecided row is always settled, so rounds go on until none is left;
    a chain of n similar rows takes n of them. The rounds work on similar pairs
    alone; all other rows are kept at once. Of rows with equal sets only the
    first can stay, as whatever drops it drops them: only first ones are paired,
    so g copies cost no pairs.
    """
    members, near = _similar_sets(df, group, key, tokens, least)
    firsts = cut(members.groupBy("name").agg(F.min("__k").alias("__k")))
    ends = near.join(firsts.select(F.col("name").alias("x"), F.col("__k").alias("p")), "x").join(firsts.select(F.col("name").alias("y"), F.col("__k").alias("q")), "y")
    pairs = cut(ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    state = cut(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct().withColumn("s", F.lit(0)))
    while not state.where("s = 0").isEmpty():
        before = state
        earlier = pairs.join(state.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").groupBy(F.col("b").alias("k")).agg(F.max(F.when(F.col("sa") == 1, 1).otherwise(0)).alias("hit"), F.max(F.when(F.col("sa") == 0, 1).otherwise(0)).alias("open"))
        state = cut(state.join(earlier, "k", "left").select("k", F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("hit", F.lit(0)) == 1, -1).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0).alias("s")))
        discard(before)
    copies = members.select("__k").join(firsts.select("__k"), "__k", "left_anti")
    dropped = state.where("s = -1").select(F.col("k").alias(key)).unionByName(copies.select(F.col("__k").alias(key)))
    return df.join(dropped, key, "left_anti")


def greedy_select(df: DataFrame, group: str, order: str, key: str, tokens: str, cap: int, most: float) -> DataFrame:
    """In each group in order, up to cap rows, each with a Jaccard below `most` to all chosen ones; rows without tokens are skipped. A group's rows pass in order; only the chosen sets are held."""
    def step(chosen: list[set], row: tuple) -> tuple | None:
        words = set(row[3] if row[3] is not None else ())
        if len(chosen) >= cap or not words or any(len(words & c) / len(words | c) >= most for c in chosen):
            return None
        chosen.append(words)
        return row[0], row[2]

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return folded(df.select(group, order, key, tokens), group, [order, key], lambda k: [], step, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}")


def merge_with_locked(locked: DataFrame, new: DataFrame, group: str, url: str, priority: str, seq: str, tokens: str, cap: int, most: float = 0.6) -> DataFrame:
    """New rows of a group by priority and seq, up to cap with the locked ones; none with a known url, none similar to a row that is in.

    New rows with the URL of a locked one go by a join. The others pass in order
    after the locked rows; the URLs that were taken and the sets of what is in
    are held, and none once a group is full.
    """
    fresh = new.join(locked.select(group, url).distinct(), [group, url], "left_anti")
    columns = lambda df, p: df.select(group, url, p.alias("__p"), F.col(seq).alias("__s"), F.col(tokens).alias("__t"))
    rows = columns(locked, F.lit(-1)).unionByName(columns(fresh, F.col(priority).cast("int")))

    def step(state: dict, row: tuple) -> tuple | None:
        is_new = row[2] >= 0
        if is_new and state["n"] >= cap:
            state["sets"], state["urls"] = [], set()
            return None
        words = set(row[4] if row[4] is not None else ())
        if is_new and (row[1] in state["urls"] or any(words and s and len(words & s) / len(words | s) >= most for s in state["sets"])):
            return None
        state["n"] += 1
        if state["n"] < cap:
            state["sets"].append(words)
        if is_new:
            state["urls"].add(row[1])
        return (row[0], row[1], row[3]) if is_new else None

    kinds = {f.name: f.dataType.simpleString() for f in new.schema.fields}
    return folded(rows, group, ["__p", "__s"], lambda k: {"n": 0, "sets": [], "urls": set()}, step, f"`{group}` {kinds[group]}, `{url}` {kinds[url]}, `{seq}` {kinds[seq]}")


def cosine(a: Column, b: Column) -> Column:
    """M1: 0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def allowed(df: DataFrame, host: str, roots: DataFrame, root: str) -> DataFrame:
    """Rows whose host is one of the roots or below one: an equi-join on the host's suffixes."""
    hit = df.select(host).distinct().withColumn("__s", F.explode(suffixes(F.col(host)))).join(roots.select(F.col(root).alias("__s")).distinct(), "__s").select(host).distinct()
    return df.join(hit, host, "left_semi")


def contaminated(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, chars: int = 80, words: int = 8, least: int = 30) -> DataFrame:
    """Pairs of a document and an item of `least` characters or more (normal form) whose first `chars` stand in it.

    A quote's whole words between its first and its last, up to `words`, are its
    anchor: an equi-join on hashed word runs finds the candidates, and the
    substring test verifies them. Quotes of fewer than three words have no
    anchor; they are looked for in the documents' texts around each place of
    their first characters, which stand in one word or two.
    """
    # the caller's keys under names of their own, so that none clashes
    whole = items.select(F.col(item_key).alias("__i"), normal_form(F.col(item_text)).alias("f")).where(F.length("f") >= least)
    quote = whole.select("__i", F.substring("f", 1, chars).alias("q")).withColumn("w", F.split("q", " ")).withColumn("n", F.least(F.size("w") - 2, F.lit(words)))
    # the first and last words of a cut quote may be parts of words, so the anchor lies between them
    anchor = quote.where("n > 0").select("__i", "n", F.xxhash64(F.array_join(F.expr("slice(w, 2, n)"), " ")).alias("h"))
    if anchor.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        # then the documents' runs never leave their tasks, but for the few that an item has
        anchor = F.broadcast(anchor)
    lengths = [r.n for r in anchor.select("n").distinct().collect()]  # `words` different lengths at most
    body = docs.select(F.col(doc_key).alias("__d"), normal_form(F.col(doc_text)).alias("t"))
    split = body.withColumn("w", F.split("t", " "))
    runs = [
        split.where(F.size("w") >= n).select("__d", F.lit(n).alias("n"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))).alias("h"))  # noqa: B023
        for n in sorted(lengths)
    ]
    # only hashes meet in the joins; texts come back for the candidates alone
    near = [r.join(anchor, ["n", "h"]).select("__d", "__i") for r in runs]
    # of one or two words a quote of 30 characters holds a run of 15 without a space: an anchor of characters
    bare = quote.where("n <= 0").withColumn("part", F.expr("array_max(transform(w, x -> struct(length(x) AS l, x AS x)))")["x"]).select("__i", F.xxhash64(F.substring("part", 1, 15)).alias("h"))
    if not bare.isEmpty():
        grams = split.select("__d", F.explode(F.array_distinct("w")).alias("x")).where(F.length("x") >= 15).select("__d", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("x") - 14), lambda i: F.xxhash64(F.substring(F.col("x"), i, F.lit(15)))))).alias("h"))
        near.append(grams.join(bare, "h").select("__d", "__i"))
    pairs = near[0] if near else docs.sparkSession.createDataFrame([], body.select("__d").schema).crossJoin(whole.select("__i").limit(0))
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    found = pairs.distinct().join(body, "__d").join(quote.select("__i", "q"), "__i").where(F.contains("t", F.col("q")))
    return found.select(F.col("__d").alias(doc_key), F.col("__i").alias(item_key))
