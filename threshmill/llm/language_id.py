"""Language ID by nearest centroids.

A text's vector holds the TF-IDF weights of its letter n-grams (two and three
bytes of the lower-cased text, words apart by one space), hashed to a fixed
number of dimensions and normalised. Training clusters the vectors of each
language into a few centroids; a text gets the language of the centroid with
the largest cosine. A text farther from all centroids than nearly all training
texts is from theirs is marked rejected, and its score is damped; the language
stays, as only texts without a letter are `und`.

The classifier is fitted on a bounded sample: `per_language` learnable
documents of each language, those with the smallest hashes of their doc_id (in
each of PARTS parts by hash, then among those), for the MOST_LANGUAGES languages
with most documents there and MOST_EXAMPLES documents at most. Every whole text
is classified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threshmill.llm.common import cut, discard, lean, short_batches, text_chunks

DIMENSIONS = 4096
PER_LANGUAGE = 256
MOST_LANGUAGES = 512
#: Documents of all languages together that the driver holds; with many languages each gives fewer.
MOST_EXAMPLES = 8192
#: Parts that a language's documents are sampled in; each gives eight times its even share at most.
PARTS = 64
CENTROIDS = 3
REJECT_QUANTILE = 0.002
SHARPNESS = 24.0
HAS_LETTER = regex.compile(r"\p{L}")
#: Small ASCII letters, one space for other ASCII bytes; bytes of other characters stay.
FOLD = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def ngram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, DIMENSIONS) counts of the hashed two- and three-byte grams of each document."""
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    folded = FOLD[raw].astype(np.uint32)
    for i in range(len(out)):
        b = folded[offsets[i] : offsets[i + 1]]
        if len(b) > 1:
            b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))]
        if len(b) < 2:
            continue
        two = b[:-1] * np.uint32(256) + b[1:]
        three = two[:-1] * np.uint32(256) + b[2:]
        codes = np.concatenate((two + np.uint32(0x5000001), three)) * np.uint32(2654435761) >> np.uint32(20)
        out[i] = np.bincount(codes, minlength=DIMENSIONS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def tf(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    reject_below: float

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, rejected) of each row of counts."""
        cosine = unit(tf(counts) * self.idf) @ self.centroids.T
        best = np.full((len(cosine), len(self.languages)), -1.0)
        for c, o in enumerate(self.owner):
            best[:, o] = np.maximum(best[:, o], cosine[:, c])
        pick = best.argmax(axis=1)
        top = best[np.arange(len(best)), pick]
        share = np.exp(SHARPNESS * (best - top[:, None]))
        far = top < self.reject_below
        score = np.where(far, 0.5, 1.0) / share.sum(axis=1)
        return pick, np.clip(score, 0.0, 1.0), far


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by cosine k-means from the farthest points; the same each time."""
    first = int((x @ unit(x.mean(axis=0))).argmax())
    chosen = [first]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centre = x[chosen]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        centre = np.stack([unit(x[near == j].mean(axis=0)) if (near == j).any() else centre[j] for j in range(len(centre))])
    return centre


def fit(counts: np.ndarray, langs: list[str], k: int = CENTROIDS) -> Model:
    """Of sampled documents; languages in code point order."""
    languages = sorted(set(langs))
    label = np.array([languages.index(x) for x in langs])
    # each language counts the same in the document frequencies
    df = sum(((counts[label == i] > 0).mean(axis=0) for i in range(len(languages))), np.zeros(DIMENSIONS)) / max(len(languages), 1)
    idf = np.log((1 + len(langs)) / (1 + df * len(langs))).astype(np.float32) + np.float32(0.05)
    x = unit(tf(counts) * idf)
    per = [clusters(x[label == i], k) for i in range(len(languages))]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c in per])
    centroids = np.concatenate(per) if per else np.zeros((0, DIMENSIONS), np.float32)
    own = np.array([(x[j] @ centroids[owner == label[j]].T).max() for j in range(len(x))]) if len(x) else np.zeros(1)
    return Model(languages, idf, centroids, owner, float(np.quantile(own, REJECT_QUANTILE)) * 0.9)


def learnable() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2


def lower(text: F.Column) -> F.Column:
    """Small letters of every script, as Java has them."""
    return F.lower(text.cast("string"))


def _sampled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, raw, offsets in text_chunks(batch.column("text")):
            counts = ngram_counts(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, len(counts)), pa.array([c.astype("<f4").tobytes() for c in counts], pa.binary())], names=["lang", "counts"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fitted on at most per_language learnable documents with text of each language; of rows that repeat a doc_id in one language, the least text."""
    can = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learnable() & (F.length(F.trim("text")) > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    # the first of 64 parts of each language, then the first of those: a language is never one task's
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h", "doc_id")
    first = cut(can.distinct().withColumn("r", F.row_number().over(parts)).where(F.col("r") <= max(8 * per_language // PARTS, 1)).drop("r"))
    often = [r.lang for r in first.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    each = max(min(per_language, MOST_EXAMPLES // max(len(often), 1)), 1)
    whole = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = first.where(F.col("lang").isin(often)).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= each).select("doc_id", "lang").collect()
    discard(first)
    if not chosen:
        return Model([], np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), 0.0)
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), lower(F.col("text")).alias("text")).where(F.length(F.trim("text")) > 0)
    one = text.join(picked, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = one.select("text", "lang").mapInArrow(lean(_sampled_counts), "lang string, counts binary").collect()
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.counts)))
    return fit(np.stack([np.frombuffer(r.counts, "<f4") for r in rows]), [r.lang for r in rows])


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each whole text.

    lang_pred is a learned language, or `und` if the text is null or has no
    letter (score 0), or if nothing could be learned. Rows with a null doc_id
    are classified and not held out. Repeated rows give repeated rows, an empty
    table none; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    model = train(docs, per_language)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            langs, scores, far = [], [], []
            for row, raw, offsets in text_chunks(texts, 1 << 20):
                n = len(offsets) - 1
                if not model.languages:
                    langs += ["und"] * n
                    scores += [0.0] * n
                    far += [True] * n
                    continue
                for a in range(0, n, 512):
                    b = min(a + 512, n)
                    pick, score, reject = model.predict(ngram_counts(raw, offsets[a : b + 1]))
                    for i in range(b - a):
                        text = texts[row + a + i].as_py()
                        letters = text is not None and HAS_LETTER.search(text) is not None
                        langs.append(model.languages[pick[i]] if letters else "und")
                        scores.append(float(score[i]) if letters else 0.0)
                        far.append(bool(reject[i]) if letters else True)
            held = pc.fill_null(batch.column("held_out"), False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learnable()).alias("held_out"), lower(F.col("text")).alias("text")).mapInArrow(lean(rows), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
