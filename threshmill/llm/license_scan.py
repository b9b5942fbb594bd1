"""License scans: short notices found exactly and with bounded errors.

Words are runs of ASCII letters and digits (lower-cased) and of all non-ASCII
bytes. Base phrases are counted where their words stand consecutively.

Fuzzy notices: a notice of w words that may differ by e edits is split into
e + 1 parts (pigeonhole: one part must stand unharmed). The parts are exact
seeds; where one stands, the regex library matches the runs of whole words
around it with at most e character edits, which verifies a run and gives its
edits. The time is linear in the text's length: each seed has a bounded number
of runs around it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshmill.llm.common import lean, short_batches

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices searched with errors, their labels, and the edits allowed.
NOTICES = (
    ("permission is hereby granted free of charge", "mit-notice", 4),
    ("licensed under the mit license", "mit-notice", 3),
    ("licensed under the apache license", "apache-notice", 3),
    ("gnu general public license", "gpl-notice", 2),
    ("gnu lesser general public license", "lgpl-notice", 3),
    ("redistribution and use in source and binary forms", "bsd-notice", 4),
    ("mozilla public license", "mpl-notice", 2),
    ("creative commons attribution", "cc-notice", 2),
    ("released under the", "release-notice", 1),
    ("spdx license identifier", "spdx-notice", 2),
    ("all rights reserved", "reserved-notice", 2),
)
#: Matched pieces that are remembered for each notice.
PIECES_KEPT = 50_000
#: ASCII bytes that aren't in a word become spaces; capitals become small letters.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int

    def seeds(self) -> list[tuple[str, int]]:
        """(part, its place in the phrase): edits + 1 parts of about equal length that together are the phrase."""
        n = self.edits + 1
        cuts = [round(i * len(self.phrase) / n) for i in range(n + 1)]
        return [(self.phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Compiled notices. A line is a text's words with one space before, between and after; all places are characters of it."""

    def __init__(self, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> None:
        self.base = [(f" {phrase} ", label) for phrase, label in base]
        self.notices = [Notice(*x) for x in notices]
        self.fuzzy = [regex.compile(rf"(?b)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}") for n in self.notices]
        self.known: list[dict[str, int]] = [{} for _ in self.notices]

    def words(self, text: str | None) -> tuple[int, str]:
        """(number of words, line)."""
        found = (text or "").encode().translate(WORD_BYTES).decode().split(" ")
        found = [w for w in found if w]
        return len(found), " " + " ".join(found) + " " if found else " "

    def exact(self, line: str) -> list[tuple[int, str]]:
        """(character before it, label) of each place of a base phrase."""
        out = []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = line.find(phrase, at + 1)
        return out

    def edits(self, which: int, piece: str) -> int:
        """Fewest edits between a piece and a notice; -1 if there are more than it allows. Equal pieces are matched once."""
        known = self.known[which]
        got = known.get(piece)
        if got is None:
            m = self.fuzzy[which].fullmatch(piece)
            if len(known) >= PIECES_KEPT:
                known.clear()
            got = known[piece] = sum(m.fuzzy_counts) if m else -1
        return got

    def near(self, line: str) -> list[tuple[str, int, int, int]]:
        """(label, first character, character after the last, edits) of the notices found with errors.

        All runs of whole words within a notice's edits are found: one of its
        parts stands unharmed in each, at most that many characters from its
        place, so the runs around a seed begin and end near where the notice
        would. Of runs of one notice that overlap, those with fewest edits stay,
        then the first ones, then the shortest.
        """
        out = []
        for which, notice in enumerate(self.notices):
            size, most = len(notice.phrase), notice.edits
            runs: set[tuple[int, int]] = set()
            for part, place in notice.seeds():
                at = line.find(part)
                while at >= 0:
                    low = max(at - place - most, 1)
                    starts = [x for x in range(low, min(at, at - place + most) + 1) if line[x - 1] == " " != line[x]]
                    for start in starts:
                        first = max(start + size - most, at + len(part))
                        runs.update((start, end) for end in range(first, min(start + size + most, len(line) - 1) + 1) if line[end] == " " != line[end - 1])
                    at = line.find(part, at + 1)
            hits = sorted((e, a, b) for a, b in runs if (e := self.edits(which, line[a:b])) >= 0)
            taken: list[tuple[int, int, int]] = []  # in order of place, none of them overlaps another
            for e, a, b in hits:
                i = bisect_left(taken, (a, b, e))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                    taken.insert(i, (a, b, e))
            out += [(notice.label, a, b, e) for a, b, e in taken]
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, int]], str]:
        n, line = self.words(text)
        return n, self.exact(line), self.near(line), line


def word_starts(line: str) -> list[int]:
    """The first character of each word, with the end."""
    return [i + 1 for i, c in enumerate(line) if c == " "]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first word, words, edits) of each whole text.

    first_word and last_word are the smallest and largest starts of base places,
    null without any. labels has the base labels and those of the notices found
    with errors. score is 1 with a base place, else 1 minus the edits' share of
    the closest notice's length, 0 without any. A null text is empty. Repeated
    rows give repeated rows, an empty table none; other columns are ignored.
    """
    short_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        length = {n.label: min(len(x.phrase) for x in scanner.notices if x.label == n.label) for n in scanner.notices}
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column("text"):
                n, base, near, line = scanner.scan(text.as_py())
                begin = word_starts(line) if base or near else []
                starts = [bisect_left(begin, at + 1) for at, _ in base]
                labels = sorted({label for _, label in base})
                spans = [{"label": label, "first_word": bisect_left(begin, a), "words": line.count(" ", a, b) + 1, "edits": e} for label, a, b, e in near]
                score = 1.0 if base else max((1 - e / length[label] for label, _, _, e in near), default=0.0)
                for x, y in zip(out, (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(sorted({*labels, *(s[0] for s in near)})), score, spans), strict=True):
                    x.append(y)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, words long, edits long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(rows), schema)
