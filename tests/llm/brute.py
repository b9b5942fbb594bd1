"""Plain versions of the operators, over lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def near_components(rows: list[tuple], k: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest doc_id that links reach)."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall(small(text or ""))
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    of = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            of[x].append(doc)
    both = Counter()
    for docs in of.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                both[min(a, b), max(a, b)] += 1
    least = {d: d for d in sets}

    def root(x: int) -> int:
        while least[x] != x:
            x = least[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_links(rows: list[tuple], k: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id to (different other sets that it links with, other documents that it links with)."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall(small(text or ""))
        sets[doc] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    copies = Counter(s for s in sets.values() if s)
    near = {s: [t for t in copies if 100 * len(s & t) >= percent * len(s | t)] for s in copies}
    return {d: (len(near[s]) - 1, sum(copies[t] for t in near[s]) - 1) if s else (0, 0) for d, s in sets.items()}


def without_repeats(rows: list[tuple], k: int = 35) -> list[tuple]:
    """(doc_id, words, removed, digest of the kept words) of each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def base_places(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small(text or ""))
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def nonbranching_spans(rows: list[tuple], k: int) -> dict[int, list[tuple]]:
    """doc_id to (first word, words, least multiplicity) of each run of repeated windows between nodes that branch."""
    words = {doc: tuple(WORD.findall(t or "")) for doc, t in rows}
    seen = Counter(w[i : i + k] for w in words.values() for i in range(len(w) - k + 1))
    into, out_of = defaultdict(set), defaultdict(set)
    for e, n in seen.items():
        if n > 1:
            out_of[e[:-1]].add(e)
            into[e[1:]].add(e)
    out = {}
    for doc, w in words.items():
        spans = []
        for i in range(len(w) - k + 1):
            n = seen[w[i : i + k]]
            if n < 2:
                continue
            node = w[i : i + k - 1]
            if spans and spans[-1][0] + spans[-1][1] - k + 1 == i and len(into[node]) == len(out_of[node]) == 1:
                a, size, least = spans[-1]
                spans[-1] = (a, size + 1, min(least, n))
            else:
                spans.append((i, k, n))
        out[doc] = spans
    return out


def toxicity_scores(examples: list[tuple], texts: list[str | None], rate: float) -> list[float]:
    """The score of each text, with plain dictionaries: every cosine with every example (doc_id, label, text), no index."""
    from math import log, sqrt

    from threshmill.llm.toxicity import LEAST_CHI2, NEIGHBOURS, monotone, terms

    import numpy as np

    seen, kept = set(), []
    for doc, label, text in sorted(examples):
        counts = Counter(terms(text))
        mark = label, frozenset(counts.items())
        if mark not in seen:
            seen.add(mark)
            kept.append((doc, label, counts))
    size = Counter(label for _, label, _ in kept)
    df = {c: Counter(t for _, label, counts in kept if label == c for t in counts) for c in (0, 1)}
    total = len(kept)
    weight = {}
    for t in df[0] | df[1]:
        a, b = df[1][t], df[0][t]
        margin = (a + b) * (total - a - b) * size[0] * size[1]
        chi2 = max(total * (a * (size[0] - b) - b * (size[1] - a)) ** 2 / margin if margin else 0.0, LEAST_CHI2)
        weight[t] = (log((total + 1) / (a + b + 0.5)) + 0.1) * sqrt(chi2 / total)

    def vector(counts: Counter) -> dict:
        v = {t: (1 + log(n)) * weight[t] for t, n in counts.items() if t in weight}
        norm = sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    own = [(vector(counts), label) for _, label, counts in kept if counts]

    def votes(v: dict, skip: int = -1) -> float | None:
        near = sorted(((round(sum(x * e.get(t, 0.0) for t, x in v.items()), 12), label) for i, (e, label) in enumerate(own) if i != skip), reverse=True)[:NEIGHBOURS]
        near = [(s, label) for s, label in near if s > 0]
        return (sum(s**4 for s, label in near if label) + 0.05) / (sum(s**4 for s, _ in near) + 0.1) if near or skip >= 0 else None

    per = {1: rate / size[1] if size[1] else 0.0, 0: (1 - rate) / size[0] if size[0] else 0.0}
    knots, values = monotone(np.array([votes(v, i) for i, (v, _) in enumerate(own)]), np.array([float(label) for _, label in own]), np.array([per[label] for _, label in own]))
    empty = {c: per[c] * sum(1 for _, label, counts in kept if label == c and not counts) for c in (0, 1)}
    out = []
    for text in texts:
        got = votes(vector(Counter(terms(text))))
        out.append((empty[1] + rate * 1e-3) / (empty[0] + empty[1] + 1e-3) if got is None else float(np.interp(got, knots, np.clip(values, 1e-4, 1 - 1e-4))))
    return out


def language(model, text: str | None) -> tuple[str, float]:
    """A text's language and score by plain loops over its n-grams and the model's centroids."""
    from math import exp, log1p, sqrt

    import regex

    from threshmill.llm.language_id import DIMENSIONS, SHARPNESS

    if text is None or not regex.search(r"\p{L}", text):
        return "und", 0.0
    raw = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in text.lower().encode())
    raw = re.sub(rb" +", b" ", raw)
    counts: Counter = Counter()
    for i in range(len(raw) - 1):
        counts[(raw[i] * 256 + raw[i + 1] + 0x5000001) * 2654435761 % 2**32 >> 20] += 1
        if i + 2 < len(raw):
            counts[(raw[i] * 65536 + raw[i + 1] * 256 + raw[i + 2]) * 2654435761 % 2**32 >> 20] += 1
    v = [0.0] * DIMENSIONS
    for d, n in counts.items():
        v[d] = log1p(n) * float(model.idf[d])
    norm = sqrt(sum(x * x for x in v)) or 1.0
    best = [-1.0] * len(model.languages)
    for centre, owner in zip(model.centroids.tolist(), model.owner.tolist(), strict=True):
        best[owner] = max(best[owner], sum(v[d] * centre[d] for d in counts) / norm)
    top = max(best)
    return model.languages[best.index(top)], (0.5 if top < model.reject_below else 1.0) / sum(exp(SHARPNESS * (x - top)) for x in best)
