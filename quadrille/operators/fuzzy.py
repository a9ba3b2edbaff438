"""Weighted Ratcliff-Obershelp similarity of searches and items: bounds for all pairs, the measure itself for those that can rank.

The letters two texts share, and their longest common subsequence, are never fewer than the letters that the measure matches.
Both are counted for many pairs at a time, so only pairs whose bound reaches a proven floor of their search are compared.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Cells (letters times rows), rows and letters of one chunk of items; pairs refined together.
CELLS, ROWS, CHARS, PAIRS = 1 << 21, 1 << 15, 1 << 23, 1 << 18
#: To find its floor, pairs of each search in a chunk that are refined, refined further and scored, at least.
REFINED, SEEDS = (2048, 128), 8
#: Scores this close may be equal once rounded; a bound in single precision may be short by the second.
TIE, SINGLE = 2e-9, 1e-5
#: Letters of a search that the subsequence holds in one machine word; the further ones count as found.
WORD = 64


class Searches:
    """Lowered texts as tables: letters, how often each text has each, and the bits of their places."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.length = texts, np.array([len(t) for t in texts], np.int64)
        self.letters = np.unique(_raw(texts))
        self.kind = np.min_scalar_type(int(self.length.max(initial=1)))
        self.own: list[list[tuple[int, int]]] = []
        self.bits = np.zeros((len(texts), len(self.letters) + 1), np.uint64)
        for n, t in enumerate(texts):
            code = np.searchsorted(self.letters, _raw([t]))
            self.own.append([(int(a), int(c)) for a, c in zip(*np.unique(code, return_counts=True))])
            for place, a in enumerate(code[:WORD]):
                self.bits[n, a] |= np.uint64(1 << place)


def _raw(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class _Field:
    """A field of a chunk of items: its letters as numbers of the searches' letters, and their counts by letter and row."""

    def __init__(self, texts: list[str], s: Searches) -> None:
        self.texts, self.length = texts, np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        raw, known, n = _raw(texts), len(s.letters), len(texts)
        code = np.searchsorted(s.letters, raw)
        code[np.append(s.letters, 0)[code] != raw] = known
        self.code = code.astype(np.min_scalar_type(known))
        cells = np.bincount(code * n + np.repeat(np.arange(n), self.length), minlength=(known + 1) * n)[: known * n]
        self.counts = np.minimum(cells, np.iinfo(s.kind).max).astype(s.kind).reshape(known, n)
        self.single = self.length.astype(np.float32)

    def shared(self, s: Searches, q: int) -> np.ndarray:
        """The ratio of each row if all letters shared with a search matched."""
        total, one = np.zeros(len(self.texts), s.kind), np.empty(len(self.texts), s.kind)
        for a, c in s.own[q]:
            np.add(total, np.minimum(self.counts[a], s.kind.type(c), out=one), out=total)
        size = self.single + np.float32(s.length[q])
        return np.divide(total * np.float32(2), size, out=np.ones_like(size), where=size > 0)

    def subsequence(self, s: Searches, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The ratio of each pair if its longest common subsequence matched; all pairs go on by one letter at a time."""
        order = np.argsort(-self.length[row], kind="stable")
        length, at, base = self.length[row][order], self.start[row][order], q[order] * s.bits.shape[1]
        bits, v = s.bits.ravel(), np.full(len(q), ~np.uint64(0))
        left = len(q) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
        for j, n in enumerate(left):
            u = v[:n] & bits[base[:n] + self.code[at[:n] + j]]
            v[:n] = (v[:n] + u) | (v[:n] - u)
        size = s.length[q][order]
        found = np.bitwise_count(~v) + np.maximum(size - WORD, 0)
        out = np.empty(len(q))
        out[order] = np.where(size + length > 0, 2 * found / np.maximum(size + length, 1), 1.0)
        return out


def fuzzy_scores(batches: Iterator[pd.DataFrame], fields: tuple[str, ...], weights: tuple[float, ...], s: Searches, k: int, floors: np.ndarray | None) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """(number of search, doc, score) of the pairs that reach the floors; without floors, of k or more good ones of each chunk."""
    most, held, chars = max(min(ROWS, CELLS // (len(s.letters) + 1)), 1), [], 0
    for batch in batches:
        for doc, *texts in batch[["doc", *fields]].itertuples(index=False, name=None):
            held.append((doc, *((t or "").lower() for t in texts)))
            chars += sum(map(len, held[-1][1:]))
            if len(held) == most or chars >= CHARS:
                yield from _chunk(held, weights, s, k, floors)
                held, chars = [], 0
    if held:
        yield from _chunk(held, weights, s, k, floors)


def _chunk(rows: list[tuple], weights: tuple[float, ...], s: Searches, k: int, floors: np.ndarray | None) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    docs, *texts = zip(*rows)
    chunk = [_Field(list(t), s) for t in texts]
    least = None if floors is None else floors - TIE
    pairs, size = [], 0
    for q in range(len(s.texts)):
        parts = [np.float32(w) * f.shared(s, q) for w, f in zip(weights, chunk)]
        bound = sum(parts[1:], parts[0])
        if least is None:
            n = max(REFINED[0], k)
            take = np.argpartition(-bound, n)[:n] if len(bound) > n else np.arange(len(bound))
        else:
            take = np.flatnonzero(bound >= np.float32(least[q] - SINGLE))
        pairs.append((np.full(len(take), q), take, *(p[take] for p in parts)))
        size += len(take)
        if size >= PAIRS:
            yield _compared(pairs, chunk, docs, weights, s, k, least)
            pairs, size = [], 0
    if size:
        yield _compared(pairs, chunk, docs, weights, s, k, least)


def _compared(pairs: list[tuple], chunk: list[_Field], docs: tuple, weights: tuple[float, ...], s: Searches, k: int, least: np.ndarray | None) -> tuple[np.ndarray, list, np.ndarray]:
    q, row, *parts = (np.concatenate(x) for x in zip(*pairs))
    parts = [p.astype(np.float64) for p in parts]

    def keep(slack: float, best: int) -> None:
        """Of the pairs, those that may reach the floors; without floors, the best of each search."""
        nonlocal q, row, parts
        if least is not None:
            which = np.flatnonzero(sum(parts) >= least[q] - slack)
        else:
            order = np.lexsort((-sum(parts), q))
            which = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < max(best, k)]
        q, row, parts = q[which], row[which], [p[which] for p in parts]

    for n, f in enumerate(chunk):
        parts[n] = np.minimum(parts[n], weights[n] * f.subsequence(s, q, row))
        keep(SINGLE, REFINED[1] if n + 1 < len(chunk) else SEEDS)
    for n, f in enumerate(chunk):
        parts[n] = weights[n] * _ratios(f.texts, s.texts, q, row)
        keep(SINGLE if n + 1 < len(chunk) else 0.0, SEEDS)
    return q, [docs[i] for i in row.tolist()], sum(parts)


def _ratios(texts: list[str], searches: list[str], q: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The measure itself; each text is prepared once, and met once by each search, however many rows have it."""
    by_text: dict[str, dict[int, list[int]]] = {}
    for k, (n, i) in enumerate(zip(q.tolist(), row.tolist())):
        by_text.setdefault(texts[i], {}).setdefault(n, []).append(k)
    out, m = np.empty(len(q)), difflib.SequenceMatcher(None)
    for text, asked in by_text.items():
        m.set_seq2(text)
        for n, places in asked.items():
            m.set_seq1(searches[n])
            out[places] = m.ratio()
    return out
