"""Evaluation passages inside training texts: rare n-gram seeds, then Smith-Waterman alignment of words.

Both sides are folded to plain words, and their word n-grams are hashed in Arrow batches. Seeds are the n-grams of the items
that not too many items share, counted over all items; they are joined to the n-grams of the texts (broadcast behind a check
of their size, else by a shuffle), so each text is read once for any number of items and no item passes through the driver.
A text and an item that share seeds are aligned locally, in a band around each diagonal with seeds, with a match for +2 and
a misspelt, replaced, added or missing word for -3. An alignment counts if it covers the whole item or ``MIN_WORDS`` words
of it and holds few edits for its length. More edits, and edits in shorter passages, count if each of them shows that it is
no other filler of a template: a single word left out or added, or a replacement that no item holds. With ``ALLOWED`` words
per edit such an alignment always has a run of ``SEED`` equal words, so seeds of that length lose none of the first kind.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.folding import fold
from quadrille.runtime import balanced, broadcast_if_small, materialize, release, spread

#: Words of a seed; least words of a passage; least words of a passage with edits; words per edit; half width of the band.
SEED, MIN_WORDS, MIN_EDITED, ALLOWED, BAND = 6, 15, 20, 9, 10
#: Words per edit where every edit shows that it is no filler of a template.
SHOWN_ALLOWED = 5
#: An n-gram in more than this share of the items (and in more than COMMON_LEAST of them) is a set phrase.
COMMON_SHARE, COMMON_LEAST = 0.25, 8

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile(r"\\[nrt]")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_BROKEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_MARKS = re.compile(r"[^\w\s]|_")
_CODE = re.compile(r"\b([a-z]{2,6}) (\d{3}[a-z]?)\b")
_ASCII_MARKS = {i: None for i in range(128) if not chr(i).isalnum() and not chr(i).isspace()}


def plain_words(text: str) -> list[str]:
    """The words of a text without case, marks, markup, entities, escapes, accents and look-alikes; a spaced course code is one word."""
    if "\\" in text:
        text = _CONTROL.sub(" ", _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    text = fold(text).lower().translate(_ASCII_MARKS)
    if not text.isascii():
        text = _MARKS.sub("", text)
    return _CODE.sub(r"\1\2", " ".join(text.split())).split()


def align(item: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """(score, edits, start, stop) of the best local alignment near a diagonal; start and stop are places of the item."""
    score, start, stop, places = align_path(item, words, diagonal, band)
    return score, len(places), start, stop


Edit = tuple[int, int, int, int]


def align_path(item: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int, list[Edit]]:
    """(score, start, stop, edits) of the best local alignment near a diagonal; edits are (place of the item, item words taken, place of the text, its words taken).

    The band is as wide as single words may be added or left out; ties go to the first end found. An added word stands before
    its place and takes no word of the item.
    """
    width = 2 * band + 1
    score, paths = [0] * (width + 2), [(None, 0)] * (width + 2)
    best = (0, 0, 0, None, 0)
    first = max(0, -diagonal - band)
    last = min(len(item), len(words) - diagonal + band)
    for i in range(first, last):
        x = item[i]
        now, path = [0] * (width + 2), [(None, i + 1)] * (width + 2)
        base = i + diagonal - band - 1
        for k in range(max(1, -base), min(width, len(words) - 1 - base) + 1):
            above, p = score[k], paths[k] if score[k] > 0 else (None, i)
            if x == words[base + k]:
                s = above + 2
            else:
                s, p, at, taken, held = above - 3, p, i, 1, 1
                if score[k + 1] - 3 > s:
                    s, p, held = score[k + 1] - 3, paths[k + 1], 0
                if now[k - 1] - 3 > s:
                    s, p, at, taken, held = now[k - 1] - 3, path[k - 1], i + 1, 0, 1
                if s > 0:
                    p = ((at, taken, held, p[0]), p[1])
            if s > 0:
                now[k], path[k] = s, p
                if s > best[0]:
                    best = (s, p[1], i + 1, p[0], base + k + 1)
        score, paths = now, path
    edits, link, i, j = [], best[3], best[2], best[4]
    while link is not None:
        at, taken, held, link = link
        j -= i - at - taken + held
        i = at
        edits.append((at, taken, j, held))
    return best[0], best[1], best[2], edits[::-1]


def is_leak(length: int, edits: int, item_words: int) -> bool:
    """Whether an aligned stretch of an item is long enough and has few enough edits."""
    if length >= item_words and edits == 0:
        return True
    return length >= MIN_WORDS if edits == 0 else length >= MIN_EDITED and edits * ALLOWED <= length


def is_shown_leak(length: int, edits: int, item_words: int) -> bool:
    """Whether a stretch all of whose edits are shown to be edits of a passage is a leak."""
    return length >= min(MIN_WORDS, item_words) and edits * SHOWN_ALLOWED <= length


def shown_edits(edits: list[Edit], words: list[str], vocabulary: set[str]) -> list[bool]:
    """Whether each edit is a single word left out or added with no edit beside it, or puts letters there that no item holds as a word."""
    out = []
    for n, (at, taken, place, held) in enumerate(edits):
        beside = n and edits[n - 1][0] + edits[n - 1][1] == at or n + 1 < len(edits) and edits[n + 1][0] == at + taken
        foreign = not held or words[place].isalpha() and words[place] not in vocabulary
        out.append(foreign if taken and held else not beside)
    return out


def leaked_stretch(start: int, stop: int, edits: list[Edit], item_words: int, shown: list[bool] | None = None) -> tuple[int, int, int] | None:
    """(score, length, edits) of the best stretch of an alignment that is a leak, from behind one edit up to another; or None."""
    shown = shown or [False] * len(edits)
    begins = [start, *(e[0] + e[1] for e in edits)]
    ends = [*(e[0] for e in edits), stop]
    best = None
    for i, a in enumerate(begins):
        for j in range(i, len(ends)):
            length = ends[j] - a
            if is_leak(length, j - i, item_words) or j > i and all(shown[i:j]) and is_shown_leak(length, j - i, item_words):
                left_out = sum(e[1] for e in edits[i:j])
                best = max(best or (0, 0, 0), (2 * (length - left_out) - 3 * (j - i), length, j - i))
    return best


def may_extend(item: list[str], words: list[str], diagonal: int, start: int, stop: int) -> bool:
    """Whether some MIN_WORDS words of the item around a run, or all of fewer, can nearly all stand near the run in the text.

    A passage with edits holds so many words with at most one edit in SHOWN_ALLOWED; a cheap bound that rejects no such passage.
    """
    size = min(MIN_WORDS, len(item))
    reach = size - 1
    near_by = set(words[max(0, start + diagonal - reach - BAND) : stop + diagonal + reach + BAND])
    lost = [x not in near_by for x in item[max(0, start - reach) : stop + reach]]
    missing = sum(lost[:size])
    least = missing
    for old, new in zip(lost, lost[size:]):
        missing += new - old
        least = min(least, missing)
    return least <= size // SHOWN_ALLOWED + 1


def reach(item: list[str], words: list[str], diagonal: int, start: int, stop: int) -> tuple[int, int]:
    """The part of an item that a leak around the run from start to stop can lie in.

    A leak has at least SHOWN_ALLOWED - 1 words that stand in the text for each that doesn't, so where the words to one side
    of the run are short of that by more than the run and the best of the other side make up for, it ends before.
    """
    near_by = set(words[max(0, diagonal - BAND) : max(0, len(item) + diagonal + BAND)])
    sums = [list(accumulate(1 if x in near_by else 1 - SHOWN_ALLOWED for x in part)) for part in (reversed(item[:start]), item[stop:])]
    most = [max(0, max(s, default=0)) for s in sums]
    left, right = (max((n for n, s in enumerate(own, 1) if s >= start - stop - other), default=0) for own, other in zip(sums, reversed(most)))
    return start - left, stop + right


def gram_hashes(words: list[str], n: int) -> np.ndarray:
    """A hash of each run of n words, by its place."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    out = np.full(max(len(words) - n + 1, 0), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return out.view(np.int64)


def best_passage(item: list[str], words: list[str], seeds: list[tuple[int, int]], vocabulary: set[str]) -> tuple[int, int] | None:
    """(length, edits) of the best passage of an item in a text, or None; seeds: (diagonal, place of the item) of each shared n-gram.

    vocabulary: of the words of the text, those that some item holds.
    """
    n = min(SEED, len(item))
    best, last, done, start = None, None, 0, 0
    ordered = sorted(seeds)
    for (diagonal, place), following in zip(ordered, [*ordered[1:], (None, None)]):
        if diagonal != last:
            last, start, done = diagonal, place, 0
        if following == (diagonal, place + 1):
            continue
        stop = place + n
        found = None
        if is_leak(stop - start, 0, len(item)):
            found = (2 * (stop - start), stop - start, 0)
        elif stop > done and may_extend(item, words, diagonal, start, stop):
            low, high = reach(item, words, diagonal, start, stop)
            found, done = _leak_behind(item, words, diagonal, max(low, done), high, start, vocabulary)
        best = max(filter(None, (best, found)), default=None)
        start = following[1]
    return best and best[1:]


def _leak_behind(
    item: list[str], words: list[str], diagonal: int, low: int, high: int, run: int, vocabulary: set[str]
) -> tuple[tuple[int, int, int] | None, int]:
    """The best leak of the alignments from low to high, up to the one that holds the run or lies behind it; and where that ends."""
    todo, best = [(low, high)], None
    stop = low
    while todo:
        lo, hi = todo.pop()
        score, a, b, edits = align_path(item[lo:hi], words, diagonal + lo)
        if not score:
            continue
        edits = [(lo + e[0], *e[1:]) for e in edits]
        found = leaked_stretch(lo + a, lo + b, edits, len(item), shown_edits(edits, words, vocabulary))
        best = max(filter(None, (best, found)), default=None)
        stop = max(stop, lo + b)
        if lo + a > run:
            todo.append((lo, lo + a))
    return best, stop


def find_leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key, words, edits), distinct, for each document and item of which it holds a passage.

    Null, empty and wordless texts on either side give no rows; repeated rows count once; an empty side gives none.
    """
    listed = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    known = materialize(spread(listed).mapInPandas(_fold_items, "item bigint, own bigint, words string"), "items")
    seeds = materialize(_seeds(known), "seeds")
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]
    texts = docs.select(F.col(doc_key).cast("bigint").alias("doc"), F.col(doc_text).alias("text")).where(F.length("text") > 0)
    texts = balanced(texts).withColumn("row", F.xxhash64("text"))
    grams = texts.mapInPandas(_text_grams(sizes), "doc bigint, row bigint, grams array<bigint>")
    each = grams.select("doc", "row", F.posexplode("grams").alias("at", "gram"))
    shared = each.join(broadcast_if_small(seeds.drop("size"), 64), "gram")
    pairs = shared.groupBy("doc", "row", "own").agg(F.collect_list(F.struct((F.col("at") - F.col("place")).alias("diagonal"), "place")).alias("seeds"))
    pairs = materialize(pairs, "pairs")
    some = pairs.select("doc", "row").distinct()
    held = texts.join(broadcast_if_small(some, 64), ["doc", "row"], "left_semi")
    told = materialize(held.distinct().mapInPandas(_fold_texts, "doc bigint, row bigint, words string"), "told")
    vocabulary = known.select(F.explode(F.split("words", " ")).alias("w")).distinct()
    own = told.select("doc", "row", F.explode(F.array_distinct(F.split("words", " "))).alias("w")).join(broadcast_if_small(vocabulary, 64), "w")
    own = own.groupBy("doc", "row").agg(F.array_join(F.collect_list("w"), " ").alias("vocabulary"))
    right = known.select("item", "own", F.col("words").alias("item_words"))
    held = pairs.join(broadcast_if_small(right, 8192), "own").groupBy("doc", "row").agg(F.collect_list(F.struct("item", "item_words", "seeds")).alias("pairs"))
    rows = spread(told.join(own, ["doc", "row"]).join(held, ["doc", "row"]).select("doc", "words", "vocabulary", "pairs"))
    out = materialize(rows.mapInPandas(_align_pairs, "doc bigint, item bigint, words int, edits int"), "leaks")
    release(known, seeds, pairs, told)
    return out.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "words", "edits").distinct()


def _seeds(known: DataFrame) -> DataFrame:
    """(gram, size, own, place) of the n-grams of the items (item, own, words) that are no set phrases, counted over all items."""
    every = known.mapInPandas(_item_grams, "gram bigint, size int, own bigint, place int")
    count = every.groupBy("gram").agg(F.count_distinct("own").alias("items"))
    most = max(COMMON_LEAST, int(COMMON_SHARE * known.count()))
    return every.join(broadcast_if_small(count.where(F.col("items") > most).select("gram"), 16), "gram", "left_anti")


def _fold_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """own: a key of the item and its text, since an item may come with several texts."""
    for batch in batches:
        rows = [(k, xxhash.xxh3_64_intdigest(f"{k} {t}") - (1 << 63), " ".join(w)) for k, t in zip(batch["item"], batch["text"]) if (w := plain_words(t))]
        yield pd.DataFrame(rows, columns=["item", "own", "words"])


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for own, words in zip(batch["own"], batch["words"]):
            w = words.split(" ")
            n = min(SEED, len(w))
            rows += [(g, n, own, place) for place, g in enumerate(gram_hashes(w, n))]
        yield pd.DataFrame(rows, columns=["gram", "size", "own", "place"])


def _text_grams(sizes: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch["doc"], batch["row"], batch["text"]):
                words = plain_words(text)
                rows += [(doc, row, g) for n in sizes if (g := gram_hashes(words, n)).size]
            yield pd.DataFrame(rows, columns=["doc", "row", "grams"])

    return run


def _fold_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc": batch["doc"], "row": batch["row"], "words": [" ".join(plain_words(t)) for t in batch["text"]]})


def _align_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text, its best passage of each item it shares seeds with; there are as many items as its n-grams are seeds of."""
    for batch in batches:
        rows = []
        for doc, words, known, pairs in batch.itertuples(index=False, name=None):
            text, vocabulary = words.split(" "), set(known.split(" "))
            for p in pairs:
                if found := best_passage(p["item_words"].split(" "), text, [(s["diagonal"], s["place"]) for s in p["seeds"]], vocabulary):
                    rows.append((doc, p["item"], *found))
        yield pd.DataFrame(rows, columns=["doc", "item", "words", "edits"])
