"""Texts that were cut off before their own end.

Two kinds of evidence are put together. (1) Near-copies: a cut copy is like the beginning of its original, however much is
missing. Min-hash signatures are taken of the first 10, 20, 40, ... words of every text, and a text that ends openly is banded
by its longest such beginnings with the same beginnings of all others. Pairs in one band must also share the words at
the open end, with the other text going on there inside a sentence; then exact similarity of the text and as many words of the
other is asked, the pair is aligned, and the text whose alignment ends early is cut. (2) For texts that no copy shows to be
cut, terminality: how a last unit without a full stop closes elsewhere. Over the whole corpus it is counted, for each
beginning of a unit (a sentence or line), how often units that begin so go on to a full stop and how often they end openly, as
headings, list items and signatures do, and for each word how often it goes on and how often it closes a unit. A text is cut
if the longest known beginning of its last unit is one of sentences that go on to a full stop, or if its closing word shows
it: it hardly ever ends a unit elsewhere, or it is no word of the corpus but the beginning of words that are.

Every text is read once for its end, its counts and its signatures; only texts that share a band are read again. Exact copies
count as one text.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.folding import fold
from quadrille.runtime import balanced, broadcast_if_small, materialize, release, spread

#: Words of a shingle, least similarity of a copy, bands and rows of the min-hash.
SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 12, 5
#: Words of the shortest beginning that is signed; each further one is twice as long. Words that pairs share at an open end.
LEAST_HEAD, CONTEXT = 10, 2
#: Beginnings by which a text with an open end is looked up.
KEYED = 2
#: Counted names after which a partition's counts are sent on and begun anew.
FLUSH = 200_000
#: Tokens of the beginning of a unit that terminality looks at.
PREFIX = 5
#: The longest mark or remnant behind a cut, in characters; the first piece of a text's end that is searched for its last units.
REMNANT, WINDOW = 512, 1024
#: So many ends of texts alone don't show how units with a beginning close; a shorter beginning is asked then.
FEW_ENDS = 3
#: Letters by which names are matched to beginnings of them.
KEY = 4
#: A closing word shows a cut if it goes on so many times as often as it ends a unit, and so many times at least.
GOES_ON, LEAST_INNER = 100, 20

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)

#: What systems leave behind a cut.
_REMNANT = re.compile(
    r"(?:…|\.\.\.+|\[\s*(?:more|cut|truncated|continued|…|\.\.\.)\s*\]|\(?\s*(?:read|see|show) more\s*\)?|\(\s*(?:more|truncated|continued)\s*\)|�+"
    r"|</?[A-Za-z]?[^<>]*|&(?:a|am|amp|n|nb|nbs|nbsp|l|lt|g|gt|q|qu|quo|quot|#\w*)?)\s*$",
    re.IGNORECASE,
)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
#: Marks that end a sentence, and marks that may stand behind them.
_STOPS, _BEHIND = ".!?。！？؟।", "'\"’”»)]"
#: Words whose full stop ends no sentence.
_ABBREVIATED = re.compile(r"(?:^|\s)(?:prof|dr|mr|mrs|ms|mme|st|pp|fig|vs|e\.g|i\.e)\.$", re.IGNORECASE)
_UNITS = regex.compile(r"""(?<=[.!?。！？؟।]['"’”»)\]]?)\s+|\s*[\r\n]+\s*""")
_CODE = re.compile(r"\b[A-Za-z]{2,6} ?\d{3}[A-Za-z]?\b")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W_]+")


def trimmed(text: str) -> str:
    """Text without blanks, pictures and invisible characters at its end."""
    at = len(text)
    while at and ((c := text[at - 1]).isspace() or c > "\x7f" and unicodedata.category(c) in ("So", "Sk", "Cf", "Mn")):
        at -= 1
    return text[:at]


def plain(text: str) -> str:
    """Text without tags and entities; a block tag ends a line."""
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if m[0].lower().startswith(("</p", "<p", "<br", "</h", "<h", "</l", "<l", "</d", "<d")) else "", text)
    return html.unescape(text) if "&" in text else text


def without_remnant(text: str) -> tuple[str, bool]:
    """The text up to a mark or remnant of a cut, and whether there was one."""
    text = text.rstrip()
    marked = False
    while (at := _remnant_at(text)) >= 0:
        text, marked = text[:at].rstrip(), True
    return text, marked


def _remnant_at(text: str) -> int:
    """Where a mark or remnant at the end begins, or -1. An open tag may be as long as REMNANT characters."""
    before = max(0, len(text) - REMNANT)
    open_tag = text.rfind("<", before) > text.rfind(">", before)
    if not (text[-1:] in "…])�" or open_tag or text.endswith("...") or "&" in text[-10:] or text[-4:].lower() == "more"):
        return -1
    m = _REMNANT.search(text, before)
    return m.start() if m and m.start() < len(text) else -1


def stops(text: str) -> bool:
    """Whether a text ends with a full stop, quotes and brackets behind it included."""
    bare = text.rstrip(_BEHIND)
    return bool(bare) and bare[-1] in _STOPS


def ends_well(text: str) -> bool:
    return stops(text) and not _ABBREVIATED.search(text[-12:])


def units(text: str) -> list[str]:
    """Sentences and lines; a full stop behind an abbreviation ends none."""
    out: list[str] = []
    joined = False
    for u in _UNITS.split(text):
        if not u or u.isspace():
            continue
        if joined:
            out[-1] += " " + u
        else:
            out.append(u)
        joined = bool(_ABBREVIATED.search(u[-12:]))
    return out


def alike(text: str) -> str:
    """Text with course codes and digits made alike."""
    return _DIGIT.sub("9", _CODE.sub("C", text))


def beginnings(unit: str) -> list[str]:
    """The beginnings of a unit by 1 to PREFIX tokens."""
    tokens = unit.split(None, PREFIX)[:PREFIX]
    return [" ".join(tokens[:k]) for k in range(1, len(tokens) + 1)]


def unit_words(unit: str) -> list[str]:
    """The words of a unit in small letters without marks; a course code, made alike, is C."""
    return [w if w == "C" else w.lower() for w in _LETTERS.findall(fold(unit))]


def closing_word(unit: str) -> str:
    """The last word of a unit, made alike, or '' if it is a course code or holds a digit."""
    words = unit_words(unit[-WINDOW:])
    return words[-1] if words and words[-1].isalpha() and words[-1] != "C" else ""


def tail(text: str) -> tuple[str, bool, str]:
    """(last unit without a full stop, '' if the text ends with one or is a phrase; whether a mark follows; the unit before).

    A text of one unit that begins with a small letter or holds none at all is a phrase, such as a logged search, unless a
    mark follows it. The end of the text is read in a window that grows until it holds two units before the last or is the
    whole text, so the outcome is that of the whole text.
    """
    body, marked = without_remnant(text)
    size = WINDOW
    while True:
        piece = body[-size:]
        if size < len(body) and "<" in piece[: REMNANT // 2]:
            piece = piece[piece.index("<") :]
        got = _tail(piece, marked)
        if got is not None and (size >= len(body) or got[3] > 3):
            return got[:3]
        if size >= len(body):
            return "", marked, ""
        size *= 4


def _tail(piece: str, marked: bool) -> tuple[str, bool, str, int] | None:
    body = trimmed(plain(piece))
    while (at := _remnant_at(body)) >= 0:
        marked |= body[at] != "&"
        body = trimmed(body[:at])
    if not body:
        return None
    if ends_well(body):
        return "", marked, "", 99
    parts = units(body)
    if not parts or not marked and len(parts) == 1 and (parts[0].lstrip()[:1].islower() or parts[0].upper() == parts[0]):
        return "", marked, "", len(parts)
    return parts[-1], marked, parts[-2] if len(parts) > 1 else "", len(parts)


_COUNTED = pa.schema([("doc", pa.int64()), ("marked", pa.bool_()), ("open", pa.bool_()), ("begins", pa.list_(pa.string())), ("whole", pa.bool_()), ("before", pa.int64()), ("closing", pa.string()), ("same", pa.string()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kind", pa.string()), ("name", pa.string()), ("stopped", pa.int64()), ("opened", pa.int64())])
_DDL = "doc bigint, marked boolean, open boolean, begins array<string>, whole boolean, before bigint, closing string, same string, n int, keys array<bigint>, bands array<bigint>, ends array<bigint>, kind string, name string, stopped bigint, opened bigint"
#: Kinds of rows of the one pass: a document, a beginning of a unit, a word.
DOCUMENT, BEGINNING, WORD = "document", "beginning", "word"


def _read_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with its end and signatures, and rows with counts of beginnings and words for what was read since the last ones."""
    counts = [Counter() for _ in range(4)]
    for batch in batches:
        seen: tuple[list[str], ...] = ([], [], [], [], [])
        rows = [_end_of(text) | _count_units(text, *seen) for text in batch["text"].to_pylist()]
        for counter, names in zip(counts, seen):
            counter.update(names)
        counts[2].subtract(seen[4])
        columns = {f.name: [r.get(f.name) for r in rows] for f in _COUNTED} | {"doc": batch["doc"], "kind": [DOCUMENT] * len(rows)}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _COUNTED], schema=_COUNTED)
        if sum(map(len, counts)) > FLUSH:
            yield _counted(*counts)
            counts = [Counter() for _ in range(4)]
    yield _counted(*counts)


def _end_of(text: str) -> dict:
    unit, marked, before = tail(text)
    if not unit:
        return {"marked": marked}
    like = alike(unit)
    begins = beginnings(like)
    return {"marked": marked, "begins": begins, "whole": len(like.split()) == len(begins), "before": xxhash.xxh3_64_intdigest(before) - (1 << 63), "closing": closing_word(like)}


def last_words(unit: str) -> list[str]:
    """The last word of a unit as ``unit_words`` gives it, in a list that is empty if it has none."""
    return unit_words(unit.rsplit(None, 1)[-1])[-1:] or unit_words(unit)[-1:]


def _count_units(text: str, stopped: list[str], opened: list[str], words: list[str], final: list[str], last: list[str]) -> dict:
    """Adds what the units of a text count for; gives its end and signatures for the comparison of copies.

    Units with a full stop and open units count by their beginnings; the last unit of a text counts if it stops. words: all
    words; last: those that end a unit, behind which it doesn't go on; final: those of them that count as its end.
    """
    whole = plain(without_remnant(text)[0])
    body = trimmed(alike(whole))
    words += unit_words(body)
    parts = units(body)
    for n, u in enumerate(parts, 1):
        stop = stops(u) or stops(trimmed(u))
        ending = last_words(u)
        last += ending
        if n < len(parts) or stop:
            final += ending
        if stop:
            stopped += beginnings(u)
        elif n < len(parts):
            opened += beginnings(u)
    return signature(_WORDS.findall(fold(whole).lower()), not ends_well(trimmed(whole)))


def _counted(stopped: Counter, opened: Counter, inner: Counter, final: Counter) -> pa.RecordBatch:
    names, words = list(stopped.keys() | opened.keys()), list(inner.keys() | final.keys())
    columns = {
        "kind": [BEGINNING] * len(names) + [WORD] * len(words),
        "name": names + words,
        "stopped": [stopped[x] for x in names] + [inner[x] for x in words],
        "opened": [opened[x] for x in names] + [final[x] for x in words],
    }
    size = len(names) + len(words)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _COUNTED], schema=_COUNTED)


def read_once(texts: DataFrame) -> DataFrame:
    """The one pass over texts (doc, text): rows of all three kinds, written."""
    return materialize(texts.mapInArrow(_read_once, _DDL), "read")


def _known(read: DataFrame, kind: str) -> DataFrame:
    """(name, stopped, opened) of a kind, over the whole corpus."""
    return read.where(F.col("kind") == kind).groupBy("name").agg(F.sum("stopped").alias("stopped"), F.sum("opened").alias("opened"))


def begun_by(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """names (name, ...) joined to every wanted (begin) that begins the name, by the first letters of both."""
    sized = names.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(KEY))))).withColumn("key", F.substr("name", F.lit(1), F.col("k")))
    keyed = wanted.select("begin", F.least(F.length("begin"), F.lit(KEY)).alias("k")).withColumn("key", F.substr("begin", F.lit(1), F.col("k")))
    return sized.join(broadcast_if_small(keyed, 80), ["k", "key"]).where(F.startswith("name", "begin")).drop("k", "key")


def cut_by_terminality(read: DataFrame) -> DataFrame:
    """(doc) of the texts of ``read_once`` that a mark or the terminality of their last unit shows to be cut.

    The ends of texts count once per different unit before them, so copies of one cut text don't make its end look meant. The
    whole last unit, whose last word may be half a word, counts only where sentences begin with it; a last unit of one word
    counts by all first words that it begins. A unit that begins like no other is taken as meant, unless its closing word
    shows a cut (``cut_words``).
    """
    tails = read.where(F.col("begins").isNotNull()).select("doc", "marked", "begins", "whole", "before", "closing")
    unmarked = tails.where(~F.col("marked"))
    kinds = materialize(unmarked.select("begins", "whole", "before", "closing").distinct(), "ends")
    asked = kinds.select("begins", "whole", "before", F.posexplode("begins").alias("k", "begin"))
    wanted = asked.groupBy("begin", (F.size("begins") == 1).alias("alone")).agg(F.count_distinct("before").alias("ends"))
    wanted = materialize(wanted, "begins")
    every = _known(read, BEGINNING).withColumnRenamed("name", "begin")
    plainly = wanted.where(~F.col("alone")).join(every.join(broadcast_if_small(wanted.select("begin").distinct(), 80), "begin", "left_semi"), "begin", "left")
    single = begun_by(_known(read, BEGINNING).where(~F.col("name").contains(" ")), wanted.where("alone").select("begin"))
    single = single.groupBy("begin").agg(F.sum("stopped").alias("stopped"), F.sum(F.when(F.col("name") == F.col("begin"), F.col("opened"))).alias("opened"))
    alone = wanted.where("alone").join(single, "begin", "left")
    stopped, opened = F.coalesce("stopped", F.lit(0)), F.coalesce("opened", F.lit(0))
    known = plainly.unionByName(alone).where((stopped + opened > 0) | (F.col("ends") > FEW_ENDS))
    known = materialize(known.select("begin", "alone", stopped.alias("stopped"), (opened + F.col("ends") - 1).alias("opened")), "known")
    last = F.col("whole") & (F.col("k") == F.size("begins") - 1) & (F.size("begins") > 1)
    named = asked.select("begins", "whole", "k", "begin", (F.size("begins") == 1).alias("alone")).distinct()
    found = named.join(broadcast_if_small(known, 100), ["begin", "alone"]).where(~last | (F.col("stopped") > 0))
    best = found.groupBy("begins", "whole").agg(F.max_by(F.struct("stopped", "opened"), "k").alias("b"))
    cut = best.where(F.col("b.stopped") > F.col("b.opened")).select("begins", "whole")
    by_unit = unmarked.join(broadcast_if_small(cut, 160), ["begins", "whole"], "left_semi").select("doc")
    words = cut_words(_known(read, WORD), kinds.where(F.col("closing") != "").groupBy("closing").agg(F.count_distinct("before").alias("ends")))
    by_word = unmarked.join(broadcast_if_small(words, 32), "closing", "left_semi").select("doc")
    return by_unit.unionByName(by_word).unionByName(tails.where("marked").select("doc")).distinct()


def cut_words(words: DataFrame, closings: DataFrame) -> DataFrame:
    """(closing) of closing words (closing, ends) that show a cut, by the counts of all words.

    A word shows it that goes on GOES_ON times as often as it ends a unit, here or elsewhere, or half a word, which occurs
    nowhere in the corpus though longer words begin so.
    """
    begun = begun_by(words, closings.select(F.col("closing").alias("begin")))
    own, times = F.col("name") == F.col("begin"), F.col("stopped") + F.col("opened")
    sums = begun.groupBy("begin").agg(*[F.coalesce(F.sum(F.when(w, c)), F.lit(0)).alias(n) for w, c, n in ((own, F.col("stopped"), "inner"), (own, F.col("opened"), "final"), (~own, times, "longer"))])
    t = closings.join(sums.withColumnRenamed("begin", "closing"), "closing")
    again = F.col("final") + F.col("ends") - 1
    goes_on = (F.col("inner") >= LEAST_INNER) & (F.col("inner") > GOES_ON * again)
    half = (F.col("inner") + F.col("final") == 0) & (F.col("longer") > FEW_ENDS) & (F.col("longer") > GOES_ON * (F.col("ends") - 1))
    return t.where(goes_on | half).select("closing")


def running_shingles(words: list[str]) -> np.ndarray:
    """A hash of each run of SHINGLE words, by its place."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    out = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
            out ^= out >> np.uint64(29)
    return out


def shingle_hashes(words: list[str]) -> np.ndarray:
    return np.unique(running_shingles(words))


_WORDS = re.compile(r"\w+")


def copy_words(text: str) -> list[str]:
    """Words to compare copies by."""
    return _WORDS.findall(fold(plain(without_remnant(text)[0])).lower())


def heads(n: int) -> list[int]:
    """The lengths of the beginnings of n words that are signed, the longest last."""
    out = []
    while LEAST_HEAD << len(out) <= n:
        out.append(LEAST_HEAD << len(out))
    return out


def context(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def signature(words: list[str], open_: bool) -> dict:
    """same: a hash of the words; bands: of all signed beginnings, keys: of the KEYED longest; ends: of the words at an open end.

    The last word of an open end may be half a word, so the words before it are an end, too.
    """
    out = {"open": open_, "n": len(words), "same": xxhash.xxh3_128_hexdigest(f"{open_} {' '.join(words)}"), "bands": [], "keys": [], "ends": []}
    lengths = heads(len(words))
    if not lengths:
        return out
    shingles = running_shingles(words[: lengths[-1]])
    with np.errstate(over="ignore"):
        mixed = shingles[:, None] * _A + _B
    mixed ^= mixed >> np.uint64(31)
    cuts = [0, *(n - SHINGLE + 1 for n in lengths[:-1])]
    least = np.minimum.accumulate(np.minimum.reduceat(mixed, cuts, axis=0), axis=0)
    rows = least.reshape(len(lengths), BANDS, ROWS)
    mixed = np.array(lengths, dtype=np.uint64)[:, None] * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
    out["bands"] = (mixed ^ (mixed >> np.uint64(32))).view(np.int64).ravel()
    out["keys"] = out["bands"][-KEYED * BANDS :]
    if open_:
        out["ends"] = [context(words[-CONTEXT:]), context(words[-CONTEXT - 1 : -1])]
    return out


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = shingle_hashes(a), shingle_hashes(b)
    both = np.intersect1d(x, y, assume_unique=True).size
    return both / (x.size + y.size - both)


_TOKEN = re.compile(r"\S+")
_CLEAN = re.compile(r"[\W_]+")


def _tokens(text: str) -> list[tuple[str, bool]]:
    """(word, whether a sentence or line ends behind it)."""
    out = []
    body = trimmed(plain(without_remnant(text)[0]))
    for u in _UNITS.split(body):
        own = [w for w in (_CLEAN.sub("", fold(t).lower()) for t in _TOKEN.findall(u)) if w]
        out += [(w, False) for w in own[:-1]] + [(w, True) for w in own[-1:]]
    return out


def ends_early(text: str, other: str) -> bool:
    """Whether a text, aligned with the beginning of a near-copy, stops inside a word or sentence of it."""
    a, b = _tokens(text), _tokens(other)
    b = b[: len(a) + len(a) // 4 + SHINGLE]
    if len(a) < 2 or len(b) < 2:
        return False
    blocks = difflib.SequenceMatcher(None, [w for w, _ in a], [w for w, _ in b], autojunk=False).get_matching_blocks()
    last = next((m for m in reversed(blocks) if m.size), None)
    if last is None:
        return False
    stop_a, stop_b = last.a + last.size, last.b + last.size
    if stop_a == len(a):
        if stop_b == len(b) or b[stop_b - 1][1]:
            return False
        return not ends_well(trimmed(plain(without_remnant(text)[0])))
    if stop_a == len(a) - 1 and stop_b < len(b):
        x, y = a[-1][0], b[stop_b][0]
        return len(x) < len(y) and y.startswith(x)
    return False


def is_cut_copy(text: str, other: str) -> bool:
    """Whether a text is like as many words of the beginning of the other and ends early there."""
    a, b = copy_words(text), copy_words(other)
    return len(a) >= SHINGLE and len(b) >= SHINGLE and jaccard(a, b[: max(len(a), SHINGLE)]) >= SIMILAR and ends_early(text, other)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(x, b) for x, b, text, other in zip(batch["x"], batch["b"], batch["text"], batch["other"]) if is_cut_copy(text, other)]
        yield pd.DataFrame(rows, columns=["x", "b"])


def _goes_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's contexts behind which a sentence goes on."""
    for batch in batches:
        rows = []
        for b, text in zip(batch["b"], batch["text"]):
            w, inside = [], []
            for u in _UNITS.split(trimmed(plain(without_remnant(text)[0]))):
                own = _WORDS.findall(fold(u).lower())
                w += own
                inside += range(len(w) - len(own) + 1, len(w))
            rows.append((b, sorted({context(w[i - CONTEXT : i]) for i in inside if i >= CONTEXT})))
        yield pd.DataFrame(rows, columns=["b", "contexts"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, b) of the pairs whose x is a cut copy of b."""
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("x").alias("doc")).union(pairs.select("b")).distinct()
    some = materialize(texts.join(broadcast_if_small(ids, 16), "doc", "left_semi").dropDuplicates(["doc"]), "some")
    full = pairs.join(some.withColumnRenamed("doc", "x"), "x").join(some.select(F.col("doc").alias("b"), F.col("text").alias("other")), "b")
    out = materialize(spread(full).mapInPandas(_verify, "x bigint, b bigint"), "verified")
    release(pairs, some)
    return out


def copy_links(texts: DataFrame, read: DataFrame) -> DataFrame:
    """(x, b): for each open text that a near-copy shows to be cut, at least one such pair; equal texts are one.

    First every x is held against the longest text of each of its bands that goes on behind its end, so a band of any size
    costs one pair for each of its texts; only those that this doesn't show to be cut meet the band's other such texts.
    """
    one = read.where((F.col("kind") == DOCUMENT) & (F.size("keys") > 0)).groupBy("same").agg(F.min_by(F.struct("doc", "n", "keys", "bands", "ends"), "doc").alias("s"))
    one = materialize(one.select("s.*"), "texts")
    keyed = one.where(F.size("ends") > 0).select(F.col("doc").alias("x"), "ends", F.explode("keys").alias("band"))
    near = one.select(F.col("doc").alias("b"), F.col("n").alias("size"), F.explode("bands").alias("band"))
    near = materialize(near.join(broadcast_if_small(keyed.select("band").distinct(), 16), "band", "left_semi"), "near")
    crowd = materialize(near.groupBy("band").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("band"), "crowd")
    keyed = keyed.join(broadcast_if_small(crowd, 16), "band", "left_semi").select("band", "x", F.explode("ends").alias("context")).distinct()
    keyed = materialize(keyed, "keyed")
    near = near.join(broadcast_if_small(crowd, 16), "band", "left_semi")
    held = texts.withColumnRenamed("doc", "b").join(broadcast_if_small(near.select("b").distinct(), 16), "b", "left_semi")
    on = held.mapInPandas(_goes_on, "b bigint, contexts array<bigint>").select("b", F.explode("contexts").alias("context")).distinct()
    on = materialize(on.join(broadcast_if_small(keyed.select("context").distinct(), 16), "context", "left_semi"), "goes_on")
    going = materialize(near.join(on, "b").select("band", "context", "size", "b"), "going")
    longest = going.groupBy("band", "context").agg(F.max(F.struct("size", "b")).alias("m")).select("band", "context", F.col("m.b").alias("b"))
    other = F.col("x") != F.col("b")
    first = keyed.join(longest, ["band", "context"]).where(other).select("x", "b").distinct()
    shown = verified(first, texts)
    rest = keyed.join(broadcast_if_small(shown.select("x").distinct(), 16), "x", "left_anti")
    second = rest.join(going, ["band", "context"]).where(other).select("x", "b").distinct().join(first, ["x", "b"], "left_anti")
    links = materialize(shown.unionByName(verified(second, texts)), "links")
    release(one, near, crowd, keyed, on, going, shown)
    return links


def cut_by_copies(texts: DataFrame, read: DataFrame) -> DataFrame:
    """(doc) of texts that a near-copy shows to be cut, their exact copies included."""
    cut = copy_links(texts, read).select(F.col("x").alias("doc")).distinct()
    own = read.where(F.col("kind") == DOCUMENT).select("doc", "same")
    same = own.join(broadcast_if_small(cut, 16), "doc", "left_semi").select("same").distinct()
    return own.join(broadcast_if_small(same, 64), "same", "left_semi").select("doc")


def find_cut(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of each distinct row whose text was cut off inside a word or sentence.

    Null, empty and blank texts are never cut, nor are texts that end as meant (with a full stop, or openly like a heading, a
    list item, a signature or a search phrase). Texts of fewer than LEAST_HEAD words are judged by terminality alone. An
    empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}]"))
    texts = balanced(texts)
    read = read_once(texts)
    found = materialize(cut_by_terminality(read).unionByName(cut_by_copies(texts, read)).distinct(), "cut")
    release(read)
    return found.withColumnRenamed("doc", key)


def cut_rates(docs: DataFrame, cut: DataFrame, key: str, source: str) -> DataFrame:
    """(source, documents, cut, share) per source, of all rows; the share is null for none."""
    marked = docs.select(key, source).distinct().join(cut.withColumn("is_cut", F.lit(1)), key, "left")
    out = marked.groupBy(source).agg(F.count("*").alias("documents"), F.coalesce(F.sum("is_cut"), F.lit(0)).alias("cut"))
    return out.withColumn("share", F.col("cut") / F.col("documents"))
