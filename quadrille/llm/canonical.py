"""Mapping of freely entered values to the entries of a canonical list.

Each distinct value is read in a few ways (without affixes, turned around, abbreviations spelled out), and each reading is
looked up in a BK-tree over the entries. The tree holds letters only, under the Levenshtein distance, which is a true
metric, so the triangle inequality prunes and every entry within the radius comes back. Of these the least
Damerau-Levenshtein distance wins. A list up to ``SHARD_ENTRIES`` is one tree, broadcast; a longer one is cut into shards by
a hash of the entry, every value is searched in every shard, and ``decide`` merges the shards' winners.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.folding import fold
from quadrille.runtime import broadcast_if_small, kept_on_worker, materialize, spread

#: Entries of one tree; a longer list is cut into shards of about this size.
SHARD_ENTRIES = 50_000
#: Values searched in one group of a shard.
GROUP_VALUES = 20_000
#: Words around a program's name that are no part of it.
LEADING = (
    "honours", "honors", "hons", "hon", "joint honours", "jh", "h", "bsc", "ba", "basc", "bachelor of", "b a sc", "b sc", "b a",
    "msc", "major in", "minor in", "option in", "students in", "students of", "student in", "in", "the", "program in",
)
TRAILING = (
    "students only", "students", "student", "majors only", "majors", "major", "minors", "minor", "program", "programme", "plan",
    "option", "co op", "coop", "regular", "only",
)
_LEAD = re.compile(r"^(?:" + "|".join(sorted(LEADING, key=len, reverse=True)) + r")\s+(?=\S)")
_TRAIL = re.compile(r"(?<=\S)\s+(?:" + "|".join(sorted(TRAILING, key=len, reverse=True)) + r")$")
_TURNED = re.compile(r"^(.+?)(?:\s*[,:]\s*|\s+[-–—]\s+|\s+of\s+)(.+)$")


def allowed(length: int) -> int:
    """Edits allowed for an entry of so many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


def radius(length: int) -> int:
    """Levenshtein radius that holds every entry whose Damerau-Levenshtein distance to so many letters is allowed.

    A swap counts 2 under Levenshtein, so that distance is at most twice the other; an entry may be longer by what is allowed.
    """
    return 2 * allowed(length + allowed(12))


def letters(text: str) -> str:
    """Only letters and digits, in lower case."""
    return re.sub(r"[\W_]+", "", text.lower())


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def levenshtein(a: str, b: str) -> int:
    """Bit-parallel Levenshtein distance (Myers)."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = (ph << 1 | 1) & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return score


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric."""
    most = len(a) + len(b)
    seen: dict[str, int] = {}
    d = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m = seen.get(b[j - 1], 0), last
            same = a[i - 1] == b[j - 1]
            if same:
                last = j
            d[i + 1][j + 1] = min(
                d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        seen[a[i - 1]] = i
    return d[-1][-1]


class BKTree:
    """Entries under Levenshtein distance; ``within`` returns every entry at most radius away."""

    def __init__(self, entries: Iterator[str] | list[str]):
        self.root: tuple[str, dict] | None = None
        for e in entries:
            self.add(e)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        node = self.root
        while True:
            d = levenshtein(node[0], entry)
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (entry, {})
                return
            node = node[1][d]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        found: list[tuple[int, str]] = []
        todo = [self.root] if self.root else []
        while todo:
            entry, below = todo.pop()
            d = levenshtein(entry, query)
            if d <= radius:
                found.append((d, entry))
            todo.extend(child for at, child in below.items() if d - radius <= at <= d + radius)
        return found


def readings(value: str) -> list[str]:
    """Ways to read a value, the plainest first: affixes cut one by one, and each turned around a comma, colon, dash or of."""
    text = fold(value)
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text) if not re.search(r"\s", text.strip()) else text
    text = re.sub(r"\s+", " ", text.lower()).strip(" .;()[]\"'")
    out: list[str] = []
    todo = [text]
    while todo:
        t = todo.pop(0).strip(" .;,-–—()[]")
        if not t or t in out:
            continue
        out.append(t)
        flat = re.sub(r"[^\w&,:]+", " ", t).strip()
        for cut in (_LEAD.sub("", flat, count=1), _TRAIL.sub("", flat, count=1)):
            if cut != flat:
                todo.append(_keep_marks(t, cut))
        if m := _TURNED.match(t):
            todo.append(f"{m[2]} {m[1]}")
    return out


def _keep_marks(full: str, cut: str) -> str:
    """The part of full that holds exactly the letters of cut, with the marks between them."""
    want = letters(cut)
    at = letters(full).find(want)
    places = [i for i, c in enumerate(full) if c.isalnum()]
    return full[places[at] : places[at + len(want) - 1] + 1] if at >= 0 and want else cut


def _short_for(short: str, word: str) -> bool:
    """Whether one word abbreviates the other: a beginning, or letters in order with the first one kept."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return short == word
    if word.startswith(short):
        return True
    rest = iter(word)
    return all(c in rest for c in short) if len(short) >= 3 else False


#: Kinds of candidates, the surest first.
NAME, CODE, JOINED, LOOSE, HEAD, SHORT, TYPO = range(7)

Candidate = tuple[int, int, int, int]


class Canon:
    """Entries ready to be searched: a tree of names, codes for exact use, and a trie of words for abbreviations.

    The entries may be one shard of a list; ``candidates`` gives what this shard knows, ``decide`` the outcome of all shards.
    """

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.names: dict[str, int] = {}
        self.codes: dict[str, int] = {}
        self.joined: dict[str, int] = {}
        self.vocabulary: set[str] = set()
        self.trie: dict = {}
        #: What an entry begins with: its key, and whether only its last word is missing.
        self.heads: dict[str, set[tuple[int, bool]]] = defaultdict(set)
        for key, name, code in sorted(entries, key=lambda e: e[0]):
            w = words(fold(name))
            if not w:
                continue
            self.names.setdefault("".join(w), key)
            self.joined.setdefault("".join(x for x in w if x != "and"), key)
            if code and letters(code):
                self.codes.setdefault(letters(code), key)
            self.vocabulary.update(w)
            node = self.trie
            for x in w:
                if x != "and":
                    node = node.setdefault(x, {})
            node.setdefault(None, key)
            for n in range(1, len(w)):
                self.heads["".join(w[:n])].add((key, n == len(w) - 1))
        self.tree = BKTree(sorted(self.names))

    def spelled_out(self, tokens: list[str]) -> list[int]:
        """Keys of the entries that the tokens give word by word, each in full or abbreviated."""
        level = [self.trie]
        for t in tokens:
            level = [below for node in level for w, below in node.items() if w is not None and _short_for(t, w)]
            if not level:
                return []
        return sorted({node[None] for node in level if None in node})

    def candidates(self, ways: list[str]) -> tuple[set[str], list[Candidate]]:
        """The words of the readings that some entry holds, and (kind, distance, second distance, key) of all that they may mean."""
        known_words, found = set(), []
        plain = [letters(w) for w in ways]
        for n, (w, p) in enumerate(zip(ways, plain)):
            for kind, known in ((NAME, self.names), (CODE, self.codes), (JOINED, self.joined)):
                if p in known:
                    found.append((kind, n, 0, known[p]))
            for q in (letters(w.replace("&", " and ")), letters(w.replace("&", " ").replace(" and ", " "))):
                for known in (self.names, self.joined):
                    if q in known:
                        found.append((LOOSE, n, 0, known[q]))
        if found and min(found)[0] <= LOOSE:
            return known_words, [min(found)]
        for n, (w, p) in enumerate(zip(ways, plain)):
            found += [(HEAD, n, 0 if cut else 1, key) for key, cut in self.heads.get(p, ())]
            tokens = [t for t in words(w) if t != "and"]
            found += [(SHORT, n, 0, key) for key in self.spelled_out(tokens)]
            known_words.update(self.vocabulary.intersection(tokens))
            for lev, entry in self.tree.within(p, radius(len(p))):
                if abs(len(entry) - len(p)) <= allowed(len(entry)) and (d := damerau(entry, p)) <= allowed(len(entry)):
                    found.append((TYPO, d, lev, self.names[entry]))
        return known_words, found


def decide(ways: list[str], known_words: set[str], found: list[Candidate]) -> tuple[int, int]:
    """(key, distance) of the entry meant, of all shards' candidates; key -1 if none.

    Exact readings come first. A beginning counts if one entry alone begins so and lacks only its last word. A value made of
    the list's own words in another combination means none of its entries. Then come abbreviations that fit one entry alone,
    then the least Damerau-Levenshtein distance, then the least Levenshtein distance, then the least key.
    """
    sure = [c for c in found if c[0] <= LOOSE]
    if sure:
        return min(sure)[3], 0
    for n in range(len(ways)):
        heads = {(c[3], c[2]) for c in found if c[0] == HEAD and c[1] == n}
        if len({k for k, _ in heads}) == 1 and (next(iter(heads))[0], 0) in heads:
            return next(iter(heads))[0], 0
    for w in ways:
        tokens = {t for t in words(w) if t != "and"}
        if tokens and tokens <= known_words:
            return -1, 0
    for n in range(len(ways)):
        keys = {c[3] for c in found if c[0] == SHORT and c[1] == n}
        if len(keys) == 1:
            return next(iter(keys)), 0
    typos = [c for c in found if c[0] == TYPO]
    return (min(typos)[3], min(typos)[1]) if typos else (-1, 0)


_FOUND = "value string, key bigint, distance int"


def map_values(values: DataFrame, entries: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(value, key, distance) for each distinct value of the one column of values; key is -1 for values that mean no entry.

    entries: (key bigint, name string, code string); entries with a null key or name are left out, of equal names the least
    key counts. Nulls and blank values give no row. An empty list maps everything to -1. Ties go as ``decide`` says.
    """
    spark = values.sparkSession
    name = values.columns[0]
    distinct = values.select(F.col(name).alias("value")).where(~F.col("value").rlike(BLANK)).distinct()
    refs = entries.select("key", "name", "code").where(F.col("key").isNotNull() & F.col("name").isNotNull()).distinct()
    shards = max(1, -(-refs.count() // shard_entries))
    if shards == 1:
        listed = spark.sparkContext.broadcast([tuple(r) for r in refs.collect()])
        listed_id = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            canon = kept_on_worker(("canon", listed_id), lambda: Canon(listed.value))
            for batch in batches:
                got = [decide(ways, *canon.candidates(ways)) for ways in map(readings, batch["value"])]
                yield pd.DataFrame({"value": batch["value"], "key": [g[0] for g in got], "distance": [g[1] for g in got]})

        return spread(distinct).mapInPandas(run, _FOUND)
    groups = max(1, -(-distinct.count() // GROUP_VALUES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = refs.select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), every(groups).alias("part"), "key", "name", "code")
    left = distinct.select(every(shards).alias("shard"), F.pmod(F.xxhash64("value"), F.lit(groups)).cast("int").alias("part"), "value")

    def search(vals: pd.DataFrame, refs_: pd.DataFrame) -> pd.DataFrame:
        canon = Canon(list(refs_[["key", "name", "code"]].itertuples(index=False, name=None)))
        got = [canon.candidates(readings(v)) for v in vals["value"]]
        return pd.DataFrame({"value": vals["value"], "known": [sorted(g[0]) for g in got], "found": [[list(c) for c in g[1]] for g in got]})

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(search, "value string, known array<string>, found array<array<bigint>>")
    merged = found.groupBy("value").agg(F.flatten(F.collect_set("known")).alias("known"), F.flatten(F.collect_list("found")).alias("found"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [decide(readings(v), set(m), [tuple(map(int, c)) for c in f]) for v, m, f in zip(batch["value"], batch["known"], batch["found"])]
            yield pd.DataFrame({"value": batch["value"], "key": [g[0] for g in got], "distance": [g[1] for g in got]})

    return merged.mapInPandas(merge, _FOUND)


#: Only white space.
BLANK = r"^[\s\p{Z}]*$"


def map_rows(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """rows with columns key and distance added, for rows whose value is not blank and no entry's exact name."""
    exact = entries.select(F.col("name").alias("exact_name")).where(F.col("exact_name").isNotNull()).distinct()
    open_ = rows.where(F.col(column).isNotNull() & ~F.col(column).rlike(BLANK))
    open_ = open_.join(exact, F.col(column) == F.col("exact_name"), "left_anti")
    found = materialize(map_values(open_.select(column), entries), "mapped")
    return open_.join(broadcast_if_small(found, 120), open_[column] == found["value"]).drop("value")
