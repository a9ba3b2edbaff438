from __future__ import annotations

import random

from pyspark.sql import functions as F

from quadrille import runtime
from quadrille.llm import leakage
from quadrille.llm.leakage import SEED, align, best_passage, gram_hashes, is_leak, plain_words

RNG = random.Random(11)
POOL = [a + b for a in ("bar", "cor", "dun", "fen", "gul", "hol", "mar", "nes") for b in ("ak", "el", "in", "ost", "um", "yr")]


def passage(n):
    return [RNG.choice(POOL) for _ in range(n)]


def found_in(items, text):
    """The items of which a text holds a passage, by the seeds they share."""
    w, vocabulary, out = plain_words(text), {x for i in items.values() for x in i}, []
    for key, item in items.items():
        n = min(SEED, len(item))
        places = {}
        for place, g in enumerate(gram_hashes(item, n)):
            places.setdefault(g, []).append(place)
        seeds = [(at - place, place) for at, g in enumerate(gram_hashes(w, n)) for place in places.get(g, ())]
        if seeds and best_passage(item, w, seeds, vocabulary):
            out.append(key)
    return out


def slow_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -3), h[i - 1][j] - 3, h[i][j - 1] - 3)
            best = max(best, h[i][j])
    return best


def test_band_gives_the_score_of_the_whole_table():
    for _ in range(30):
        a, b = passage(40), passage(60)
        b[10:40] = a[5:35]
        for _ in range(3):
            b[RNG.randrange(60)] = "x"
        assert align(a, b, 5)[0] == slow_align(a, b)


def test_forms_do_not_count():
    text = "<p>The <b>soft</b>-hyphen­&eacute;té, “FERN 150” Ｗｉｄｅ d\\u00e9j\\u00e0 open-\nair &amp; l'eau*</p>"
    assert plain_words(text) == "the softhyphenete fern150 wide deja openair leau".split() or plain_words(text)[-5:] == ["fern150", "wide", "deja", "openair", "leau"]


def test_passages(spark, monkeypatch):
    """Equal rows for any number of partitions, with and without a broadcast of the seeds and items."""
    items = {1: passage(60), 2: passage(70), 3: passage(15), 4: passage(8)}
    noise = lambda n: ["zz" + w for w in passage(n)]
    edited = items[2][10:50]
    edited[9] = "other"
    edited[21:22] = []
    edited.insert(30, "also")
    docs = [
        (1, noise(30) + items[1] + noise(30)),
        (2, noise(9) + items[1][20:35] + noise(9)),
        (3, noise(9) + items[1][20:34] + noise(9)),
        (4, noise(9) + edited + noise(9)),
        (5, items[3] + noise(4) + items[1][3:25]),
        (6, noise(5) + items[4] + noise(5)),
        (7, noise(200)),
    ]
    rows = [(k, " ".join(w).upper().replace(" ", ",\n"), 0) for k, w in docs] + [(8, None, 0), (9, "", 0), (10, " ... ", 0), (1, docs[0] and " ".join(docs[0][1]), 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, item int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(5, None), (6, ""), (7, "?!")], "item_id bigint, text string")
    want = {(1, 1), (2, 1), (4, 2), (5, 3), (5, 1), (6, 4)}
    for least in (8 << 20, 0):
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", least)
        for parts in (1, 5):
            got = leakage.find_leaks(table.repartition(parts), "doc_id", "text", bench.repartition(parts), "item_id", "text").select("doc_id", "item_id").distinct()
            assert {tuple(r) for r in got.collect()} == want
    none = bench.where(F.lit(False))
    assert leakage.find_leaks(table, "doc_id", "text", none, "item_id", "text").collect() == []
    assert leakage.find_leaks(table.where(F.lit(False)), "doc_id", "text", bench, "item_id", "text").collect() == []


def test_seeds_lose_no_accepted_alignment():
    """Random edits: whatever the full alignment accepts, the seeded search finds."""
    items = {1: passage(60)}
    for _ in range(200):
        w = list(items[1][RNG.randrange(20) : RNG.randrange(30, 60)])
        for _ in range(RNG.randrange(0, 5)):
            w[RNG.randrange(len(w))] = "x" + RNG.choice(POOL)
        text = ["qq"] * 20 + w + ["qq"] * 20
        _, edits, start, stop = max(align(items[1], text, d) for d in range(-40, 25))
        if is_leak(stop - start, edits, 60):
            assert found_in(items, " ".join(text))


def test_a_good_stretch_of_a_bad_alignment_is_found():
    """30 words with 2 edits are a leak alone, also where the alignment runs on through 20 words with 6 edits."""
    item = [f"i{n}" for n in range(50)]
    w = list(item)
    for at in (9, 19, 30, 33, 36, 39, 42, 45):
        w[at] = "x"
    _, edits, start, stop = align(item, w, 0)
    assert not is_leak(stop - start, edits, 50)
    assert found_in({1: item}, " ".join(["q"] * 9 + w + ["q"] * 9)) == [1]


def test_stretches_agree_with_brute_force():
    for _ in range(300):
        stop = RNG.randrange(10, 60)
        taken = sorted(RNG.sample(range(1, stop - 1), RNG.randrange(0, 8)))
        edits = [(at, RNG.randrange(2)) for at in taken]
        inside = lambda a, b: sum(a <= at and at + t <= b and (t or a < at < b) for at, t in edits)
        want = any(is_leak(b - a, inside(a, b), 99) for a in range(stop) for b in range(a + 1, stop + 1))
        assert bool(leakage.leaked_stretch(0, stop, edits, 99)) == want


def test_edited_short_passages_are_found_and_other_fillers_are_not():
    item, other = [f"i{n}" for n in range(60)], [f"o{n}" for n in range(60)]
    hits = lambda w: found_in({1: item, 2: other}, " ".join(["q"] * 9 + w + ["q"] * 9))
    short = item[20:36]
    assert hits(short[:7] + ["mispelt"] + short[8:]) == [1]
    assert hits(short[:7] + short[8:]) == [1]
    assert hits(short[:7] + ["added"] + short[7:]) == [1]
    spread = [w if n % 8 != 7 else "mispelt" for n, w in enumerate(item)]
    assert hits(spread) == [1]
    assert hits(short[:7] + ["o5"] + short[8:]) == [] and hits(short[:7] + ["1999"] + short[8:]) == []
    assert hits(short[:13]) == []
