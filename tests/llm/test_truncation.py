from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm import truncation as T

SENTENCES = ["Students measure tide tables at the old mill.", "Topics include wake losses, kelp beds and sand.", "Why do dunes change once rain falls?", "Readings on kerning pair well with the lab.", "My group had to draw maps at the bell tower!", "The unit contrasts forges with lagoons, drawing on maps."]


def document(rng, n=6):
    return " ".join(f"{s[:-1]} in lot {rng.randrange(10**6)}{s[-1]}" for s in rng.choices(SENTENCES, k=n))


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = document(rng)
        if i % 6 == 1:
            text += "\nOffice of Course Records"
        elif i % 6 == 2:
            text += f"\n- Week 1: kerning {i}\n- Week 2: beam spread"
        elif i % 6 == 3:
            text = "<p>" + text + "</p>\ncheers :) "
        rows.append((i, text))
    return rng, rows


CUT = ["Students measure tide tab", "Topics include wake losses, kelp", "Why do dun…", "My group had to draw maps at... (read more)", "<p>Readings on kerning pai</p>", "Readings on kerning pair w</", "The unit contrasts &am", "Partial: Topics inc�"]
MEANT = ["rain gauges course", "TIDE 100", "n/a", "Office of Course Records", "- Week 1: kerning 3\n- Week 2: beam spread", "Done. 🌊", "Done.&nbsp;</p>"]


def test_ends():
    rng, rows = corpus()
    assert T.tail("A b c. 🌊 ")[0] == "" and T.tail("Go. And then we...")[:2] == ("And then we", True)
    assert T.tail("  ")[0] == "" and T.tail("Held before Prof.")[0] == "Held before Prof."


def test_found(spark):
    rng, rows = corpus()
    n = 1000
    want = set()
    for t in CUT:
        rows.append((n, document(rng, 2) + " " + t))
        want.add(n)
        n += 1
    for t in MEANT:
        rows.append((n, (document(rng, 2) + "\n" if n % 2 and "course" not in t and "TIDE" not in t else "") + t))
        n += 1
    full = document(rng, 14)
    cut = full[: len(full) - 4]
    rows += [(2000, full), (2001, cut), (2002, cut), (2003, full + "\nOffice of Course Records"), (2004, full), (2001, cut)]
    want |= {2001, 2002}
    rows += [(3000, None), (3001, ""), (3002, " \n​")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, doc int")
    got = {r["doc_id"] for r in T.find_cut(table, "doc_id", "text").collect()}
    assert got == want
    texts = table.select(F.col("doc_id").alias("doc"), "text").where(F.length("text") > 3)
    by_copies = {r["doc"] for r in T.cut_by_copies(texts, T.read_once(texts)).collect()}
    assert {2001, 2002} <= by_copies <= want


def test_a_copy_shows_an_end_that_looks_meant():
    full = " ".join(SENTENCES * 3) + " It was sold by Prof. Quill in 7.25 lots."
    assert T.ends_early(full[: full.index("25 lots")], full)
    assert not T.ends_early(full, full)
    assert not T.ends_early(" ".join(SENTENCES * 3), full)


WORDS = [a + b for a in ("bar", "cor", "dun", "fen", "gul", "hol", "mar", "nes") for b in ("ak", "el", "in", "ost", "um", "yr", "ap", "och")]


def links(spark, rows):
    texts = spark.createDataFrame(rows, "doc bigint, text string")
    return [tuple(r) for r in T.copy_links(texts, T.read_once(texts)).collect()]


def test_copies_cut_anywhere_are_found(spark):
    """The share of planted copies, cut inside a sentence at a tenth to nearly all of their length and edited, that banding and alignment find."""
    rng = random.Random(9)
    rows, planted = [], set()
    for i in range(400):
        w = rng.choices(WORDS, k=rng.randrange(120, 300))
        keep = max(14, int(len(w) * rng.uniform(0.1, 0.97)))
        c = w[:keep]
        for at in range(keep - 4):
            if rng.random() < 0.015:
                c[at] = "zz" + c[at]
        last = c[-1] if i % 2 else c[-1][:2]
        rows += [(i, " ".join(w) + "."), (1000 + i, " ".join(c[:-1] + [last]))]
        if T.jaccard([*c[:-1], last], w[:keep]) >= T.SIMILAR:
            planted.add(1000 + i)
    found = {x for x, _ in links(spark, rows)}
    assert found <= planted and len(planted) > 200 and len(found) >= 0.97 * len(planted), (len(found), len(planted))


def test_half_a_text_is_a_cut_copy():
    full = " ".join(WORDS[:40]) + ". " + " ".join(WORDS[40:60]) + "."
    half = " ".join(WORDS[:30])
    assert T.jaccard(T.copy_words(half), T.copy_words(full)) < 0.5 and T.is_cut_copy(half, full)
    assert not T.is_cut_copy(" ".join(WORDS[:40]), full) and not T.is_cut_copy(full, half)


def test_crowded_band_costs_a_pair_for_each_text(spark, monkeypatch):
    """Thousands of different texts of one template, a third of them cut at the same place: each cut one is found, without all pairs."""
    rng = random.Random(4)
    body, tail = rng.choices(WORDS, k=45), rng.choices(WORDS, k=20)
    rows = [(i, " ".join([body[0], f"n{i}"] + body[1:] + ["lot", f"m{i}"] + tail) + ".") for i in range(2000)]
    rows += [(5000 + i, " ".join([body[0], f"k{i}"] + body[1:43])) for i in range(1000)]
    sizes, kept = [], T.verified
    monkeypatch.setattr(T, "verified", lambda pairs, texts: (sizes.append(pairs.count()), kept(pairs, texts))[1])
    assert {x for x, _ in links(spark, rows)} == {5000 + i for i in range(1000)}
    assert sum(sizes) <= 24 * len(rows)


def test_a_copy_of_the_longest_text_still_meets_the_others(spark):
    """Z is cut, as a copy of X shows that goes on behind its end; the longest text of its band stops there."""
    w = rng_words = random.Random(2).choices(WORDS, k=130)
    texts = [(1, " ".join(w[:83]) + ". " + " ".join(rng_words[90:])), (2, " ".join(w[:100]) + "."), (3, " ".join(w[:83]))]
    assert (3, 2) in links(spark, texts)


def test_closing_words_show_cuts_of_long_open_units(spark):
    """Units that begin like contact lines, which end openly, are cut if their last word is half a word or always goes on."""
    rng = random.Random(7)
    line = "Contact the department advising office"
    rows = [(i, document(rng) + f"\n{line} of hall {rng.choice('abc')}\n" + document(rng, 2) + f"\n{line}") for i in range(30)]
    rows += [(100, document(rng) + "\nContact the department advising offi"), (101, document(rng) + f"\n{line} of"), (102, document(rng) + f"\n{line}")]
    table = spark.createDataFrame(rows, "doc bigint, text string")
    assert {r["doc"] for r in T.cut_by_terminality(T.read_once(table)).collect()} == {100, 101}


@pytest.mark.parametrize("keep", [False])
def test_empty(spark, keep):
    table = spark.createDataFrame([(1, "a")], "doc_id bigint, text string").where(F.lit(keep))
    assert T.find_cut(table, "doc_id", "text").collect() == []
