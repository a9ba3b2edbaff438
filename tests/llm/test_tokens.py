from __future__ import annotations

import random

from pyspark.sql import functions as F

from quadrille.llm import tokens


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def sample():
    rng = random.Random(7)
    words = ["tide", " harbour", "  ", "\n", "don't", "42", " Größe", "日本語", "🎓🏽", "...", "​", "x" * 30, "\t \t", " ", "'re", "<|endoftext|>"]
    return ["".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(25)]


def test_ids_are_those_of_the_whole_text_when_it_is_cut(spark):
    texts = [*sample(), "", None, " ", "z" * 5000, " " * 3000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, key int")
    want = whole([t or "" for t in texts])
    for chunk, overlap in ((1 << 20, 4096), (400, 120), (1000, 64)):
        got = {r["key"]: list(r["ids"]) for r in tokens.encode_table(docs, "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
        assert got == dict(enumerate(want))


def test_round_trip_and_empty_table(spark):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = tokens.decode_table(tokens.encode_table(docs, "doc_id", "text", chunk=500, overlap=100))
    assert {r["key"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    assert tokens.encode_table(docs.where(F.lit(False)), "doc_id", "text").collect() == []


def test_repeated_rows_keep_their_number(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c " * 900), (2, "c " * 900)], "doc_id bigint, text string")
    got = tokens.encode_table(docs, "doc_id", "text", chunk=400, overlap=100).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {1: 2, 2: 2}


def test_pieces_alone_give_the_ids_of_the_whole_text():
    """Short chunks, so that every text is stitched many times; blanks, marks and contractions on the seams."""
    rng, encoder = random.Random(3), tokens.load()
    parts = [" ", "  ", "\n", "a", "bc", "'s", ".", "..", "é", "日", "1", "23", "\u200b", "don't", "\t", " x", "\x1c", "\x85", "\xa0"]
    for chunk, overlap in ((40, 20), (64, 30), (16, 8)):
        for _ in range(400):
            text = "".join(rng.choices(parts, k=rng.randrange(0, 200)))
            cut = list(tokens.pieces(text, chunk, overlap))
            assert "".join(cut) == text and [i for p in cut for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)
    assert len(list(tokens.pieces("tide tables " * 900))) > 8
