"""Column names with dots, and media that are no containers."""

import random

from lexloom.llm import iso_media, ngram_jaccard, toxicity


def test_columns_with_dots_and_quotes(spark):
    rows = [(i, f"some words about topic {i % 7} and {'idiot moron' if i % 4 == 0 else 'nothing'} more {i}", f"s{i % 2}", i, f"q{i}") for i in range(60)] + [(None, "some words without an id at all", "s0", 1, "q"), (3, "another text of an id that is there twice", "s1", 2, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, `c``d` string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} <= set(range(60))
    one = ngram_jaccard.one_of_each(docs)
    assert one.columns == docs.columns and sorted(map(tuple, one.collect()), key=repr) == sorted(rows, key=repr)


def test_media_that_cannot_be_read(spark):
    draw = random.Random(5)
    odd = [draw.randbytes(n) for n in (1, 7, 8, 50, 500)] + [b"\0\0\0\x08moov", b"\0\0\0\x10moov\0\0\0\x08trak", b"\0\0\0\0" * 20, b"\xff" * 40, b"plain text that is no container at all"]
    got = iso_media.tracks(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(odd)] + [(99, None), (98, bytearray())], "doc_id long, media binary")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(odd))) and all(r.error and r.track is None for r in got)
