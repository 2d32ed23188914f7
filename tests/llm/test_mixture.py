"""Sources whose rows share or lack ids reach their targets, too."""

from collections import Counter

import pytest

from lexloom.llm import source_mixture


@pytest.fixture(scope="module")
def rows():
    text = lambda i: "w " * (i % 17 + 1)
    none = [(None, f"{text(i)}{i}", "a", i) for i in range(300)]
    one = [(7, f"{text(i)}{i}", "b", i) for i in range(300)]
    own = [(1000 + i, f"{text(i)}{i}", "c", i) for i in range(300)]
    equal = [(9, "five words stand in here", "d", i) for i in range(200)] + [(None, None, "d", i) for i in range(5)] + [(None, "five words stand in here", "e", 0)] * 200
    return none + one + own + equal


@pytest.mark.parametrize("numbers", [source_mixture.NUMBERS, 7])
def test_every_source_is_within_a_document_of_its_target(spark, rows, monkeypatch, numbers):
    monkeypatch.setattr(source_mixture, "NUMBERS", numbers)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(6)
    got = source_mixture.mixture(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len((t or "").split())) for i, t, s, _ in rows)
    for s in "abcde":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken <= 3 * r.size for r in own)
    again = source_mixture.mixture(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.source, r.content, r.taken) for r in again) == Counter((r.doc_id, r.source, r.content, r.taken) for r in got)


def test_the_mix_has_each_rows_copies(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").selectExpr("*", "1 AS `a.b`", "2 AS copies").repartition(6)
    taken = Counter()
    for r in source_mixture.mixture(docs).collect():
        taken[r.doc_id, r.source, r.content] += r.copies
    mix = source_mixture.mixed(docs)
    assert mix.columns == docs.columns
    found = Counter((r.doc_id, r.source, r.c) for r in mix.select("doc_id", "source", source_mixture.content().alias("c")).collect())
    assert found == +taken
    each = Counter((r.doc_id, r.source, r.text, r.n) for r in mix.collect())
    partly = {k: n for k, n in each.items() if k[1] in ("d", "e")}
    assert {n for k, n in partly.items() if k[0] == 9} <= {1, 2, 3} and max(each.values()) <= 3 * 200
