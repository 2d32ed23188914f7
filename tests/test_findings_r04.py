"""What the findings of round 4 said, in small."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.operators import communities, frequencies
from lexloom.plans import queries


def test_packed_words_are_held_a_few_rows_at_once(spark):
    """A row group, and a batch that Python got, had all packed rows of a task, and executors ran out of memory."""
    word = lambda x: F.concat(F.lit("w"), F.pmod(F.xxhash64(x, "id"), F.lit(30_000)))
    docs = spark.range(16).coalesce(1).select(F.transform(F.sequence(F.lit(1), F.lit(300_000)), word).alias("words"))
    held = frequencies.packed(docs, "words")
    (path,) = held.inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(sizes) == 16 and max(sizes) < 12 and max(meta.row_group(i).total_byte_size for i in range(len(sizes))) < 2**24

    def batches(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    got = [r.n for r in held.mapInArrow(batches, "n long").collect()]
    assert sum(got) == 16 and max(got) < 12


def test_only_filters_that_are_read_are_made(spark, monkeypatch):
    """All levels' filters, also the last one's, which no level reads, were sent to count the candidates."""
    made, sent = [], []
    bits, counted = frequencies.bits_of, frequencies.candidate_frequencies
    monkeypatch.setattr(frequencies, "bits_of", lambda hashes, n: made.append(n) or bits(hashes, n))
    monkeypatch.setattr(frequencies, "candidate_frequencies", lambda docs, words, passes, candidates: sent.append((len(passes), len(candidates))) or counted(docs, words, passes, candidates))
    rows = [(["a", "b", "a", f"x{i % 7}"],) for i in range(60)] + [(["c"],)] * 50
    got = frequencies.pruned_vocabulary(spark.createDataFrame(rows, "words array<string>"), "words", 110, 2, 2, 1.0, 3)
    assert sorted((r.df, r.gram) for r in got.collect()) == [(60, "a"), (60, "a b"), (60, "b")]
    assert sent == [(1, 2)] and made[0] == 10 and made[1:] == [2, 2]  # a and b, and their pairs, are all that reaches 60


@pytest.mark.parametrize("here", [200_000, 0])
def test_communities_are_sought_until_nothing_gains(spark, monkeypatch, here):
    """F8: the query stopped after two levels of three rounds; a bound on levels or rounds stood for the end of the search."""
    asked = []
    plain = communities.louvain
    links = communities.undirected(spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "parent long, child long"))
    monkeypatch.setattr(communities, "HERE", here)
    monkeypatch.setattr(communities, "louvain", lambda _, *a, **more: asked.append((a, more)) or plain(links, *a, **more))
    rows = queries.louvain_communities(spark, "/root/testdata/sf0.001").collect()
    assert asked == [((), {})] and len(rows) == 30
    of, value = {r.node: r.community for r in rows}, rows[0].modularity
    size = Counter(of.values())
    inside = Counter(of[i] for i in range(30) if of[i] == of[(i + 1) % 30])
    assert abs(value - sum(inside[c] / 30 - (2 * n / 60) ** 2 for c, n in size.items())) < 1e-9
    # No two neighbouring communities gain by being one.
    for a, b in {(of[i], of[(i + 1) % 30]) for i in range(30)}:
        assert a == b or 1 / 30 - 2 * (2 * size[a]) * (2 * size[b]) / 60**2 < 1e-3
