import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from lexloom.llm import bin_packing, queries, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, row int, size string"


def corpus():
    """Documents with toxic ones, near copies, nulls in every column, repeated rows and ids, empty and very long texts."""
    draw = np.random.default_rng(11)
    words = ["".join(draw.choice(list("abcdefghijklm"), 6)) for _ in range(400)]
    text = lambda n: " ".join(draw.choice(words, n))
    rows = []
    for i in range(120):
        t = text(int(draw.integers(20, 90)))
        if i % 6 == 0:
            t += " you stupid idiot, you moron " * 3
        rows.append([i, t, "en", f"s{i % 3}"])
    for i in range(120, 150):  # near copies of others
        rows.append([i, f"{rows[i - 117][1]} more", "fr", "s1"])
    rows += [[200, None, None, None], [201, "", "en", "s0"], [None, text(40), "en", "s0"], [203, text(30_000), "de", None], [204, text(50), "en", "s2"], [204, text(60), "en", "s2"], [205, text(30), "en", "s0"]]
    rows.append(list(rows[-1]))  # a repeated row
    return [(*r, len(r[1] or ""), "k", 2, 3, "x") for r in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("stupid" in r[1])) for r in rows if r[0] is not None and r[0] < 150] + [(None, 1, 1), (200, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    dense = model.dense()
    expected = [r for r in rows if sum(dense[x] for x in toxicity.feature_hashes(r[1]).tolist()) + model.bias < 0]
    kept = [tuple(r) for r in clean.collect()]
    assert Counter(kept) == Counter(expected)
    assert not any("stupid" in (r[1] or "") for r in kept) and sum("stupid" not in (r[1] or "") for r in rows) - len(kept) <= 2

    one = stage["near_duplicates"](spark, clean, sf_dir)
    assert one.columns == docs.columns
    sets = []
    for r in kept:
        w = (r[1] or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    left = Counter(tuple(r) for r in one.collect())
    assert sum(left.values()) == len(set(group)) and not left - Counter(kept)
    for g in set(group):
        own = [kept[i] for i in range(len(kept)) if group[i] == g]
        least = min((r[0] is None, r[0] or 0) for r in own)
        assert sum(left[r] for r in {r for r in own if (r[0] is None, r[0] or 0) == least}) >= 1

    mixed = stage["source_mixture"](spark, one, sf_dir)
    assert mixed.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, taken, longest = Counter(), Counter(), Counter()
    for r, n in left.items():
        by[r[3]] += n * size(r[1])
        longest[r[3]] = max(longest[r[3]], size(r[1]))
    sources = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_, total = {}, [s for s in sources if by[s]], float(sum(by.values()))
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * by[s]]
        target |= {s: 3.0 * by[s] for s in full} if full else share
        total -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    result = Counter(tuple(r) for r in mixed.collect())
    assert set(result) <= set(left) and all(n <= 3 * left[r] for r, n in result.items())
    for r, n in result.items():
        taken[r[3]] += n * size(r[1])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)

    packed = stage["packing"](spark, mixed, sf_dir).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bin_packing.vocabulary_path(bin_packing.VOCABULARY))
    pieces = Counter()
    for r, n in result.items():
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            pieces[r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += n
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == pieces
    fill = Counter()
    for p in sorted(packed, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill[p.sequence_id]
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_run_applies_all_stages(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_documents_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.count() > 0, name
        assert kept.join(before, "doc_id", "left_anti").isEmpty()
        if name == "near_duplicates":
            assert kept.count() == kept.select("doc_id").distinct().count() < before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.where("piece = 0").count() == kept.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) < set(names) and {*names, "pipeline"} < set(__spark_entry__.queries())
