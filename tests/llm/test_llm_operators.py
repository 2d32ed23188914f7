import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import arrow_sequences, bin_packing, components, iso_media, license_scan, masked_lm, ngram_jaccard, site_style_tree, source_mixture, toxicity, vptree_ann

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
BASE = "the quick brown fox jumps over the lazy dog while seven wizards boil large pots of green soup near an old stone bridge"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " tonight", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, LONG, "fr", "b"), (6, LONG, "fr", "b"), (7, "one two", "de", None),
    (8, "   \n\t ", "en", "c"), (9, "one two", "de", "c"), (None, "no id here at all", "en", "a"), (10, "é😀 Ünïcode  text\n\nLicensed under the Apache License, Version 2.0.", "es", "c"), (11, "you stupid idiot moron", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [(*r, 0, "x", 1, 2) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, slot int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_sequences_round_trip(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(arrow_sequences.vocabulary_path(arrow_sequences.VOCABULARY))
    index = arrow_sequences.write_sequences(docs, folder=f"file://{tmp_path}/s", length=64)
    got = arrow_sequences.read_sequences(index).collect()
    assert len(got) == len(ROWS)
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ROWS}
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    file = index.where("doc_id = 6").head().file
    reader = arrow_sequences.SequenceReader(file)
    row, mask = reader.sequence(0)
    assert len(row) == 64 and len(mask) == 64 and not row.flags.owndata
    assert sum(sum(reader.sequence(i)[1].to_pylist()) for i in range(sum(b.num_rows for b in reader.batches))) == sum(r.n_tokens for r in index.where(f"file = '{file}'").collect())
    assert arrow_sequences.token_digest(empty).count() == 0


def test_packing(docs, empty):
    got = bin_packing.packed_sequences(docs).collect()
    assert bin_packing.packed_sequences(empty).count() == 0
    by = Counter(r.doc_id for r in got)
    assert set(by) == {r[0] for r in ROWS} and by[6] > 2
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and r.start == r.piece * 2048 and 1 <= r.length <= 2048
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and len(fill) - -(-sum(fill.values()) // 2048) <= 1
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bin_packing.vocabulary_path(bin_packing.VOCABULARY))
    expected = Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected.update((doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected


def test_packing_over_shards(spark):
    """Worst-filled bins of all shards are packed again together; tiny pieces and repeated rows end as well."""
    draw = np.random.default_rng(2)
    for lengths in (draw.integers(1, 1500, 900).tolist(), [1] * 700, [2047] * 30, [5] * 400 + [1024] * 100):
        rows = [(i, 7, 0, 0, n, 9) for i, n in enumerate(lengths)]  # equal but for their own row numbers
        got = bin_packing.pack(spark.createDataFrame(rows, bin_packing._PIECES), shard_rows=128).collect()
        fill = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == fill[r.sequence_id]
            fill[r.sequence_id] += r.length
        assert len(got) == len(lengths) and max(fill.values()) <= 2048
        bins: list = []
        fills: list = []
        bin_packing.best_fit(bins, fills, list(range(len(lengths))), lengths, 2048)
        assert len(fill) <= len(bins) * 1.01 + 8


def test_packing_search_is_a_partition_and_no_worse_than_best_fit():
    from random import Random

    draw = Random(5)
    lengths = [draw.randint(1, 1200) for _ in range(400)]
    first = bin_packing.first_population(lengths, 2048, draw)
    last = bin_packing.evolve(first, lengths, 2048, draw, 10)
    for p in (*first, *last):
        assert sorted(i for b in p.bins for i in b) == list(range(400)) and max(p.fills) <= 2048
    assert len(last[0].bins) <= min(len(p.bins) for p in first)
    bins: list = []
    bin_packing.best_fit(bins, [], list(range(400)), lengths, 2048)
    assert len(last[0].bins) <= len(bins)
    assert last[0].genes(400).tolist() == bin_packing.Packing.of(last[0].genes(400), lengths).genes(400).tolist()


def test_media(docs, empty):
    got = {r.doc_id: r for r in iso_media.media_features(docs).collect()}
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, math.ceil(len(raw) / 192)) * 192)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        media = iso_media.wrap(payload)
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest(), len(media))
        assert r.codec == "raw " and r.keyframes[0].end - r.keyframes[0].start == 192
    assert got[1].media_sha256 == got[2].media_sha256 and got[4].feature == got[5].feature
    data = iso_media.wrap(bytes(range(192)) * 40)
    (info,) = iso_media.inspect(data)
    assert b"".join(data[a:b] for a, b in info["ranges"]) == bytes(range(192)) * 40 and info["duration"] == 40
    with pytest.raises(ValueError):
        list(iso_media.boxes(data[:100]))
    assert iso_media.media_features(empty).count() == 0


def _track(number, handler, codec, scale, duration, sizes, chunks, per_chunk, keys, version):
    """A hand-made track; times have 64 bits in version 1."""
    box, full = iso_media._box, lambda kind, *parts, v=0, flags=0: iso_media._box(kind, struct.pack(">I", v << 24 | flags), *parts)
    t = "Q" if version else "I"
    head = full(b"tkhd", struct.pack(f">{t}{t}II{t}", 0, 0, number, 0, duration), bytes(60), v=version)
    media = full(b"mdhd", struct.pack(f">{t}{t}I{t}HH", 0, 0, scale, duration, 0, 0), v=version)
    entry = full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8)))
    tables = [entry, full(b"stts", struct.pack(">III", 1, len(sizes), 5)), full(b"stsc", struct.pack(">IIII", 1, 1, per_chunk, 1)), full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), full(b"stco", struct.pack(f">I{len(chunks)}I", len(chunks), *chunks))]
    if keys is not None:
        tables.append(full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
    return box(b"trak", head, box(b"mdia", media, full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", box(b"stbl", *tables))))


def test_media_of_other_makers(spark):
    """Audio before video, both versions of the headers, several chunks, and movie fragments."""
    box, full = iso_media._box, lambda kind, *parts, flags=0: iso_media._box(kind, struct.pack(">I", flags), *parts)
    audio = _track(1, b"soun", b"mp4a", 48_000, 96_000, [10, 11], [1000, 2000], 1, None, 0)
    video = _track(2, b"vide", b"avc1", 90_000, 180_000, [7, 8, 9], [3000, 4000], 2, [1, 3], 1)
    live = _track(3, b"vide", b"hvc1", 1000, 0, [], [], 1, None, 0)
    extends = box(b"mvex", full(b"trex", struct.pack(">IIIII", 3, 1, 40, 100, 0x10000)))
    data = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", audio, video, live, extends)
    moof = len(data)
    run = full(b"trun", struct.pack(">IiI", 3, 500, 0x2000000), flags=0x1 | 0x4)  # the first sample alone is a key frame
    more = full(b"trun", struct.pack(">IIII", 1, 30, 77, 0), flags=0x100 | 0x200 | 0x400)
    data += box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 3), flags=0x20000), run, more))
    a, v, f = iso_media.inspect(data)
    assert (a["codec"], a["handler"], a["duration"] / a["timescale"]) == ("mp4a", "soun", 2.0) and a["keyframes"] == [(1000, 1010), (2000, 2011)]
    assert (v["codec"], v["timescale"], v["duration"]) == ("avc1", 90_000, 180_000) and v["ranges"] == [(3000, 3007), (3007, 3015), (4000, 4009)]
    assert v["keyframes"] == [(3000, 3007), (4000, 4009)]
    at = moof + 500
    assert f["samples"] == 4 and f["duration"] == 150 and f["ranges"] == [(at, at + 100), (at + 100, at + 200), (at + 200, at + 300), (at + 300, at + 377)]
    assert f["keyframes"] == [(at, at + 100), (at + 300, at + 377)]
    got = iso_media.tracks(spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.track, r.codec, r.duration_s, len(r.keyframes)) for r in got] == [(1, 1, "mp4a", 2.0, 2), (1, 2, "avc1", 2.0, 2), (1, 3, "hvc1", 0.15, 2)]


def test_jaccard(docs, empty):
    got = {r.doc_id: r for r in ngram_jaccard.ngram_jaccard(docs).collect()}
    assert (got[1].class_id, got[2].class_id, got[3].class_id) == (1, 1, 1)
    assert (got[1].n_links, got[3].n_links, got[2].copy_id, got[3].copy_id) == (2, 2, 1, 3)
    assert got[6].n_links == 1 and got[7].class_id == got[9].class_id == 7
    assert [got[i].n_links for i in (4, 5, 8)] == [0, 0, 0] and got[5].class_id == 5
    assert ngram_jaccard.ngram_jaccard(empty).count() == 0
    kept = [r.doc_id for r in ngram_jaccard.one_of_each(docs).collect()]
    assert sorted(kept, key=lambda x: x or 0) == [None, 1, 4, 5, 6, 7, 8, 10, 11]


def test_jaccard_of_rows_without_ids_and_with_repeated_ids(spark):
    words = BASE.split()
    near = [" ".join([*words, f"extra{i}"]) for i in range(3)]
    rows = [(None, near[0], "a"), (None, near[1], "b"), (None, near[1], "c"), (7, "one text of the id seven that is long", "a"), (7, "another text of the id seven, also long", "b"), (7, "one text of the id seven that is long", "c"), (8, "something else with words of its own", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_jaccard.ngram_jaccard(df).collect())
    assert got == [(0, 0, 2)] * 3 + [(7, 7, 0), (7, 7, 1), (7, 7, 1), (8, 8, 0)]
    kept = ngram_jaccard.one_of_each(df).collect()
    assert ngram_jaccard.one_of_each(df).columns == df.columns
    texts = Counter(r.text for r in kept)
    assert texts[rows[3][1]] == texts[rows[4][1]] == texts[rows[6][1]] == 1 and texts[near[0]] + texts[near[1]] == 1 and len(kept) == 4
    again = spark.createDataFrame([*rows, (3, near[2], "z")], df.schema)  # now the group has a member with an id
    assert sorted((r.doc_id or 0) for r in ngram_jaccard.one_of_each(again).collect()) == [3, 7, 7, 8]


def test_jaccard_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(50):
        words = list(base)
        for at in draw.integers(0, 60, draw.integers(0, 3)):
            words[at] = f"x{draw.integers(0, 3)}"
        texts.append((i, " ".join(words)))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    linked = [[j for j in range(50) if j != i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])] for i in range(50)]
    got = ngram_jaccard.ngram_jaccard(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_links for r in got] == [len(x) for x in linked]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.a, r.b) for r in components.components(links).collect()} == {(i, 1) for i in range(2, 41)} | {(101, 100)}


def test_bands():
    b = ngram_jaccard.bands_for(0.8, 0.9999, 8)
    assert 1 - (1 - 0.8**8) ** b >= 0.9999 > 1 - (1 - 0.8**8) ** (b - 1)


def test_mixture(docs, empty):
    got = source_mixture.mixture(docs).collect()
    assert len(got) == len(ROWS) and source_mixture.mixture(empty).count() == 0
    sizes = [(r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in ROWS]
    by = Counter()
    for s, n in sizes:
        by[s] += n
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - sum(by.values())) < 1e-6
    for r in got:
        assert r.source_size == by[r.source] and r.target <= 3 * r.source_size + 1e-9 and r.taken <= 3 * r.size and r.taken == r.copies * r.size


def test_mixture_targets_against_reshared_caps(spark):
    rows = [(chr(97 + i), n) for i, n in enumerate((10, 500, 3, 70, 1, 40))] + [(None, 7)]
    got = {r.source: r.target for r in source_mixture.targets(spark.createDataFrame([(s, n, 1.0) for s, n in rows], "source string, size long, quality double")).collect()}
    weight = dict(zip([s for s, _ in rows], (5, 2, 1) * 3))
    size, open_, left = dict(rows), [s for s, _ in rows], float(sum(n for _, n in rows))
    expected = {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * size[s]]
        if not full:
            expected |= share
            break
        for s in full:
            expected[s] = 3.0 * size[s]
            left -= expected[s]
            open_.remove(s)
    assert all(abs(got[s] - expected[s]) < 1e-6 for s in expected)


def test_mixture_ranges_do_not_change_the_budget(spark):
    rows = [(i, "w " * (i % 17 + 1), "s" if i % 3 else "t") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for range_rows in (16, 4096):
        got = source_mixture.mixture(df, range_rows=range_rows).collect()
        for s in "st":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 17


def test_toxicity(spark, docs, empty):
    bad = ("stupid", "idiot", "moron")
    rows = [(i, f"some words about topic{i % 7} and {bad[i % 3] if i % 4 == 0 else 'nothing'} more{i % 5}", int(i % 4 == 0)) for i in range(400)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = known.select("doc_id", "toxic")
    got = toxicity.toxicity(known, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert {r.score for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert len(toxicity.toxicity(docs, labels).collect()) == len(ROWS) and toxicity.toxicity(empty, labels).count() == 0
    kept = toxicity.not_toxic(known, labels)
    assert kept.columns == known.columns and kept.where("toxic = 0").count() >= 0.97 * 300 and kept.where("toxic = 1").count() <= 10


def test_ftrl_against_one_coordinate_at_a_time():
    draw, bits = np.random.default_rng(6), 8
    rows = [(np.unique(draw.integers(0, 256, 12)).astype(np.uint32), int(draw.random() < 0.5)) for _ in range(60)]
    model = toxicity.train(rows, bits, passes=2, alpha=0.5, beta=1.0, l1=0.3, l2=0.05)
    z, n = [0.0] * 257, [0.0] * 257
    size = [1.0] * 128 + [toxicity.PAIR] * 128 + [1.0]

    def weight(i):
        l1 = 0.0 if i == 256 else 0.3
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.5 + 0.05)

    for _ in range(2):
        for x, y in rows:
            at = [*x.tolist(), 256]
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * size[i] for i in at)))
            for i in at:
                g = (p - y) * size[i]
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5
                z[i] += g - s * w[i]
                n[i] += g * g
    expected = [weight(i) * size[i] for i in range(257)]
    assert np.allclose(model.dense(), expected[:256], atol=1e-9) and abs(model.bias - expected[256]) < 1e-9
    assert 0 < len(model.index) < 256


def test_nearest_against_brute_force(spark):
    draw = np.random.default_rng(1)
    x = np.vstack([draw.normal(size=(300, 8)), np.ones((60, 8)), draw.integers(0, 2, (40, 8))]).astype(np.float32)
    odd = [(502, [float("nan")] + [1.0] * 7), (503, [None] + [1.0] * 7), (500, None), (501, [0.0] * 8), (505, []), (None, [1.0] * 8)]
    # Repeated ids are rows like others; three vectors of another length find each other.
    more = [(7, x[7].tolist()), (7, x[8].tolist()), (440, [1.0] * 3), (460, [2.0] * 3), (461, [2.5] * 3)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + more + odd
    df = spark.createDataFrame([(*r, 0, "c", 1) for r in rows], "vec_id long, embedding array<float>, score int, cell string, width int")
    ok = [(i, np.array(v, float)) for i, v in rows[: -len(odd)] if np.any(v)]
    expected = {}
    for q, v in ok:
        if q % 20 == 0:
            expected[q] = sorted((round(float(np.sqrt(((w - v) ** 2).sum())), 9), i) for i, w in ok if i != q and len(w) == len(v))[:10]
    for settings in ({"shard_rows": 90, "block_rows": 8}, {"shard_rows": 30, "block_rows": 3, "sample_rows": 100}, {}):
        got = vptree_ann.nearest(df, df.where("vec_id % 20 = 0"), 10, 1.0, **settings).collect()
        by = {q: [(round(r.score, 9), r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in expected}
        assert by == expected and {r.query_id for r in got} == set(expected)
    assert vptree_ann.nearest(df.where("false"), df.where("false")).count() == 0
    assert vptree_ann.nearest(df, df.where("false")).count() == 0


def test_nearest_recall_of_a_larger_factor(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16)) * 3
    x = np.vstack([centres[i % 20] + draw.normal(size=16) for i in range(2000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vptree_ann.nearest(df, df.where("vec_id % 20 = 0"), 10, 1.3, shard_rows=200).collect()
    hits = 0
    for q in range(0, 2000, 20):
        near = np.argsort(np.where(np.arange(2000) == q, np.inf, ((x - x[q]) ** 2).sum(1)), kind="stable")[:10]
        hits += len(set(near.tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / 1000 >= 0.9


def test_main_text(spark):
    page = '<html><head><title>T</title></head><body><nav>menu</nav><article><h1>T &amp; x</h1><p>One<br>two <i>th</i>ree<p>Four&nbsp;five<div class="ad">buy</div></article><footer>f</footer></body>'
    rows = [(1, "http://a.b/c", page, 1), (2, None, None, 1), (3, "http://a.b/d", "", 1), (4, "x", "<p>open <b>text", 1), (4, "x", "<p>open <b>text", 1)]
    rows += [(10 + i, f"https://H.org/{i}", f"<div><p>Same notice on every page</p></div><div class='c'><p>Own text number {i} {'word ' * (i + 3)}</p></div>", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in site_style_tree.extract(df).collect()}
    assert got[1].text == "T & x One two three Four five" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "open text"
    assert all(got[10 + i].text.startswith(f"Own text number {i}") for i in range(12))
    assert site_style_tree.extract(df).count() == len(rows) and site_style_tree.extract(df.where("false")).count() == 0
    assert site_style_tree.main_text("<div>" * 3000 + "deep", {}) == "deep"


def test_names_that_only_contain_a_listed_word_stay():
    page = "<article><h1>T</h1><section id='legal-history'><p>Law of old</p></section><div class='form-of-government'><p>A republic</p></div><p>so <math><mi>x</mi></math> is</p><div class='cookie-notice-top'>we bake</div><noscript>switch it on</noscript><div class='ad-2'>buy</div></article>"
    assert site_style_tree.main_text(page, {}) == "T Law of old A republic so x is"


def test_main_text_without_any_names(spark):
    """No class, no element that names its part: repeated branches go by their entropy alone."""
    draw = np.random.default_rng(8)
    text = lambda n: " ".join("".join(draw.choice(list("abcdefghij"), 6)) for _ in range(n))
    rows, own = [], []
    for i in range(30):
        own.append([text(20) for _ in range(3)])
        head = "<div><div>Home</div><div>News</div><div>Contact us</div></div>"
        foot = "<div><p>Imprint of the site</p><p>All rights reserved</p></div>"
        rows.append((i, f"http://p.org/{i}", f"<html><body>{head}<div><h1>{own[-1][0]}</h1><p>{own[-1][1]}</p><p>{own[-1][2]}</p></div>{foot}</body></html>"))
    got = {r.page_id: r.text for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == " ".join(own[i]) for i in range(30))


def test_importance_against_entropies(spark):
    """Presentation: entropy of a node's sequences of children. Content: one less the mean entropy of its texts over pages."""
    pages = ["<div><p>a</p></div>"] * 5 + ["<div><p>b</p><h2>same</h2></div>"] * 2 + ["<div><p>c</p><p>d</p><h2>same</h2></div>"]
    rows = [(i, "http://h/", h) for i, h in enumerate(pages)]
    tree = site_style_tree.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    nodes = {x.node: (x.presentation, x.content) for x in tree[0].nodes}
    root = site_style_tree.parse(pages[0])
    div = root.children[0]
    m = len(pages)
    entropy = lambda counts: -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)
    assert abs(nodes[div.node][0] - entropy([5, 3]) / math.log(m)) < 1e-9
    n_p, texts = 8, [5, 2, 1, 1]  # pages with such an element, and with each of its texts
    assert abs(nodes[div.children[0].node][1] - (1 - sum(math.log(x) for x in texts) / 4 / math.log(n_p))) < 1e-9


def test_main_text_judges_articles_by_the_style_tree(spark):
    own = lambda i: " ".join(f"{w}{i * 7 + k}" for k, w in enumerate(("alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "mu", "nu")))
    rows = [(i, f"http://n.org/{i}", f"<article><p>{own(i)}</p><p>Read our house rules first</p><p>more {own(i + 50)}</p><div class='x'><p>Sold by Example</p></div></article>") for i in range(20)]
    # The main text is outside of the article, which is a teaser that all pages share.
    rows += [(100 + i, f"http://o.org/{i}", f"<article><p>Subscribers read more</p></article><div class='t'><p>{own(i)}</p></div>") for i in range(20)]
    # Copies of one article, and four other pages, are not boilerplate.
    rows += [(200 + i, f"http://c.org/{i}", f"<article><h1>Title</h1><p>{own(min(i, 4))}</p></article>") for i in range(20)]
    got = {r.page_id: r.text for r in site_style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{own(i)} more {own(i + 50)}" for i in range(20))
    assert all(got[100 + i] == own(i) for i in range(20))
    assert all(own(min(i, 4)) in got[200 + i] for i in range(20))


def test_masked_model(docs, empty):
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs).collect()}
    assert len(got) == len({r[0] for r in ROWS}) and masked_lm.pseudo_likelihood(docs).count() == len(ROWS)
    assert [got[i].n_tokens for i in (4, 5, 8)] == [0, 0, 0] and got[5].log_likelihood == 0.0 and got[5].mean_log_likelihood is None
    assert got[6].n_tokens == len(LONG.split()) and got[6].mean_log_likelihood > got[11].mean_log_likelihood
    assert got[1].log_likelihood == got[2].log_likelihood < 0
    assert masked_lm.pseudo_likelihood(empty).count() == 0


def test_masked_model_sums_its_conditionals(spark):
    """Scores against windows, classes, counts and spellings taken one by one in plain Python."""
    draw = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("ba", "to", "mé", "日") for b in ("n", "r", "lu", "x9", "")]
    texts = [" ".join(draw.choice(words, draw.integers(0, 30), p=np.arange(1, 21) / 210)) + "\nrare%d  end" % (i // 2) for i in range(40)] + ["", "  ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = masked_lm.learn(df, steps=15, most=12)
    got = {r.doc_id: r.log_likelihood for r in masked_lm.score(df, model).collect()}
    split = [(t or "").split() for t in texts]
    n = Counter(w for s in split for w in s)
    known = {w for w, c in n.items() if sum(x >= c for x in n.values()) <= 12}
    assert set(model.vocabulary.words) == known
    class_of = {w: int(c) for w, c in zip(model.vocabulary.words, model.vocabulary.classes)}
    mass = Counter(class_of.get(w, 1) for s in split for w in s)
    pairs = Counter((a, b) for s in split for w in s if w not in known for x in [[0, *[min(ord(c), 384) if ord(c) < 384 else 1 for c in w], 0]] for a, b in zip(x, x[1:]))
    row = Counter()
    for (a, _), c in pairs.items():
        row[a] += c
    k, kinds = masked_lm.SYMBOLS, masked_lm.KINDS
    for i, s in enumerate(split):
        z = [0, 0, *[class_of.get(w, 1) for w in s], 0, 0]
        total = 0.0
        for j, w in enumerate(s):
            l2, l1, c, r1, r2 = z[j : j + 5]
            kind = masked_lm._KIND
            total += model.cells[(((kind[l2] * kinds + kind[r2]) * k + l1) * k + r1) * k + c]
            if w in known:
                total += math.log(max(n[w] - 1, 0.5) / max(mass[c] - 1, 1))
            else:
                x = [0, *[ord(c) if ord(c) < 384 else 1 for c in w], 0]
                p = math.exp(sum(math.log((pairs[a, b] + 1 / 384) / (row[a] + 1)) - (math.log(0x110000 - 384) if b == 1 else 0) for a, b in zip(x, x[1:])))
                total += math.log((n[w] - 1 + p) / mass[1])
        assert abs(got[i] - total) < 1e-3, i
    # What stands twice in the corpus is likelier than what stands once.
    assert len({w for w in n if w not in known}) > 10 and abs(np.exp(model.cells.reshape(-1, k)).sum(axis=1) - 1).max() < 1e-4


def test_masked_model_tells_repeated_texts_apart(spark):
    draw = np.random.default_rng(5)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnoprstu"), 9))
    common = [word() for _ in range(50)]
    texts = [" ".join(word() if draw.random() < 0.2 else common[draw.integers(0, 50)] for _ in range(60)) for _ in range(100)]
    texts += texts[:20]
    got = masked_lm.score(df := spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), masked_lm.learn(df, most=50)).collect()
    twice = [r.mean_log_likelihood for r in got if r.doc_id < 20 or r.doc_id >= 100]
    assert min(twice) > max(r.mean_log_likelihood for r in got if 20 <= r.doc_id < 100)
    n = Counter(w for t in texts for w in t.split())
    assert all(abs(r.unseen - sum(n[w] == 1 for w in texts[r.doc_id].split()) / 60) < 1e-12 for r in got)


def test_masked_counts_grow_with_the_corpus(spark):
    sizes = []
    for n in (20, 200):
        texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(n)]
        got = masked_lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).toPandas()
        assert got.n.sum() == 30 * n
        sizes.append(len(got))
    assert sizes == [600, 6000]


def test_masked_gradient_against_differences():
    net, k = masked_lm.Network(4), masked_lm.SYMBOLS
    contexts, counts = np.array([70, 4200]), np.random.default_rng(0).random((2, k)).astype(np.float32)
    _, grads = net.gradient(contexts, counts)
    for name, at in (("out", (1, 2)), ("left", (4200 // k % k, 0)), ("base", (5,)), ("bias", (2,))):
        old, step, loss = net.p[name][at], 1e-2, []
        for sign in (1, -1):
            net.p[name][at] = old + sign * step
            loss.append(net.gradient(contexts, counts)[0])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / (2 * step) - grads[name][at]) < 2e-3


def test_license_scan(spark, docs, empty):
    notice, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    rows = [(1, "/a/LICENSE", mit), (2, "/a/b/c/x.txt", "plain"), (3, "/a/b/LICENSE.txt", notice), (4, "/a/d/y.txt", "text\n" + notice), (5, "/z/q.txt", "text"), (6, None, None), (7, "/a/d/LICENSE", "not a known text"), (2, "/a/b/c/x.txt", "plain"), (8, "top.txt", "x " * 50_000)]
    got = {r.file_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert (got[2].license, got[2].origin, got[2].from_dir) == ("Apache-2.0", "directory", "/a/b")
    assert (got[4].license, got[4].origin) == ("Apache-2.0", "file") and (got[7].license, got[7].from_dir) == ("MIT", "/a")
    assert got[5].license is None and got[6].origin == got[8].origin == "none" and got[1].own_score > 0.9
    files = license_scan.document_paths(docs)
    assert license_scan.license_scan(files).where("file_id = 10").head().own_license == "Apache-2.0"
    assert license_scan.license_scan(license_scan.document_paths(empty)).count() == 0
