"""Token counts, fill-in-middle and alignment against the libraries and plain strings."""

import collections
import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import fill_middle, pieces, token_alignment, token_counts
from lexloom.llm.tokenise import vocabulary_path

MODEL, BYTES = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  two  blanks   three ", "\n", "\n\n x\n", "line one\nline two\nno end", "tab\tand\r\nreturn", "é ü ß ﬁ ｱ 日本語 テスト", "▁ mark ▁x", "a\x01b c \x01", "<s> </s> <unk> <0x0A> <|endoftext|>",
    "a <P> b", "x<S", "<M>", "don't, won't; (can't) ...", "a" * 5000, "word " * 3000, "日" * 3000, "🙂 👩‍👩‍👧 é", "  　 \xa0x", "same text", "same text", "x\x00y",
]
TEXTS = st.lists(st.text(st.one_of(st.sampled_from(list(" \n\t.,ab▁é\x01日")), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=6)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(MODEL)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i}") for i, t in enumerate(ODD)] + [(None, "no id\nat all", "s"), (3, "again\nan id", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, `n_tokens` string").withColumn("a.b", F.lit(1)).withColumn("links", F.lit("x")).repartition(3)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_ids_of_parts_are_the_librarys(encoder, texts):
    ids, counts = encoder.ids(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == encoder.model.encode(texts)


def test_ids_of_odd_texts(encoder):
    texts = [x or "" for x in ODD]
    assert encoder.cuts
    ids, counts = encoder.ids(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == encoder.model.encode(texts)


def test_a_cache_keeps_bounded_generations():
    cache, made = pieces.Cache(2), []
    make = lambda parts: [made.append(p) or p.upper() for p in parts]
    for parts in (["a", "b"], ["c", "a"], ["d"], ["a", "x" * 100]):
        assert cache.of(parts, make) == [p.upper() for p in parts]
    assert len(cache.now) <= 2 and len(cache.before) <= 2 and made.count("a") == 1
    assert cache.of(["x" * 100], make) == ["X" * 100] and made.count("x" * 100) == 2


@pytest.mark.parametrize("name", [MODEL, BYTES])
def test_counts_of_every_row(spark, odd, name):
    got = token_counts.token_counts(odd, name, limit=2999)
    if name == MODEL:
        count = lambda t: len(pieces.loaded(MODEL).encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(BYTES)
        library.encode_special_tokens = True
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = sorted(((i, len((t or "").encode()), n := count(t or ""), n > 2999) for i, t in odd.select("doc_id", "text").collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(x[3] for x in want)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_counts_do_not_depend_on_the_broadcast_table(spark, odd):
    texts = pa.array([t or "" for t in ODD], pa.string())
    for words in ([], ["a", "two", "word"], ["", " blanks"]):
        sizes = [len(x) for x in pieces.PieceEncoder(MODEL).part_ids(words)] if words else []
        counter = token_counts.PieceCounter(MODEL, token_counts.Lengths(pa.array(words, pa.string()), np.array(sizes, np.uint16)))
        assert counter.counts(texts).tolist() == list(map(len, counter.model.encode(texts.to_pylist())))
    table = token_counts.frequent_lengths(odd, MODEL, entries=3)
    assert table.words.to_pylist()[0] == "word" and len(table.words) == 3


def test_no_shuffle_behind_the_table(spark, odd, capsys):
    plan = token_counts.token_counts(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert token_counts.token_counts(none).count() == fill_middle.rearranged_digest(none).count() == token_alignment.alignment(none).count() == 0


@given(st.text(st.sampled_from("ab\n<PSM>"), max_size=60), st.integers(1, 9), st.lists(st.integers(0, 60), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_ropes_are_split_and_joined_as_strings(text, size, ranks):
    whole = fill_middle.rope(text, size)
    lines = text.splitlines(keepends=True)
    assert fill_middle.units(text) == len(lines)
    for rank in ranks:
        a, b = fill_middle.split_units(whole, rank, len(lines))
        assert (fill_middle.written(a), fill_middle.written(b)) == ("".join(lines[:rank]), "".join(lines[rank:]))
        c, d = fill_middle.split(whole, min(rank, len(text)), "chars")
        assert (fill_middle.written(c), fill_middle.written(d)) == (text[:rank], text[rank:])
        whole = fill_middle.join(b, a)
        text = fill_middle.written(whole)
        lines = text.splitlines(keepends=True)
        assert (whole.ends, whole.chars) == (text.count("\n"), len(text))


def _deepest(at):
    return 0 if isinstance(at, fill_middle.Leaf) else 1 + max(_deepest(at.left), _deepest(at.right))


def test_trees_stay_balanced():
    whole = fill_middle.rope("line\n" * 20_000, 16)
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = fill_middle.split(whole, int(rng.integers(0, 20_000)), "ends")
        whole = fill_middle.join(b, a)
    assert whole.ends == 20_000 and whole.chars == 100_000 and _deepest(whole) == whole.height < 22


def _plain_fill(doc_id, text, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = [x + "\n" for x in text.split("\n")[:-1]] + [x for x in [text.split("\n")[-1]] if x]
    n = len(lines)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:i]), "".join(lines[i:j]), "".join(lines[j:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (50, 10), (0, 50)])
def test_fill_in_middle_of_every_row(spark, odd, rate, spm):
    got = fill_middle.with_restored(fill_middle.fill_in_middle(odd, rate=rate, spm_rate=spm)).collect()
    want = sorted((_plain_fill(i, t, rate, spm) for i, t in odd.select("doc_id", "text").collect()), key=repr)
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == want
    assert collections.Counter(r["restored"] for r in got) == collections.Counter(t or "" for t, in odd.select("text").collect())


def test_restoring_finds_sentinels_that_texts_nearly_have():
    for text in ("<", "<S\n<M\n<P", "a<\n>S>\nM><", "<<S\n<<M\n"):
        n = fill_middle.units(text)
        for form in fill_middle.FORMS:
            for i in range(n + 1):
                for j in range(i, n + 1):
                    assert fill_middle.restored(fill_middle.rearranged(text, i, j, form)[0], form) == text
    with pytest.raises(ValueError):
        fill_middle.restored("no sentinels", "psm")


def _groups(text):
    """Groups of (A ids, B ids) of a text, from the libraries' ids and byte offsets kept in sets."""
    from tokenizers import Tokenizer

    library, model = Tokenizer.from_file(BYTES), pieces.loaded(MODEL)
    library.encode_special_tokens = True
    if not text:
        return []
    a, b = library.encode(" " + text, add_special_tokens=False), model.encode(text)
    vocabulary = json.load(open(BYTES))["model"]["vocab"]
    word = {i: w for w, i in vocabulary.items()}
    from lexloom.llm.tokenise import byte_characters

    back = {c: x for x, c in byte_characters().items()}
    bytes_a = [bytes(back[c] for c in word[i]) for i in a.ids]
    bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    out, left_a, left_b, x, y = [], [], [], 0, 0
    ends_a, ends_b = dict.fromkeys(np.cumsum([len(t) for t in bytes_a]).tolist()), dict.fromkeys(np.cumsum([len(t) for t in bytes_b]).tolist())
    both = sorted(set(ends_a) & set(ends_b))
    at_a, at_b = list(zip(ends_a, a.ids, strict=True)), list(zip(ends_b, b, strict=True))
    for end in both:
        left_a, left_b = [], []
        while x < len(at_a) and at_a[x][0] <= end:
            left_a.append(at_a[x][1])
            x += 1
        while y < len(at_b) and at_b[y][0] <= end:
            left_b.append(at_b[y][1])
            y += 1
        out.append((left_a, left_b))
    return out


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 5, 0])
def test_alignment_of_every_row(spark, odd, frequent):
    rows = [(i, _groups(t)) for i, t in odd.select("doc_id", "text").collect()]
    counts = collections.Counter((a[-1], b[-1]) for _, gs in rows for a, b in gs)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for i, gs in rows:
        links = [(a[-1], b[-1]) for a, b in gs]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        want.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    got = token_alignment.alignment(odd, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    marked = [x for x in want if x[1] == 0]
    assert len(marked) >= 3  # null, empty, and the text with the mark of a blank


def test_labels_are_scanned_to_each_common_end():
    labels = token_alignment.label_string(9, np.array([2, 3, 5, 9]), np.array([3, 4, 9]))
    assert labels == b"NACBANNNC"
    assert [x.tolist() for x in token_alignment.scanned(labels)] == [[2, 2], [1, 2]]
