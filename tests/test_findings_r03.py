"""Work that grows no faster than the input: each finding's step, by what its plan or its tables hold."""

import numpy as np
from pyspark.sql import functions as F

from lexloom.functions import porter2, wikitext
from lexloom.llm import masked_lm
from lexloom.operators import classify, communities, frequencies, graph, word_vectors
from lexloom.plans import pipeline, queries


def test_groups_of_a_pattern_are_extracted_once(spark):
    """the groups of all matches were extracted anew for each match."""
    df = spark.createDataFrame([("[a|b] [c|] [|]",), ("none",), (None,)], "m string").select(wikitext.simple_links(F.col("m")).alias("x"), wikitext.external_links(F.lit("[http://a b] [ftp://c]")).alias("e"))
    assert [None if r.x is None else [tuple(p) for p in r.x] for r in df.collect()] == [[("a", "b"), ("c", ""), ("", "")], [], None]
    assert [(p.protocol, p.address) for p in df.head().e] == [("http", "a"), ("ftp", "c")]
    plan = df.select("x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "lambdafunction" not in plan


def test_rounds_of_weights_leave_out_ends(spark, monkeypatch):
    """every round joined and stored the nodes without children, too."""
    sizes, plain = [], graph.stored

    def counted(df, name):
        out = plain(df, name)
        if name in ("passed", "weights"):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    edges = [("root", "a"), ("a", "b"), ("b", "a"), ("root", "z"), *[("b", f"leaf{i}") for i in range(200)]]
    got = {r.node: r.weight for r in graph.depth_weights(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("root",)], "node string"), tolerance=1e-12).collect()}
    assert max(sizes) <= 3 and len(got) == 204
    a = 0.15 * 0.85 / 2 / (1 - 0.85 * 0.85 / 201)
    assert abs(got["a"] - a) < 1e-9 and abs(got["leaf7"] - a * 0.85 * 0.85 / 201) < 1e-12 and abs(got["z"] - 0.06375) < 1e-12


def test_components_are_sought_among_what_may_be_in_cycles(spark, monkeypatch):
    """the components of all nodes were made, and all links joined with them twice."""
    sizes, plain = [], graph.inner_links
    monkeypatch.setattr(graph, "inner_links", lambda edges, parts: sizes.append((edges.count(), parts.count())) or plain(edges, parts))
    edges = [("a", "b"), ("b", "a"), ("s", "s"), ("t", "t"), ("t", "a"), ("x", None), *[("a", f"leaf{i}") for i in range(200)]]
    got = graph.in_cycles(spark.createDataFrame(edges, "parent string, child string"))
    assert sorted(r.node for r in got.collect()) == ["a", "b", "s", "t"] and sizes == [(5, 4)]


def test_rounds_of_moves_leave_out_leaves(spark, monkeypatch):
    """every round of moves shuffled the leaves' links, too."""
    sizes, plain = [], communities._local
    monkeypatch.setattr(communities, "_local", lambda links, *a: sizes.append(links.count()) or plain(links, *a))
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(4) for j in range(i)]
    leaves = [(f"{c}{i}", f"{c}{i}leaf{k}") for c in "ab" for i in range(4) for k in range(10)]
    edges = spark.createDataFrame([*cliques, *leaves, ("a0", "b0"), ("u", "v"), ("s", "s")], "parent string, child string")
    links = communities.undirected(edges)
    last = communities.louvain(links)[-1]
    of = {r.node: r.community for r in last.members.collect()}
    assert sizes[0] == 12 + 1 + 8 + 2 and len(of) == 8 + 80 + 3
    assert all(of[f"{c}{i}leaf{k}"] == of[f"{c}{i}"] for c in "ab" for i in range(4) for k in range(10)) and of["u"] == of["v"] != of["s"]
    assert abs(communities.modularity(links, last.members) - last.modularity) < 1e-9


def test_words_are_made_once_for_vocabulary_and_weights(spark):
    """each level read the words as strings again, and weights made them anew from the texts."""
    made = spark.sparkContext.accumulator(0)

    def split(text):
        made.add(1)
        return text and text.split()

    rows = [(i, "a b a b" if i % 2 else "b c") for i in range(20)] + [(20, None), (21, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.udf(split, "array<string>")("text").alias("words"))
    words = frequencies.packed(docs, "words", "doc_id")
    vocab = frequencies.pruned_vocabulary(words, "words", 22, 2, 2, 0.9)
    assert {(r.gram, r.df) for r in vocab.collect()} == {("a", 10), ("c", 10), ("a b", 10), ("b a", 10), ("b c", 10)}
    got = frequencies.term_weights(words, "words", vocab, "doc_id").collect()
    assert made.value == 22 and len(got) == 10 * 3 + 10 * 2 and {r.doc_id for r in got} == set(range(20))
    plain = frequencies.term_weights(docs, "words", vocab, "doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain))


def test_pairs_are_summed_in_one_order_and_joined_without_a_shuffle(spark, monkeypatch):
    """both orders of a pair were shuffled, and the counts were joined by three shuffles."""
    sizes, plain = {}, word_vectors.stored

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(word_vectors, "stored", counted)
    docs = spark.createDataFrame([(["a", "b", "c", "a", "a"],), (None,)], "words array<string>")
    counts = word_vectors.cooccurrences(docs, "words", spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "gram string, term_id int"), 1)
    assert {(r.i, r.j): r.n for r in counts.collect()} == {(0, 1): 1, (1, 0): 1, (1, 2): 1, (2, 1): 1, (0, 2): 1, (2, 0): 1, (0, 0): 2}
    pairs = word_vectors.ppmi(counts)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert sizes["pair-counts"] == 4 and pairs.columns == ["i", "j", "n", "value"] and "SortMergeJoin" not in plan


def test_weights_with_labels_are_not_joined_with_them(spark):
    """weights, and then likelihoods, were joined by shuffles of all weights."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, label int")
    weights = spark.createDataFrame([(i, t, (i + t) / 10) for i in range(10) for t in range(3)], "doc_id long, term_id int, weight double")
    vocab = spark.createDataFrame([(t,) for t in range(4)], "term_id int")
    priors, want = classify.naive_bayes(weights, labels, vocab, "doc_id")
    _, got = classify.naive_bayes(weights.join(labels, "doc_id"), labels, vocab, "doc_id")
    rows = lambda df: sorted((r.label, r.term_id, round(r.log_likelihood, 12)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 8
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = classify.naive_bayes_scores(weights, labels, priors, got, "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin [term_id" in plan


def test_outer_words_are_told_apart(spark):
    """outer words were one of four kinds, so what only they decide could not be learnt."""
    none, every = np.zeros(32, np.int64), np.arange(masked_lm.SYMBOLS)
    assert len(set(masked_lm.cells_of([every, none, none, none], none))) == len(set(masked_lm.cells_of([none, none, none, every], none))) == masked_lm.SYMBOLS
    draw = np.random.default_rng(2)
    texts = [f"f{k} sep w{k} sep" for k in draw.integers(0, 8, 2000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = masked_lm.learn(df)
    number, classes = model.vocabulary.numbers(), model.vocabulary.classes
    of = lambda w: np.array([classes[number[w]]])
    got = [model.network.of_windows(masked_lm.cells_of([of(f"f{k}"), of("sep"), of("sep"), np.array([0])], of(f"w{k}")))[0] for k in range(8)]
    assert np.mean(got) > np.log(0.4)


def test_texts_are_stemmed_once_for_vocabulary_model_and_predictions(spark, monkeypatch):
    """the target's texts were stemmed for the vocabulary, all for the model, and all again for the predictions."""
    made = spark.sparkContext.accumulator(0)

    def read(text):
        made.add(1)
        return text

    words = {"fr": ("hoping rings 'll", "fields grouped"), "en": ("cells bloods", "hearts rings")}
    rows = [(i, t, words[t][i // 4 % 2]) for i in range(80) for t in ("fr" if i % 4 == 0 else "en",)] + [(80, None, "unknown"), (81, "en", None), (81, "fr", "")]
    docs = spark.createDataFrame(rows, "doc_id long, target string, text string")
    monkeypatch.setattr(queries, "_training", lambda *_: docs.withColumn("text", F.udf(read, "string")("text")))
    models, plain = [], pipeline.fit_with_features
    monkeypatch.setattr(pipeline, "fit_with_features", lambda *a, **k: models.append(plain(*a, **k)) or models[0])
    got = sorted(map(tuple, queries.deploy_predictions(spark, "").collect()))
    assert made.value == len(rows)
    model, _ = models[0]
    assert {"hope", "ring", "hope ring", "hope ring ll"} <= {r.gram for r in model.vocab.collect()}
    want = sorted(map(tuple, model.predictions(docs, 0.2, title="doc_id").collect()))
    assert [k for k, _ in got] == [k for k, _ in want] == sorted([*range(0, 80, 4), *[i for i in range(80) if i % 4 and i // 4 % 2 == 0], 80, 81, 81]) and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-6)
    assert [x for k, x in got if k >= 80 or k % 4] == [0.0] * 33


def test_most_words_need_no_step_of_the_stemmer(monkeypatch):
    """every step was tried on every word, though the endings tell which of them can change."""
    draw = np.random.default_rng(5)
    ends = ["", "e", "ll", "y", "ay", "s", "'s", "'", "’s'", "ied", "eed", "ing", "edly", "ational", "ogi", "li", "ative", "ement", "ion", "an", "o,", "Y", "é", "1"]
    words = ["".join(draw.choice(["gener", "y", "'", "hop", "a", "tt", "s", "Ü", *ends], draw.integers(1, 5))) + e for e in ends for _ in range(50)]
    quick = [porter2.stem(w) for w in words]
    monkeypatch.setattr(porter2, "_ENDS", type("All", (), {"get": lambda *_: ("",)})())
    assert quick == [porter2.stem(w) for w in words]
    monkeypatch.undo()
    monkeypatch.setattr(porter2, "_after", lambda *_: 1 / 0)
    assert [porter2.stem(w) for w in ("Ringo,", "'Blan", "chrek")] == ["ringo,", "blan", "chrek"]
