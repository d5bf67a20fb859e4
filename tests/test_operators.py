"""Operators on small hand-made tables, with values worked out by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.operators import association as A
from plinth.operators import classify as C
from plinth.operators import enrich, factor, graph, merge, profile
from plinth.operators import templates as P
from plinth.operators import vectors as V
from plinth.sources import readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()[0]


@pytest.fixture(scope="module")
def baskets(spark):
    held = {1: "abc", 2: "abc", 3: "abd", 4: "ab", 5: "c"}
    return spark.createDataFrame([(b, "abcd".index(i)) for b, items in held.items() for i in items], "basket int, item int")


def test_measures_by_hand(spark, baskets):
    index = A.item_index(baskets)
    assert rows(index) == [(0, 4), (1, 4), (2, 3)]
    got = {(r.i, r.j): r for r in A.scored(A.pair_stats(A.entries(baskets, index))).collect()}
    assert set(got) == {(0, 1)}
    r = got[0, 1]
    assert r.raw == 4 and r.lift == pytest.approx(4 * 5 / 16) and r.tscore == pytest.approx((4 - 16 / 5) / 2)
    assert r.pmi == pytest.approx(math.log(5 * 5 / 25) * 4 / 5 * 4 / 5)


def test_weights_scale_joint_counts_and_missing_weights_are_one(spark, baskets):
    w = spark.createDataFrame([(1, 3.0)], "basket int, w double")
    rows_ = A.entries(baskets, A.item_index(baskets), w)
    assert rows(A.pair_counts(rows_)) == [(0, 1, 4, 6.0)]
    assert A.totals(rows_).first()["total"] == 7.0


def test_empty_baskets_give_nothing(spark, baskets):
    none = baskets.filter("false")
    assert A.scored(A.pair_stats(A.entries(none, A.item_index(none)))).collect() == []


def test_rows_are_dense_and_ordered(spark):
    index = spark.range(1000).select((F.col("id") * 7).alias("item"))
    got = A.with_rows(index).orderBy("item").collect()
    assert [r.row for r in got] == list(range(1000))


def test_median_of_even_sizes_is_the_mean_of_the_middle_two(spark):
    h = spark.createDataFrame([(k, s) for s, n in {"a": 2, "b": 4}.items() for k in range(n)], "basket int, stratum string")
    assert {r.stratum: r.weight for r in A.near_uniform(h).collect()} == {"a": 1.5, "b": 0.75}


def test_dense_guard():
    A.check_dense(10, 10)
    with pytest.raises(MemoryError):
        A.check_dense(100_000, 100_000)


def test_template_curves(spark):
    at = lambda d, t: one(spark, lambda v: P.trust(v, F.lit(t)), d, "int")
    assert [at(d, 100) for d in (0, 10, 45, 80, 90)] == [1.0, 1.0, 0.5, 0.0, 0.0]
    assert at(10, 25) == 1.0
    assert one(spark, P.cut_confidence, 20, "int") == 0.5
    assert [one(spark, P.item_weight, x, "double") for x in (0.05, 0.525, 1.0)] == [1.0, pytest.approx(0.5), 0.0]


def test_overlap_counts_quantities_and_ties_go_to_the_smaller_template(spark):
    b = spark.createDataFrame([(1, 5, 3), (1, 6, 1)], "basket int, item int, qty long")
    t = spark.createDataFrame([(8, 5, 2), (8, 7, 9), (9, 5, 2)], "template int, item int, qty long")
    m = spark.createDataFrame([(1, 8), (1, 9)], "basket int, template int")
    got = P.compared(m, b, t)
    assert {(r.template, r.overlap, r.shared, r.n_template) for r in got.collect()} == {(8, 2, 1, 2), (9, 2, 1, 1)}
    assert P.best_match(got).first()["template"] == 8


def test_similarity_is_null_without_a_template(spark):
    h = spark.createDataFrame([(1,)], "basket int")
    none = spark.createDataFrame([], "basket int, template int, shared long, n_items long, n_template long")
    assert P.similarity(h, none).first()["similarity"] is None


def test_nearest_rank(spark):
    v = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2, 2)], "v double")
    assert dict(P.nearest_rank(v, "v", (0.0, 0.5, 0.99)).collect()) == {0.0: 1.0, 0.5: 2.0, 0.99: 4.0}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "i int, j int")


def test_jaccard_gate_and_core(spark):
    clique = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    e = edges(spark, [*clique, (4, 9)])
    kept = {(r.i, r.j) for r in graph.jaccard_gate(e, 0.03).collect()}
    assert kept == set(clique)
    members = spark.createDataFrame([(x, 0) for x in (0, 1, 2, 3, 4, 9)] + [(0, 1), (1, 1)], "item int, topic int")
    assert {(r.item, r.topic) for r in graph.kcore(e, members, 4).collect()} == {(x, 0) for x in range(5)}


def test_rand_index_of_equal_and_single_groupings(spark):
    g = spark.createDataFrame([(0, 5), (0, 5), (1, 6), (1, 6)], "a int, b int")
    assert graph.rand_index(g, "a", "b").first()["ari"] == 1.0
    assert graph.rand_index(g.withColumn("c", F.lit(0)), "a", "c").first()["ari"] == 0.0


def test_communities_find_two_cliques(spark):
    pairs = [(a + s, b + s, 1.0) for s in (0, 10) for a in range(4) for b in range(a + 1, 4)] + [(3, 10, 0.1)]
    got = graph.communities(spark.createDataFrame(pairs, "i int, j int, weight double")).collect()
    assert {r.item // 10: set() for r in got} == {0: set(), 1: set()}
    assert len({r.community for r in got if r.item < 10}) == 1 and len({r.community for r in got}) == 2


def test_pairs_of_large_baskets(spark):
    import random

    from plinth.operators import association

    rng = random.Random(2)
    held = [(b, i) for b, n in ((1, 90), (2, 40), (3, 5), (4, 1)) for i in rng.sample(range(100), n)]
    table = spark.createDataFrame([(b, i, 0.5 + b, 1.0 + i) for b, i in held], "basket int, item int, w double, u double")
    want = {}
    for b, i in held:
        for c, j in held:
            if b == c and i < j:
                n, s = want.get((i, j), (0, 0.0))
                want[i, j] = (n + 1, s + (0.5 + b) * (1.0 + i) * (1.0 + j))
    for part in (7, 2048):
        got = {(r.i, r.j): (r.raw, r.joint) for r in association.pair_counts(table, 1, part=part).collect()}
        assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_enrichment_by_hand(spark):
    m = spark.createDataFrame([(f"c{k}", 0) for k in range(1, 7)] + [(f"c{k}", 1) for k in range(5, 11)], "item string, topic int")
    labels = {"A": range(1, 5), "B": range(1, 9), "C": range(9, 11)}
    t = spark.createDataFrame([(f"c{k}", tag) for tag, ks in labels.items() for k in ks], "item string, tag string")
    got = {(r.topic, r.tag): r for r in enrich.enrichment(m, t, 1).collect()}
    assert set(got) == {(0, "A"), (0, "B"), (1, "B"), (1, "C")}
    a = got[0, "A"]
    tail = lambda k, big, n, hit: sum(math.comb(hit, x) * math.comb(big - hit, n - x) for x in range(k, min(n, hit) + 1)) / math.comb(big, n)
    assert (a.both_n, a.recall) == (4, 1.0) and a.lift == pytest.approx(4 / (6 * 4 / 10)) and a.p == pytest.approx(tail(4, 10, 6, 4))
    assert got[0, "B"].p == pytest.approx(tail(6, 10, 6, 8)) and got[1, "C"].resolution == pytest.approx(2 / 6)


    assert set((r.topic, r.tag) for r in enrich.enrichment(m, t, 3).collect()) == {(0, "A"), (0, "B"), (1, "B")}
    tested = enrich.enrichment(m, t, 1)
    assert enrich.enriched(tested, 0, 1).count() == 4
    # p: 1/14 for A, 2/15 for (0, B), 1 for (1, B), 1/3 for C
    assert {(r.topic, r.tag): round(r.q, 6) for r in enrich.enriched(tested, 1.2, 0.3).collect()} == {(0, "A"): 0.266667, (0, "B"): 0.266667}
    one = enrich.granularity(enrich.enriched(tested, 1.2, 0.3), m, t).first()
    assert (one.n_labels, one.covered, one.resolved_5, one.median_labels) == (3, 2, 2, 1.0)


def test_purity_null(spark):
    m = spark.createDataFrame([(k, k % 3, 1.0) for k in range(200)], "item int, topic int, weight double")
    c = spark.createDataFrame([(k, 1 if k < 60 else 2) for k in range(180)], "item int, mask int")
    got = [r.purity for r in enrich.purity_null(m, c, top=10, draws=400).orderBy("draw").collect()]
    assert len(got) == 400 and all(0.3 < p <= 1 and round(10 * p, 9) == int(round(10 * p)) for p in got)
    assert 0.58 < sum(got) / 400 < 0.68  # 0.63 by the hypergeometric distribution of 60, 120 and 20
    assert [r.purity for r in enrich.purity_null(m, c, top=500, draws=2).collect()] == [0.6, 0.6]
    assert enrich.purity_null(m.limit(0), c).count() == 0


def test_log_factorials(spark):
    got = {r.n: r.lf for r in enrich.log_factorials(spark, 30, block=7).collect()}
    assert all(got[n] == pytest.approx(math.lgamma(n + 1)) for n in range(31))


def test_step_up(spark):
    t = spark.createDataFrame([(k, p) for k, p in enumerate((0.01, 0.04, 0.03, 0.5))], "k int, p double")
    assert [round(r.q, 6) for r in enrich.step_up(t, "p", ["k"]).orderBy("k").collect()] == [0.04, 0.053333, 0.053333, 0.5]


def test_closure_of_chain_diamond_cycle_and_dangling_parent(spark):
    n = spark.createDataFrame([(x,) for x in "abcdxy"], "node string")
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("d", "gone")], "node string, parent string")
    up = {}
    for r in C.closure(n, e).collect():
        up.setdefault(r.node, []).append(r.ancestor)
    assert {k: "".join(sorted(v)) for k, v in up.items()} == {"a": "abcd", "b": "bd", "c": "cd", "d": "d", "x": "xy", "y": "xy"}


def test_classifier_layers(spark):
    items = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, True), (4, False, False)], "item int, is_override boolean, big_body boolean")
    tags = spark.createDataFrame([(1, "t"), (1, "minus"), (2, "t")], "item int, tag string")
    rules = spark.createDataFrame([("t", "draw", 2.0), ("minus", "draw", -1.5)], "tag string, role string, weight double")
    texts = spark.createDataFrame([(1, "x draw y"), (2, ""), (3, None), (4, "nothing")], "item int, text string")
    out = C.classify(items, C.tag_scores(tags, rules), C.text_scores(texts, [("draw", "draw", 3.0)]), ["land", "draw", "body", "other"], body="body")
    got = {r.item: (r.primary, r.primary_score, r.primary_source, r.secondary) for r in out.collect()}
    # the larger credit with the penalty on top; the tag layer's own total is still positive
    assert got == {1: ("draw", 1.5, "both", None), 2: ("land", 100.0, "type", "draw"), 3: ("body", 2.5, "type", None), 4: ("other", 0.0, "default", None)}


def test_big_body(spark):
    df = spark.createDataFrame([("5", "1"), ("*", "1+*"), (None, "7"), ("4", None)], "p string, t string")
    assert [r[0] for r in df.select(C.big_body(F.col("p"), F.col("t"))).collect()] == [True, False, True, False]


def test_names(spark):
    assert one(spark, X.normalized, "Æther  Vial, the Étude!") == "aether vial the etude"
    assert one(spark, X.normalized_any, "Jötun ǅ Ḍ") == "jotun dz d"
    assert one(spark, X.slug, "Urza's Saga, Part") == "urzas-saga-part"
    assert one(spark, X.file_label, "Kyler, Sigardian") == "kyler"
    assert [one(spark, X.set_code, x) for x in ("Deck (ABC)", "Deck")] == ["ABC", None]
    assert [one(spark, X.singular, x) for x in ("elves", "ponies", "boxes", "cats", "glass", "ties")] == ["elf", "pony", "box", "cat", "glass", "tie"]
    df = spark.createDataFrame([("Jace Beleren enters (reminder). Jace wins.", "Jace Beleren // Jace")], "t string, n string")
    assert df.select(X.rules_text(F.col("t"), F.col("n"))).first()[0] == "~ enters . ~ wins."
    assert one(spark, lambda v: X.between(v, "<<", ">>"), "a<<b>>c") == "b"
    assert one(spark, lambda v: X.resplit(F.split(v, ", "), ["Orcrist, Goblin-cleaver"]), "Ring, Orcrist, Goblin-cleaver") == ["Ring", "Orcrist, Goblin-cleaver"]


def test_ranks_and_quantiles(spark):
    import random

    from plinth.functions import ranks

    rng = random.Random(1)
    values = [(rng.choice([1, 1, 1, 2, 3]), f"w{k}") for k in range(500)]
    got = ranks.ranked(spark.createDataFrame(values, "n int, w string"), F.desc("n"), F.col("w"), pieces=7)
    assert [(r.n, r.w) for r in got.orderBy("rank").collect()] == sorted(values, key=lambda x: (-x[0], x[1])) and got.agg(F.max("rank")).first()[0] == 500
    numbers = [rng.random() for _ in range(301)] + [None]
    q = ranks.quantiles(spark.createDataFrame([(x,) for x in numbers], "v double"), "v", [0.0, 0.2, 0.33, 1.0]).first().q
    assert np.allclose(q, np.quantile([x for x in numbers if x is not None], [0.0, 0.2, 0.33, 1.0]))
    assert ranks.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().q == [None]


def test_tokens_and_repeats(spark):
    assert one(spark, X.tokens, "Don't stop, it’s 5 o") == ["don't", "stop", "it’s", "o"]
    assert one(spark, X.tokens, None) == []
    assert one(spark, X.repeated_words, "the The cat, cat sat") == ["the The", "cat, cat"]


def test_porter_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: X._porter(w) for w in known} == known


def test_vectors(spark):
    bump = one(spark, V.cost_bump, None, "double")
    assert bump[0] == 1.0 and bump[1] == pytest.approx(math.exp(-0.5)) and len(bump) == 9
    assert one(spark, V.pip_counts, "{2}{G}{G/U}{B/P}") == [0, 1, 1, 0, 2]
    stats = [tuple(one(spark, V.parse_stat, x)) for x in ("3", "*", "1+*", "1 // 4", None, "* // 3")]
    assert stats == [(3.0, False), (0.0, True), (1.0, True), (1.0, False), (0.0, False), (0.0, True)]
    assert one(spark, V.unit, [0.0, 0.0], "array<double>") == [0.0, 0.0]
    z = V.zscores(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"])
    assert rows(z) == [(pytest.approx(-math.sqrt(0.5)), 0.0), (pytest.approx(math.sqrt(0.5)), 0.0)]


def test_truncated_svd_keeps_inner_products_of_a_low_rank_matrix(spark):
    rng = np.random.default_rng(1)
    x = rng.random((12, 3)) @ rng.random((3, 6))
    w = spark.createDataFrame([(d, f"w{k}", float(x[d, k])) for d in range(12) for k in range(6)], "doc_id int, word string, weight double")
    got = np.array([r.vector for r in V.truncated_svd(w, 3).orderBy("doc_id").collect()])
    assert np.allclose(got @ got.T, x @ x.T, atol=1e-6)


def test_assignment_is_the_best_of_all():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        s = rng.random((n, n))
        best = max(sum(s[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert sum(s[i, j] for i, j in enumerate(factor.assign(s))) == pytest.approx(best)


def test_factorisation_finds_planted_blocks_locally_and_spread(spark):
    pairs = [(a, b, 8.0) for a in range(20) for b in range(a + 1, 20) if a // 10 == b // 10]
    e = spark.createDataFrame(pairs, "i int, j int, weight double")
    fit = factor.symnmf(e, 2, seed=1)
    assert len({int(r.argmax()) for r in fit.h[:10]}) == 1 and fit.h[0].argmax() != fit.h[10].argmax()
    few = factor.symnmf(e, 2, seed=1, rounds=4)
    spread = factor.symnmf(e, 2, seed=1, rounds=4, local_below=0)
    assert np.allclose(few.h, spread.h)
    assert factor.best_k([(2, 0.1, 0.90001), (3, 0.1, 0.90002), (4, 0.1, 0.8)]) == 3


def test_nmf_equals_its_definition_and_its_rows_are_laid_out_by_executors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = (rng.random((30, 12)) < 0.4) * 1.0
    x[np.arange(12), np.arange(12)] = 1
    rows_ = spark.createDataFrame([(int(b), 5 * int(i)) for b, i in zip(*np.nonzero(x), strict=True)], "basket int, item int")
    h = np.random.default_rng(0).random((12, 2)) + 0.1
    for _ in range(3):
        w = np.ones((30, 2))
        for _ in range(10):
            w *= (x @ h) / (w @ (h.T @ h) + 1e-12)
        h = h * (x.T @ w) / (h @ (w.T @ w) + 1e-12)
    monkeypatch.setattr(factor, "PIECE", 64)
    fit = factor.nmf(rows_, 2, rounds=3, tol=0)
    assert list(fit.items) == [5 * i for i in range(12)] and np.allclose(fit.h, h)
    table = factor.as_table(spark, fit)
    assert {(r.item, r.topic): r.weight for r in table.collect()} == {(5 * i, t): fit.h[i, t] for i in range(12) for t in range(2)}
    assert "LogicalRDD" not in table._jdf.queryExecution().optimizedPlan().toString()  # rows of the driver


def test_hierarchy_splits_and_frontier(spark):
    pairs = [(a, b, 8.0 if a // 10 == b // 10 else 3.0) for a in range(40) for b in range(a + 1, 40) if a // 20 == b // 20]
    nodes = factor.hierarchy(spark.createDataFrame(pairs, "i int, j int, weight double"), 2, least=15, deepest=2, stable=0.3, rounds=80)
    assert sorted(len(nodes[x].members) for x in nodes[0].children) == [20, 20]
    assert factor.frontier(nodes, 1) == [0] and factor.frontier(nodes, 2) == sorted(nodes[0].children)
    assert factor.cut(spark, nodes, 2).count() == 40 and factor.tree_table(spark, nodes).count() == len(nodes)


def test_merges(spark):
    old = spark.createDataFrame([(1, "roster", "a"), (2, "meta", "b")], "k int, cohort string, v string")
    new = spark.createDataFrame([(1, "meta", "x"), (2, "meta", "y"), (3, "meta", "z")], "k int, cohort string, v string")
    assert rows(merge.upsert(old, new, ["k"], F.col("cohort") == "roster")) == [(1, "roster", "a"), (2, "meta", "y"), (3, "meta", "z")]
    assert merge.assert_unique(new, ["k"]).count() == 3
    with pytest.raises(Exception, match="repeats"):
        merge.assert_unique(new.unionByName(new), ["k"]).collect()
    with pytest.raises(Exception, match="missing"):
        merge.require(new.withColumn("v", F.lit(None).cast("string")), ["v"]).collect()
    assert [one(spark, lambda v: merge.share_target(v, F.lit(100)), x, "int") for x in (100, 1, 25)] == [25, 5, 12]


def test_readers(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n\n{"a": 2}\n')
    assert rows(readers.json_lines(spark, str(tmp_path / "x.jsonl.gz"), "a int", 2)) == [(1,), (2,)]
    (tmp_path / "y.json").write_text('[{"type": "t", "a": 1},\n {"type": "u", "a": 2}]')
    index = readers.json_array(spark, str(tmp_path / "y.json"), "type string, a int")
    assert readers.bulk_entry(index, "u")["a"] == 2
    with pytest.raises(KeyError):
        readers.bulk_entry(index, "none")
    (tmp_path / "deck.txt").write_text("# mine\nCommander: Kyler\n\n3x Ring # note\n2 Bolt\nElf *CMDR*\n")
    got = readers.decklists(spark, str(tmp_path / "deck.txt")).drop("file")
    assert rows(got) == sorted([(1, "Kyler", True), (3, "Ring", False), (2, "Bolt", False), (1, "Elf", True)], key=str)
    assert rows(readers.unresolved(got, spark.createDataFrame([("Ring",), ("Bolt",), ("Elf",)], "name string"))) == [("Kyler", 1)]


def test_audit_log_keeps_the_last_line_of_a_url(spark):
    lines = ["s, problems: none, u1", "s, problems: illegal_cards [2] (a, b), u1", "s, problems: stale, u1", "s, problems: wrong_size, u2", "junk"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert [(r.url, r.n_illegal, r.illegal) for r in readers.audit_log(df).collect()] == [("u1", 2, ["a", "b"])]


def test_nested_records(spark):
    html = '<div class="book"><h3 class="t">A &amp; B</h3><img src="x"><p class="p">£5</p></div><div class="book"><h3 class="t">C</h3></div>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert rows(readers.html_records(pages, "book", {"title": "t", "price": "p"})) == [(1, 0, "A & B", "£5"), (1, 1, "C", "N/A")]
    data = spark.createDataFrame([('<script id="__D__" type="x">{"a": [1, 2]}</script>',), ("no",)], "h string")
    assert [r[0] and r[0].a for r in data.select(readers.embedded_json(F.col("h"), "__D__", "a array<int>")).collect()] == [[1, 2], None]
    reg = spark.createDataFrame([("1", "a", [], [("i1",)], ["x"]), ("2", "b", ["1", "9"], [("i2",)], [])], "id string, slug string, parent_ids array<string>, taggings array<struct<oracle_id:string>>, aliases array<string>")
    nodes, e, tagged, aliases = readers.tag_registry(reg)
    assert rows(C.expand(tagged, C.closure(nodes, e))) == [("i1", "a"), ("i2", "a"), ("i2", "b")] and rows(aliases) == [("a", "x")]


def test_two_faced_card(spark):
    schema = "card struct<oracle_id:string,name:string,mana_cost:string,cmc:double,type_line:string,oracle_text:string,power:string,toughness:string,image_uri:string,prices:struct<usd:string>,legalities:struct<commander:string>,card_faces:array<struct<name:string,mana_cost:string,oracle_text:string,power:string,toughness:string,image_uri:string>>>"
    card = {"card": {"oracle_id": "o", "name": "A // B", "cmc": 2.0, "type_line": "Legendary Creature // Land", "prices": {"usd": "1.5"}, "legalities": {"commander": "legal"}, "card_faces": [{"name": "A", "oracle_text": "x", "power": "1", "image_uri": "front"}, {"name": "B", "oracle_text": "y", "power": "4"}]}}
    r = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(card)])).select(*readers.flat_card()).first()
    assert (r.oracle_text, r.power, r.image_uri, r.price_usd, r.legal_commander, r.is_land, r.can_be_commander) == ("x // y", "1 // 4", "front", 1.5, True, True, True)


def test_board_and_assembly(spark):
    cases = [([], True), (["In"], True), (["Maybe"], False), (["Maybe", "In"], False), (["In", "Sideboard"], False), (["New"], True)]
    df = spark.createDataFrame([(c, {"In": True, "Maybe": False}) for c, _ in cases], "c array<string>, m map<string,boolean>")
    assert [r[0] for r in df.select(readers.in_deck(F.col("c"), F.col("m"))).collect()] == [w for _, w in cases]
    lines = spark.createDataFrame([(1, "Ring", 1), (1, "Ring", 2), (1, "Gone", 4), (1, "Boss", 1)], "basket int, name string, qty int")
    names = spark.createDataFrame([("Ring", 7), ("Boss", 8)], "name string, item int")
    got, lost = readers.assemble(lines, names, spark.createDataFrame([(1, 8)], "basket int, item int"))
    assert rows(got) == [(1, 7, 3)] and rows(lost) == [(1, 1, 4, ["Gone"])]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    path = str(tmp_path / "t")
    sinks.write_table(df, path, {"fetch_date": "2026-01-01T00:00:00+00:00"})
    meta = readers.read_sidecar(spark, path)
    from datetime import datetime, timezone

    assert readers.is_fresh(meta, df.schema, now=datetime(2026, 1, 10, tzinfo=timezone.utc)) and not readers.is_fresh(meta, df.schema, now=datetime(2026, 2, 1, tzinfo=timezone.utc))
    sinks.replace_partitions(df, str(tmp_path / "p"), ["k"])
    sinks.replace_partitions(spark.createDataFrame([(2, "z")], "k int, s string"), str(tmp_path / "p"), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "p")).select("k", "s")) == [(1, "a"), (2, "z")]
    for _ in range(2):
        sinks.append_log(spark, str(tmp_path / "log"), "s", "2026", 1, 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    scored = spark.createDataFrame([(0, 1, 2.0, None), (0, 2, 0.0, 1.0)], "i int, j int, tscore double, pmi double")
    assert sinks.write_matrices(scored, str(tmp_path / "m"), ["tscore", "pmi"])["pairs"] == {"tscore": 1, "pmi": 1}
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert "| 1 | a |" in sinks.markdown("T", {"rows": df})


def test_profile_helpers(spark):
    df = spark.createDataFrame([("a", 1), ("", 2), ("N/A", None)], "s string, n int")
    assert [r[0] for r in df.select(profile.complete(["s", "n"])).collect()] == [True, False, False]
    assert one(spark, profile.star_rating, [0, 0, 0, 0, 2], "array<int>") == 5.0 and one(spark, profile.star_rating, [0, 0], "array<int>") is None
    assert one(spark, profile.price_usd, 1.001, "double") == 1.01


def test_search_url_stops_before_its_limit(spark):
    df = spark.createDataFrame([(1, k, "x" * 10) for k in range(5)], "`group` int, place int, name string")
    assert readers.search_urls(df, "b", 40).first()["url"] == 'b!"xxxxxxxxxx" or !"xxxxxxxxxx"'


def test_entry_has_sql_only_for_its_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_granularity_curve(spark):
    from plinth.operators import reports

    nodes = [factor.Node(0, None, 0, {k: (1.0, 1.0) for k in range(20)}), factor.Node(1, 0, 1, {k: (1.0, 1.0) for k in range(10)}), factor.Node(2, 0, 1, {k: (1.0, 1.0) for k in range(10, 20)})]
    nodes[0].children = [1, 2]
    labels = spark.createDataFrame([(k, "low" if k < 10 else "high") for k in range(20)] + [(k, "all") for k in range(20)], "item long, tag string")
    got = {r.leaves: (r.n_topics, r.covered, r.resolved_30) for r in reports.granularity_curve(nodes, labels, [1, 2], lift=1.5, fdr=0.05).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 2, 2)}


def test_spaces_and_empty_reports(spark):
    from plinth.operators import reports

    df = spark.createDataFrame([(1.0, 2.0, "x")], "text_a double, cost_b double, text_c string")
    assert reports.space_columns(df, "text") == ["text_a"] and reports.space_columns(df, "all") == ["text_a", "cost_b"]
    with pytest.raises(KeyError):
        reports.space_columns(df, "none")
    assert rows(reports.above_median(spark.createDataFrame([(1,), (2,), (9,), (None,)], "v int"), "v")) == [(1, 0), (2, 0), (9, 1), (None, None)]
    assert reports.harvested(spark.createDataFrame([(1, "a", 2)], "template int, name string, qty int"), spark.createDataFrame([], "name string, item int")).collect() == [(1, None, None, 1)]


def by_hand(held, least):
    """(scope, i, j): (raw, joint) of rows (scope, basket, item, w, u)."""
    want = {}
    for s, b, i, w, u in held:
        for t, c, j, _, v in held:
            if (s, b) == (t, c) and i < j:
                n, x = want.get((s, i, j), (0, 0.0))
                want[s, i, j] = (n + 1, x + w * u * v)
    return {k: v for k, v in want.items() if v[0] >= least}


@pytest.fixture(scope="module")
def held(spark):
    """Baskets of two scopes, with an item that is in all of them, weights and negative ids."""
    import random

    rng = random.Random(5)
    one = lambda b, i: ("xy"[b % 2], f"b{b}", i * 1000 - 7000, 1.0 + b, 0.5 if i % 3 else 1.0)
    return [one(b, i) for b in range(30) for i in [0, *rng.sample(range(1, 40), b)]]


def test_pairs_are_counted_in_tasks_that_grow_in_number_not_in_size(spark, held):
    table = spark.createDataFrame(held, "scope string, basket string, item long, w double, u double")
    want = by_hand(held, 3)
    for part in (50, 1 << 21):
        made = A.pair_counts(table, 3, ("scope",), part)
        got = {(r.scope, r.i, r.j): (r.raw, r.joint) for r in made.collect()}
        assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
        assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()  # pairs don't leave the task that makes them
        n = sum(b * (b + 1) // 2 for b in range(30))
        assert n / part / 2 <= made.rdd.getNumPartitions() <= 33 + 2 * n / part


def test_sums_of_given_pairs_over_the_baskets_that_hold_them(spark, held):
    from plinth.operators.pairs import sums

    table = spark.createDataFrame([r[1:] for r in held], "basket string, item long, w double, u double")
    given = {(i, j): (i + 2 * j) / 1000 for i in range(-7000, 20000, 2000) for j in range(i + 1000, 33000, 3000)}
    pairs = spark.createDataFrame([(i, j, v) for (i, j), v in given.items()], "i long, j long, v double")
    want = {}
    for _, b, i, *_ in held:
        for _, c, j, *_ in held:
            if b == c and (i, j) in given:
                for x in (i, j):
                    want[b, x] = want.get((b, x), 0.0) + given[i, j]
    for part in (50, 1 << 21):
        got = sums(table, pairs, "v", part).groupBy("basket", "item").agg(F.sum("s").alias("s")).collect()
        assert {(r.basket, r.item): pytest.approx(r.s) for r in got} == want


def test_baskets_are_made_and_measures_taken_once(spark, monkeypatch):
    import os

    from plinth.plans import baskets as plans
    from plinth.plans import files

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    made, real, seen = [], plans.M.baskets, []
    monkeypatch.setattr(plans.M, "baskets", lambda *a: made.append(a) or real(*a))
    for one in (plans.pair_counts_weighted, plans.tscore_by_stratum, plans.cut_candidates):
        made.clear()
        one(spark, sf)
        assert len(made) == 1
    monkeypatch.setattr(files.sinks, "write_matrices", lambda scored, *a: seen.append(scored) or {"pairs": {"tscore": 1}})
    files.matrix_manifest(spark, sf)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan  # both measures read what is written


def test_products_of_the_executors_hold_only_items_that_edges_meet():
    import tracemalloc

    import pyarrow as pa

    keys, f = np.arange(1_000_000) * 3, np.ones((1_000_000, 8))
    batch = pa.RecordBatch.from_pydict({"i": [3, 3, 9], "j": [6, 2_999_997, 9_000], "v": [1.0, 2.0, 4.0]})
    tracemalloc.start()
    made = list(factor._products(keys, f, [batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {k: x for k, x in zip(*(made[0].column(c).to_pylist() for c in ("k", "x7")), strict=True)}
    assert got == {1: 3.0, 2: 1.0, 3: 4.0, 3000: 4.0, 999_999: 2.0} and most < f.nbytes / 10


def test_pairs_are_counted_once_for_both_directions(spark):
    import os

    from plinth.plans import baskets as plans

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    made = plans.scope_popularity(spark, sf)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "FlatMapGroups" not in plan  # both directions read what is written


def test_skip_gram_learns_groups_in_several_tasks(spark):
    import random

    rng = random.Random(1)
    held = [(b, 100 * (b % 2) + i) for b in range(1200) for i in rng.sample(range(10), 6)]
    model = V.skip_gram(spark.createDataFrame(held, "basket int, item int"), 8, share=2500)
    assert model.getOrDefault("numPartitions") == 3
    v = {int(r.word): np.array(r.vector) / np.linalg.norm(r.vector) for r in model.getVectors().collect()}
    assert len(v) == 20
    same = np.mean([v[a] @ v[b] for a in v for b in v if a < b and a // 100 == b // 100])
    assert same > np.mean([v[a] @ v[b] for a in v for b in v if a // 100 < b // 100]) + 0.3


def test_lines_beyond_the_partitions_are_dealt_to_more_tasks(spark, monkeypatch):
    import os

    from plinth.sources import model

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    want = rows(model.baskets(spark, sf))
    monkeypatch.setattr(model, "LINES", 700)
    made = model.baskets(spark, sf)
    assert made.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 700) and rows(made) == want


def test_steps_before_pairs_have_tasks_by_lines(spark, monkeypatch):
    import os

    from plinth.operators.pairs import Dealt, deal
    from plinth.plans import baskets as plans

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    want, counted = rows(plans._entries(spark, sf)), rows(plans.pmi(spark, sf))
    monkeypatch.setattr(plans.M, "LINES", 700)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 700)
    made = plans._entries(spark, sf)
    assert made.rdd.getNumPartitions() == n > 4 and rows(made) == want
    assert A.marginals(made, tasks=n).rdd.getNumPartitions() == n
    assert len(deal(made, tasks=n).packed.inputFiles()) == n
    assert rows(plans.pmi(spark, sf)) == counted
    monkeypatch.setattr(plans.M, "BYPASS", 2)
    assert plans.M.pieces(spark, sf) == max(2, n // 4)
    several = Dealt(made, np.arange(9000), np.ones(9000, np.int64), "long", "long", ())
    assert several.tasks == 9000 // 32  # ranges share a task, so that map tasks hold no rows for thousands of others


def test_memberships_have_tasks_by_rows(spark, monkeypatch):
    import os

    from plinth.plans import baskets as plans

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    want = rows(plans._members(spark, sf))
    monkeypatch.setattr(plans.M, "LINES", 200)
    n = -(-8 * spark.read.parquet(f"{sf}/part.parquet").count() // 200)
    made = plans._members(spark, sf)
    assert made.rdd.getNumPartitions() == n > 4 and rows(made) == want


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """More items than may be broadcast, in a file that is small enough for Spark's own estimate."""
    path = str(tmp_path_factory.mktemp("many") / "catalog")
    spark.range(500_000).select(F.col("id").alias("item"), F.lit(1).alias("mask")).write.parquet(path)
    return spark.read.parquet(path)


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_a_large_catalogue_is_not_broadcast(spark, many):
    from plinth.operators import eligibility as E

    eligible = spark.createDataFrame([(1, 4, 4.0)], "mask int, n long, weighted double")
    stats = spark.createDataFrame([(1, 2, 3, 3.0, 2.0, 2.0)], "i long, j long, raw long, joint double, m_i double, m_j double")
    made = E.conditioned_tscore(stats, many, eligible)
    assert joins(made)[0] == 2
    assert rows(made) == [(1, 2, 3, (3.0 - 4.0 * 0.5 * 0.5) / math.sqrt(3.0))]


def test_many_excluded_items_are_not_broadcast(spark, many):
    pairs = spark.createDataFrame([(1, 2, 1.0), (500_001, 500_002, 1.0), (3, 500_003, 1.0)], "i long, j long, v double")
    made = graph.topk_union(pairs, "v", 2, many)
    assert joins(made)[1] == 0
    assert rows(made) == [(500_001, 500_002)]
