import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.functions import morphemes as M
from lexigrid.operators import candidates as C
from lexigrid.operators import dialect, ranker
from lexigrid.operators.trees import score_rows


def _problem(n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n * 6, 3))
    groups = np.repeat(np.arange(n), 6)
    truth = 2 * (x[:, 0] > 0.3) + x[:, 1]
    labels = np.zeros(len(x))
    for g in range(n):
        labels[g * 6 + truth[g * 6 : g * 6 + 6].argmax()] = 1
    return x, labels, groups


def test_trees_learn_the_order_and_their_thresholds_are_raw_values(spark):
    x, labels, groups = _problem()
    names = ["a", "b", "c"]
    trees = ranker.train_trees(x, labels, groups, names, ranker.Boosting(rounds=60))
    score = ranker.scores_of(trees, x, names, 0.1)
    hits, total = ranker.hits_at_1(score, labels, groups)
    assert total == 200 and hits > 170
    held, truth, of = _problem(seed=7)
    assert ranker.hits_at_1(ranker.scores_of(trees, held, names, 0.1), truth, of)[0] > 150
    # Written, read and run in batches, every row scores alike.
    back, rate = ranker.read_model(ranker.write_model(trees, names, 0.1), names)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:300])], "k bigint, a double, b double, c double")
    got = {r["k"]: r["score"] for r in score_rows(rows, "k", names, back, rate).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(score[:300].tolist(), abs=1e-9)
    with pytest.raises(ValueError):
        ranker.read_model(ranker.write_model(trees, names, 0.1), ["b", "a", "c"])
    assert ranker.train_trees(x, np.zeros(len(x)), groups, names) == []


@pytest.mark.parametrize("listwise", [False, True])
def test_linear_rankers(listwise):
    x, labels, groups = _problem()
    w = ranker.train_linear(x, labels, groups, listwise)
    assert ranker.hits_at_1(x @ w, labels, groups)[0] > 120 and abs(w[2]) < min(abs(w[0]), abs(w[1]))


def test_nested_validation_tests_every_group_once():
    x, labels, groups = _problem(60)
    out = ranker.nested_validation(x, labels, groups, ["a", "b", "c"], [ranker.Boosting(rounds=5, depth=d) for d in (1, 2)], outer=4, inner=2)
    assert sum(r["words"] for r in out) == 60 and len(out) == 4


@pytest.mark.parametrize("values", [[], [3.0, None, 1.0, 1.0], [float(i * 7919 % 1009) for i in range(3000)], [1.0] * 500 + [2.0] * 3 + [float(i) for i in range(40)]])
def test_quantile_edges(spark, values):
    got = sorted(r["edge"] for r in C.quantile_edges(spark.createDataFrame([(v,) for v in values], "x double"), "x", 16).collect())
    real = sorted(v for v in values if v is not None)
    want = sorted(set(real)) if len(set(real)) <= 16 else [real[len(real) * q // 16] for q in range(1, 16)]
    assert got == want


def test_bins_are_those_of_a_binary_search(spark):
    edges = [1.0, 2.0, 2.5]
    rows = spark.createDataFrame([(v,) for v in (0.5, 1.0, 2.2, 9.0)], "x double")
    assert [r["b"] for r in rows.select(C.bin_of(F.col("x"), edges).alias("b")).collect()] == [0, 1, 2, 3]


def test_dialect_spellings_against_brute_force(spark):
    words = ["apkaqtuq", "ikpak", "inuk", "qanNut", "a", ""]
    table = dialect.pairs()

    def near(w):
        return {w[:i] + b + w[i + 2 :] for i in range(len(w) - 1) for a, b in table if w[i : i + 2] == a}

    got = dialect.spellings(spark.createDataFrame(list(enumerate(words)), "id bigint, w string"), "id", "w").collect()
    for i, w in enumerate(words):
        one = near(w)
        want = {w} | one | {v for u in one for v in near(u)}
        assert {r["variant"] for r in got if r["id"] == i} == want
        assert all(r["steps"] == (0 if r["variant"] == w else 1 if r["variant"] in one else 2) for r in got if r["id"] == i)


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("identifier", "want"),
    [
        ("mni/tn-loc-s-1s", "possessive noun ending; locative singular; 1st person singular possessor"), ("x/1n", "noun root"), ("x/2vv", "verb-to-verb suffix"), ("x/tv-part-1s-3p-prespas", "transitive verb ending; past/present participial 1st person singular; 3rd person plural object"),
        ("x/tv-ger-3d", "intransitive verb ending; gerundive 3rd person dual"), ("x/rad-sc", "demonstrative adverb root; static/short referent"), ("x/zz", ""),
    ],
)
def test_grammar_in_words(spark, identifier, want):
    assert _one(spark, M.grammar(F.col("i")), i=identifier) == want


@pytest.mark.parametrize(("html", "want"), [("I don&#039;t <b>know</b>", "I don't know"), ("&#x1F642;&NBSP;&amp;lt; &unknown; &", "🙂\xa0&lt; &unknown; &".replace("\xa0", " ")), (" \xa0a&#9999999;b\xa0", "a&#9999999;b"), ("", "")])
def test_entities(spark, html, want):
    assert _one(spark, M.decoded(F.col("h")), h=html) == want


def test_page_rows(spark):
    page = '<div id="romanized" class="x">\nnuna</div>\n <div id="syllabic"><i>ᓄᓇ</i></div><div id="term">land &amp; sea</div> x <div id="romanized">a</div><div id="syllabic">b</div>\n<div id="term">c</div>'
    assert [tuple(r) for r in _one(spark, M.table_rows(F.col("h")), h=page)] == [("nuna", "ᓄᓇ", "land & sea"), ("a", "b", "c")]
    assert _one(spark, M.table_rows(F.col("h")), h="") == []


def test_small_functions(spark):
    assert _one(spark, M.braced(F.col("i")), i=" a/1n} ") == "{a/1n}" and _one(spark, M.unbraced(F.col("i")), i="{a /1n}") == "a/1n"
    assert _one(spark, M.specs(F.col("i")), i="{ab/12vv}") == "vv" and _one(spark, M.canonical(F.col("i")), i="none") is None
    assert _one(spark, M.json_text(F.col("i")), i='a"\\') == 'a\\"\\\\'
    assert _one(spark, M.cause_chain(F.array("a", "b", "c")), a="x", b=None, c="x") == "x"
    for ending, want in (("tv-ger-3s", "he/she Vims"), ("tv-dec-1s-3p", "I Vim them"), ("tv-xx", None)):
        assert _one(spark, M.verb_meaning(F.col("a"), F.col("b")), a="Vim", b=ending) == want
    assert _one(spark, M.noun_meaning(F.col("a"), F.col("b")), a="house", b="tn-gen-p") == "of houses" and _one(spark, M.noun_meaning(F.col("a"), F.col("b")), a="house", b="tn-xx") is None


def test_places_of_large_words_and_sums_of_rare_morphemes(spark, monkeypatch):
    monkeypatch.setattr(C, "LARGE_WORD", 20)
    rng = np.random.default_rng(3)
    data = [(i, [7, 7, 8, 9 + i % 4][i % 4], int(rng.integers(5)), [0.0, None, float("inf"), 1.0][int(rng.integers(4))], *map(int, rng.integers(1, 4, 5)), ["ab", f"c{i % 3}"][: 1 + i % 2], ["1n", "2vv"][: 1 + i % 2]) for i in range(120)]
    rows = spark.createDataFrame(data, "cand_id long, word_id long, native_rank int, weight double, root_canon_len int, n_nonroot int, edit_dist int, n_morphemes int, type_violations int, canon array<string>, ids array<string>")
    prior = {"ab/1n": 5000, "c0/2vv": 3, "c1/2vv": 2_000_000}
    got = {r["cand_id"]: r for r in C.places(rows).join(C.frequencies(rows, spark.createDataFrame(list(prior.items()), "key string, n long")), "cand_id").collect()}
    assert len(got) == len(data)
    rising = lambda v: (v is not None, v)
    orders = {
        "rank_current_sort": lambda r: (rising(r[3]), -r[4], r[5]), "edit_dist_rank_in_word": lambda r: r[6], "n_morphemes_rank_in_word": lambda r: r[7],
        "root_canon_len_rank_in_word": lambda r: -r[4], "type_violations_rank_in_word": lambda r: r[8],
    }
    for word in {r[1] for r in data}:
        of = [r for r in data if r[1] == word]
        for name, key in orders.items():
            for place, r in enumerate(sorted(of, key=lambda r: (key(r), r[2], r[0]))):
                assert got[r[0]][name] == place and got[r[0]]["n_candidates"] == len(of)
    for r in data:
        n = [prior.get(f"{c}/{i}", 0) for c, i in zip(r[9], r[10])]
        assert [got[r[0]][k] for k in ("freq_sum", "freq_mean", "freq_min", "freq_root", "n_zero_freq")] == [sum(n), sum(n) / len(n), min(n), n[0], n.count(0)]
