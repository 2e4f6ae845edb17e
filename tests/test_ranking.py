import pytest

from lexigrid.plans import ranking

CANDIDATES = "cand_id bigint, word_id bigint, analyzer string, native_rank int, decomp string, n_parts int, weight double, lenient boolean, score double"
WORDS = "id bigint, word string, freq bigint, analyzer_outcome string, decomps array<string>, top_decomp array<string>"


@pytest.fixture
def tables(spark, tmp_path):
    def write(candidates=(), words=()):
        spark.createDataFrame([(i, w, a, n, d, 1, 0.0, False, s) for i, (w, a, n, d, s) in enumerate(candidates)], CANDIDATES).write.parquet(f"{tmp_path}/candidates.parquet")
        spark.createDataFrame(words, WORDS).write.parquet(f"{tmp_path}/words.parquet")
        return str(tmp_path)

    return write


def test_next_affix_takes_the_analysis_that_lacks_the_fewest(spark, tables):
    common = "".join(f"{{x:c{i}/1nn}}" for i in range(10))
    rows = [(w, "r2l", 0, "{r:r/1n}" + common, 1.0) for w in range(10, 15)]
    rows += [(1, "r2l", 0, "{r:r/1n}{a:a/1nn}{b:b/1nn}", 1.0), (1, "r2l", 1, "{r:r/1n}{b:b/1nn}{c0:c0/1nn}", 0.5)]
    rows += [(2, "r2l", 0, "{r:r/1n}{a:a/1nn}", 1.0), (2, "r2l", 1, "{r:r/1n}{c1:c1/1nn}", 0.5), (3, "r2l", 0, "{r:r/1n}{a:a/1nn}", 1.0)]
    got = ranking.a08_next_affix(spark, tables(rows)).collect()
    assert {x["affix"]: x["words"] for x in got} == {"b/1nn": 1, "a/1nn": 1}


def test_seed_expansion_uses_the_first_two_analyses(spark, tables):
    word = lambda i, freq, *d: (i, "w", freq, "completed", list(d), [d[0].strip("{}").split(":")[1]] if d else None)
    rows = [
        word(1, 2000, "{a:a/1n}", "{b:b/1n}{mi:mi/tn-loc-s}", "{e:e/1n}"), word(2, 1, "{c:c/1n}", "{b:b/1n}"), word(3, 1, "{a:a/1n}{x:x/tn-dat-s}", "{b:b/1n}"),
        word(4, 1, "{c:c/1n}", "{d:d/1n}", "{a:a/1n}"), word(5, None, "{e:e/1n}"), word(6, 5000),
    ]
    got = ranking.j17_seed_expansion(spark, tables(words=rows)).collect()
    assert sorted(map(tuple, got)) == [(1, "a/1n"), (2, "b/1n"), (3, "a/1n")]


def test_words_without_output_are_counted(spark, tables):
    words = [(i, "w", 1, "completed", ["{a:a/1n}", "{b:b/1n}"], ["a/1n"]) for i in (1, 2, 3, 4)] + [(5, "w", 1, "completed", [], None)]
    rows = [(1, "r2l", 0, "{a:a/1n}", 1.0), (2, "r2l", 0, "{x:x/1n}", 1.0), (3, "r2l", 0, None, 1.0), (3, "r2l", 1, "{a:a/1n}", float("nan")), (5, "r2l", 0, "{a:a/1n}", 1.0)]
    sf = tables(rows, words)
    assert sorted(map(tuple, ranking.a12_matches_by_word(spark, sf).collect())) == [(1, 1, 1, 1), (2, 1, 0, None), (3, 0, 0, None), (4, 0, 0, None)]
    assert {r["outcome"]: (r["n"], r["mean_produced"]) for r in ranking.a15_outcomes(spark, sf).collect()} == {"first": (1, 1.0), "absent": (1, 1.0), "none": (2, 0.0)}
    m = ranking.a16_ranking_metrics(spark, sf).collect()[0]
    assert (m["recall"], m["precision"], m["mrr"], m["at1"]) == (0.125, 0.5, 0.25, 1)
    assert [tuple(r) for r in ranking.a30_miss_rates(spark, sf).collect()] == [(2, 4, 3, 0.75)]


def test_first_of_both_analyzers_shows_both_sides(spark, tables):
    rows = [(1, "r2l", 0, "{a:a/1n}", 1.0), (1, "fst", 0, "{a:a/1n}", 1.0), (2, "r2l", 0, "{a:a/1n}", 1.0), (3, "fst", 0, "{a:a/1n}", 1.0), (4, "fst", 0, None, 1.0)]
    got = ranking.j20_first_of_both_analyzers(spark, tables(rows)).collect()
    assert sorted(map(tuple, got)) == [(1, True, False, False), (2, False, False, True), (3, False, True, False)]
