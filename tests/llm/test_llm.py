import math
import random
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrid.llm import analyses, consistent, lookalikes, mixture, splits, terms, tokens, topn, truncated

tiktoken = pytest.importorskip("tiktoken")


# Problem 1


def _components(edges):
    of = {}
    for a, b in edges:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            of.update(dict.fromkeys(y, x))
    return {v: frozenset(s) for v, s in of.items()}


@pytest.mark.parametrize("edges", [[], [("a", "a")], [("a", "b"), ("b", "a"), ("a", "b")], [(f"{i:03}", f"{i + 1:03}") for i in range(120)], [("hub", str(i)) for i in range(60)] + [("x", "y"), ("y", None)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    got = splits.components(df).collect()
    want = _components([e for e in edges if None not in e])
    assert {r["v"] for r in got} == set(want) and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r["label"], set()).add(r["v"])
    assert {frozenset(s) for s in by.values()} == set(want.values())


def test_record_groups_and_splits(spark):
    cases = [
        (1, " Nuna ", None), (2, "ᓄᓇ", ""), (3, "x", "{a:root/1n}{b:c/1nv};"), (4, "y", ";; {q:root/1n}"), (5, None, None), (6, "", "{a:other/1n}"), (7, None, "{r:root/1n};{s:other/1n}"), (8, None, None),
    ]
    df = spark.createDataFrame([(*c, "z") for c in cases], "case_id bigint, word string, all_correct_decomps string, id string")
    groups = splits.record_groups(splits.case_keys(df))
    assert {r["id"]: (r["group_id"], r["size"]) for r in groups.collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 4), 4: (3, 4), 6: (3, 4), 7: (3, 4), 5: (5, 1), 8: (8, 1)}
    targets = spark.createDataFrame([("train", 0.75), ("test", 0.25), ("none", 0.0), (None, 1.0)], "split_name string, share double")
    got = {r["id"]: r["split_name"] for r in splits.assign_splits(groups, targets).collect()}
    assert set(got) == set(range(1, 9)) and len({got[i] for i in (3, 4, 6, 7)}) == 1 and got[1] == got[2] and set(got.values()) <= {"train", "test"}
    assert splits.assign_splits(splits.record_groups(splits.case_keys(df.limit(0))), targets).count() == 0


def test_shares_of_many_groups(spark):
    groups = spark.range(20000).select("id", F.expr("id DIV 2 * 2").alias("group_id"), F.lit(2).cast("long").alias("size"))
    targets = spark.createDataFrame([("a", 0.8), ("b", 0.1), ("c", 0.1)], "split_name string, share double")
    for r in splits.split_shares(splits.assign_splits(groups, targets), targets).collect():
        assert abs(r["share"] - r["target_share"]) < 0.002


def test_a_giant_group_and_skewed_sizes_keep_the_shares(spark):
    r = random.Random(3)
    sizes = [9000, 2500, 700, 700, 300] + [r.choice([1, 1, 1, 2, 5, 30]) for _ in range(4000)]
    rows, at = [], 0
    for n in sizes:
        rows += [(at + i, at, n) for i in range(n)]
        at += n
    groups = spark.createDataFrame(rows, "id bigint, group_id bigint, size bigint")
    targets = spark.createDataFrame([("a", 0.8), ("b", 0.1), ("c", 0.1)], "split_name string, share double")
    out = splits.assign_splits(groups, targets)
    assert out.count() == len(rows)
    assert out.join(groups, "id").groupBy("group_id").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    for x in splits.split_shares(out, targets).collect():
        assert abs(x["share"] - x["target_share"]) < 0.001
    # Groups of all sizes go to every split.
    assert out.join(groups, "id").where("split_name = 'b' AND size = 30").count() and out.join(groups, "id").where("split_name = 'b' AND size = 1").count()


# Problem 2


def test_terms_in_many_partitions(spark):
    n = 5000
    df = spark.range(n * 3).select(F.concat(F.lit("w"), F.col("id") % n, F.lit(" hot")).alias("t"))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.summed_terms(terms.term_counts(df, "t"), most_rows=8, bits=5).collect()}
    assert len(got) == n + 1 and got["hot"] == (3 * n, 3 * n) and set(got[f"w{i}"] for i in range(n)) == {(3, 3)}


@pytest.mark.parametrize(("rows", "bits"), [(2_000_000, 6), (3, 2)])
def test_terms(spark, rows, bits):
    texts = ["A b a", None, "", "c,c;c", "b " * 5000, "b1 é ᓄᓇ"]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, term string")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.summed_terms(terms.term_counts(df, "text"), rows, bits).collect()}
    assert got == {"a": (2, 1), "b": (5001, 2), "c": (3, 1), "b1": (1, 1), "é": (1, 1), "ᓄᓇ": (1, 1)}
    assert terms.summed_terms(terms.term_counts(df.limit(0), "text")).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([("x y",)] * 3 + [("x",)] * 97 + [(None,)], "text string")
    assert {r["term"]: r["mark"] for r in terms.marked_terms(df, "text").collect()} == {"x": "common", "y": "common"}
    assert {r["term"]: r["mark"] for r in terms.marked_terms(df.limit(1), "text").collect()} == {"x": "rare", "y": "rare"}


# Problem 4


def _brute(rows, n):
    best = {}
    for cand, word, rank, decomp, score in rows:
        if word is not None and decomp is not None and score is not None and not math.isnan(score):
            key = (-score, math.inf if rank is None else rank, decomp.encode(), cand)
            best[word, decomp] = min(best.get((word, decomp), key), key)
    by = {}
    for (word, _), key in best.items():
        by.setdefault(word, []).append(key)
    return {(w, k[3]) for w, ks in by.items() for k in sorted(ks)[:n]}


def test_best_analyses(spark):
    r = random.Random(3)
    scores = [0.1, 0.25, 0.5, 0.5000000001, -1.0, 0.0, -0.0, math.inf, -math.inf, 1e-310, 1e308, None, math.nan]
    rows = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([0, 0, 1, -5, None]), r.choice([None, "", "a" * r.randint(1, 30), "a" * 14 + r.choice("bcé🙂"), "{x:%d}" % r.randint(0, 20)]), r.choice(scores)) for i in range(1500)]
    df = spark.createDataFrame([(*x, 9) for x in rows], "cand_id bigint, word_id bigint, native_rank int, decomp string, score double, __g int")
    for n in (1, 3):
        assert {tuple(x) for x in analyses.best_analyses(df, n).collect()} == _brute(rows, n)
    assert analyses.best_analyses(df.limit(0)).count() == 0


def test_double_codes_keep_the_order(spark):
    xs = sorted({0.0, 5e-324, 2.2e-308, 1.0, 1 - 2**-53, 1 + 2**-52, 1.7976931348623157e308, math.inf, 3.0, 4.0, 0.1})
    xs = [-x for x in reversed(xs) if x] + xs
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["c"] for r in df.select(topn.double_code(F.col("x")).alias("c")).collect()]
    assert got == sorted(got) and len(set(got)) == len(xs)
    assert [r["c"] for r in df.select(topn.double_code(F.col("x"), True).alias("c")).collect()] == [-x for x in got]


def test_top_n_of_codes_that_span_all_longs(spark):
    xs = [-math.inf, -1e300, -5e-324, 0.0, 1.0, 1e300, math.inf] * 3
    rows = [(1, i, "t", x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, t string, x double")
    for n in (1, 4, 20):
        got = {r["i"] for r in topn.top_n(df, "g", n, [topn.double_code(F.col("x"))], "t", "i").collect()}
        assert got == {i for _, i, _, _ in sorted(rows, key=lambda r: (r[3], r[1]))[:n]}


def test_replaced_decomps(spark):
    c = spark.createDataFrame([(1, 1, 0, "{a:b/1n}{c:d/tn-x}", 0.5), (2, 1, 0, "{e:f/1v}", 0.9)], "cand_id bigint, word_id bigint, native_rank int, decomp string, score double")
    w = spark.createDataFrame([(1, ["old"], ["o"]), (2, ["old"], ["o"]), (3, None, None)], "id bigint, decomps array<string>, top_decomp array<string>")
    got = {r["id"]: (r["decomps"], r["top_decomp"]) for r in analyses.replaced_decomps(c, w).collect()}
    assert got == {1: (["{e:f/1v}", "{a:b/1n}{c:d/tn-x}"], ["f/1v"]), 2: (["old"], ["o"]), 3: (None, None)}


# Problem 5

SAME = [
    ("café", "café", "cаfé", "ｃａｆé", "ca​fé ", "caf­é"),
    ("ᐲᑕ", "ᐱ̇ᑕ", "Λ̇⊂", "ᐱ‍̇ᑕ"),
    ("ᕐᒃ".replace("ᕐᒃ", "ᖅ"), "ᕐᒃ"),
    ("a b", "a b", "a b", " a b ", "a  b"),
    ("12 ᑲ", "１２ ᑲ"),
    ("ạ̈", "ạ̈", "ạ̈"),
]


def test_consistent_form(spark):
    rows = [(i, j, t) for i, same in enumerate(SAME) for j, t in enumerate(same)] + [(90, 0, None), (91, 0, ""), (92, 0, "​  "), (93, 0, "A"), (94, 0, "́x"), (95, 0, "Λ" * 3000 + "ᑲ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "a int, b int, t string, kind string")
    got = {(r["a"], r["b"]): r["form"] for r in consistent.consistent_form(df, ["a", "b"], "t", "form").collect()}
    for i, same in enumerate(SAME):
        assert {got[i, j] for j in range(len(same))} == {same[0]}, same
    assert (90, 0) not in got and got[91, 0] == "" and got[92, 0] == "" and got[93, 0] == "A" and got[94, 0] == "́x" and got[95, 0] == "ᐱ" * 3000 + "ᑲ"
    assert consistent.consistent_form(df.limit(0), ["a", "b"], "t").count() == 0


def test_composition_agrees_with_unicode(spark):
    r = random.Random(1)
    texts = ["x" + "".join(r.choice(["a", "e", "o", "u", "c", "\u0146", "\u0323", "\u0301", "\u0302", "\u0308", "\u0304", "\u0327"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {r["id"]: r["consistent"] for r in consistent.consistent_form(df, ["id"], "t").collect()}
    for i, t in enumerate(texts):
        assert got[i] == unicodedata.normalize("NFC", t)


def test_look_alike_pairs(spark):
    rows = [("f", i, "ᐱᑕ") for i in range(50)] + [("f", 100 + i, "Λᑕ") for i in range(20)] + [("f", 200, "ᐱᑕ "), ("g", 1, "Λᑕ"), ("f", 300, ""), ("f", 301, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "field string, id bigint, text string, n int")
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and a[2] and b[2]}
    for block in (7, 4096):
        got = [tuple(r) for r in lookalikes.look_alike_pairs(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert lookalikes.look_alike_pairs(df.limit(0)).count() == 0


def test_skipping_consistent_texts_changes_nothing(spark):
    r = random.Random(9)
    kinds = ["aVdLPbqUJ<>", "éÀçßø", "ᐱᐲᕐᒃᑭᖕᒋᖅᑯ᙭", "-.?!() ", "  ", "12"]
    texts = list({"".join(r.choice(r.choice(kinds)) for _ in range(r.randint(1, 9))) for _ in range(6000)})
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    clean = df.where(consistent.is_consistent(F.col("t")))
    assert clean.count() > 300
    through = consistent._through_code_points(spark, clean.select(F.col("id").alias("__k0"), F.col("t").alias("__text")), ["__k0"], "form")
    got = {x["__k0"]: x["form"] for x in through.collect()}
    assert all(got[x["id"]] == x["t"] for x in clean.collect())
    # A composed letter between a sign and a look-alike.
    two = spark.createDataFrame([(1, "ᑭéd"), (2, "ᑭe\u0301d")], "id bigint, t string")
    assert len({x["f"] for x in consistent.consistent_form(two, ["id"], "t", "f").collect()}) == 1


def test_look_alike_classes(spark):
    rows = [(i, "x", t) for i, t in enumerate(["cafe", "cаfe", "cafe", "other", None, "", "cаfe"])] + [(i, "y", "cafe") for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, field string, text string")
    got = {(r["field"], r["id"]): (r["class_id"], r["partners"]) for r in lookalikes.look_alike_classes(df).collect()}
    assert got == {("x", 0): (0, 2), ("x", 1): (0, 2), ("x", 2): (0, 2), ("x", 6): (0, 2)}
    assert lookalikes.look_alike_classes(df.limit(0)).count() == 0


# Problem 7


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder(ranks):
    return tokens.PrefixEncoder(ranks)


@pytest.fixture(scope="module")
def public(ranks):
    return tiktoken.Encoding("t", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_encoding_is_the_public_one(encoder, public, ranks, text):
    ids = encoder.encode(text).tolist()
    assert ids == public.encode_ordinary(text) and tokens.decode_ids(ids, ranks) == text


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9999, "<|endoftext|>", "ᓄᓇᕗᑦ 🙂‍\n\n  x", " " * 3000])
def test_encoding_of_long_texts(encoder, public, text):
    assert encoder.encode(text).tolist() == public.encode_ordinary(text)


def test_encode_texts(spark, public):
    df = spark.createDataFrame([(1, "Hello there", "x"), (2, "", "x"), (3, None, None), (4, "a b", "x"), (4, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_texts(df).collect())
    assert got == [(1, public.encode_ordinary("Hello there")), (2, []), (3, []), (4, [64, 275]), (4, [64, 275])]
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert tokens.encode_texts(df.limit(0)).count() == 0


# Problem 8


def test_fill_and_budgets():
    assert mixture.fill(10, {"a": 1, "b": 1}, {"a": 2.0, "b": 100.0}) == pytest.approx({"a": 2, "b": 8})
    assert mixture.fill(10, {"a": 1, "b": 0}, {"a": 2.0, "b": 3.0}) == pytest.approx({"a": 2, "b": 3})
    # What d1/l1/a lacks goes to its sibling b before anything goes to d2.
    weights = {("d1", "l1", "a"): 1.0, ("d1", "l1", "b"): 1.0, ("d2", "l1", "c"): 2.0}
    caps = {("d1", "l1", "a"): 10.0, ("d1", "l1", "b"): 100.0, ("d2", "l1", "c"): 100.0}
    assert mixture.budgets(weights, caps, 100) == pytest.approx({("d1", "l1", "a"): 10, ("d1", "l1", "b"): 40, ("d2", "l1", "c"): 50})


def test_mixture(spark):
    r = random.Random(2)
    docs = [(i, " ".join("word" for _ in range(r.randint(1, 40))), r.choice(["en", "EN", "fr", None]), r.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    docs += [(9001, None, "en", "a"), (9002, "", "en", "a"), (9003, "x", "en", None), (9004, "x", "en", "d")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("e", 0.5, 1), ("d", None, 1)], "source string, target_share double, max_repeats int")
    got = mixture.mixture(df, targets)
    rows = got.collect()
    most = {"a": 1, "b": 3, "c": 2}
    assert all(1 <= x["copies"] <= most[x["source"]] for x in rows) and len({x["doc_id"] for x in rows}) == len(rows)
    sums = Counter()
    for x in rows:
        sums[x["source"]] += x["n_tokens"] * x["copies"]
    for s, share in (("a", 0.3), ("b", 0.4), ("c", 0.3)):
        assert abs(sums[s] / sum(sums.values()) - share) < 0.01
    assert {x["doc_id"] for x in rows} == {x["doc_id"] for x in mixture.mixture(df, targets).collect()}
    assert mixture.mixture(df.limit(0), targets).count() == 0 and mixture.mixture(df, targets.limit(0)).count() == 0


def test_a_short_source_is_made_up_by_its_domain(spark):
    docs = [(i, "word " * 10, "en", s) for i, s in enumerate(["a"] * 50 + ["b"] * 500 + ["c"] * 500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("a", 0.4, 1, "d"), ("b", 0.1, 2, "d"), ("c", 0.5, 1, None)], "source string, target_share double, max_repeats int, domain string")
    sums = {r["source"]: r["n"] for r in mixture.mixture(df, targets, total=5000.0, languages={}).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    # The domain keeps its half, although a has a tenth of its part.
    each = 5000 / sum(sums.values())
    assert abs(sums["c"] * each - 2500) < 60 and abs((sums["a"] + sums["b"]) * each - 2500) < 60 and sums["b"] > sums["a"]


# Problem 9


def test_truncated(spark):
    r = random.Random(4)
    nouns, verbs = ["report", "dictionary", "interpreter", "shoreline", "kayak", "lesson"], ["described", "corrected", "announced"]
    clause = lambda: f"the {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)}"
    docs = []
    for i in range(600):
        text = "; ".join(clause() for _ in range(3))
        docs.append((i, text, "notes"))
    cut = [(1000, "the report described the lesson; the kayak corr"), (1001, "the kayak announced the"), (1002, "the kayak described the interpre"), (1003, "the report described the lesson (see not"), (1004, "the lesson corrected the kayak;")]
    docs += [(*c, "notes") for c in cut]
    docs += [(2000 + i, f"The {r.choice(nouns)} {r.choice(verbs)} it. {clause()}.", "minutes") for i in range(300)]
    docs += [(3000 + i, f"The {r.choice(nouns)} {r.choice(verbs)} it. the {r.choice(nouns)[:4]}", "minutes") for i in range(8)] + [(3900, "The kayak described it. the kayak described the report", "minutes")]
    docs += [(5000, None, "notes"), (5001, "", "notes"), (5002, "  \n", "minutes"), (5003, "the kayak announced the report.", None), (5004, "x " * 20000 + "end.", "minutes")]
    df = spark.createDataFrame([(*d, "y") for d in docs], "doc_id bigint, text string, source string, word string")
    got = {r["doc_id"]: r["reason"] for r in truncated.judged(df).collect()}
    assert set(got) == {d[0] for d in docs}
    assert {k for k, v in got.items() if v} == {1000, 1001, 1002, 1003, 1004, *range(3000, 3008), 3900}
    rates = {r["source"]: (r["documents"], r["truncated"]) for r in truncated.truncation_rates(truncated.judged(df)).collect()}
    assert rates["notes"] == (607, 5)
    assert truncated.judged(df.limit(0)).count() == 0


def test_copies_of_a_cut_text_and_common_fragments_are_no_formulas(spark):
    r = random.Random(5)
    nouns, verbs = ["report", "dictionary", "interpreter", "shoreline", "kayak", "lesson"], ["described", "corrected", "announced"]
    clause = lambda: f"the {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)}"
    docs = [(i, "; ".join(clause() for _ in range(3)), "notes") for i in range(600)]
    docs += [(1000 + i, "the report described the lesson; the kayak described the interpre", "notes") for i in range(300)]
    docs += [(2000 + i, "; ".join(clause() for _ in range(1 + i % 4)) + "; the shoreline announced the dictio", "notes") for i in range(20)]
    # A word that only ends texts is a formula although longer words begin with it.
    docs += [(3000 + i, "; ".join(clause() for _ in range(3)) + "\nsee the key", "notes") for i in range(400)] + [(4000 + i, "see the keyboard; " + "; ".join(clause() for _ in range(3)), "notes") for i in range(200)]
    got = {x["doc_id"]: x["reason"] for x in truncated.judged(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert {k for k, v in got.items() if v} == {*range(1000, 1300), *range(2000, 2020)}


def test_longer_copies_against_brute_force(spark):
    r = random.Random(6)
    texts = {"".join(r.choice("ab ") for _ in range(r.randint(1, 7))) for _ in range(300)}
    got = {x["f"]: x["rest"] for x in truncated.longer_copies(spark.createDataFrame([(t,) for t in texts], "f string")).collect()}
    assert set(got) == {t for t in texts if any(u != t and u.startswith(t) for u in texts)}
    assert all(t + rest in texts and rest for t, rest in got.items())


def test_text_cut_inside_of_a_character_and_longer_copy(spark):
    docs = [(i, f"the report number{i} was read here", "notes") for i in range(50)] + [(100, "the report number7 was r", "notes"), (101, "the report number8 was read he�", "notes")]
    got = {x["doc_id"]: x["reason"] for x in truncated.judged(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert {k: v for k, v in got.items() if v} == {100: "copy", 101: "bytes"}


def test_an_end_that_closes_most_texts_is_spread(spark, monkeypatch):
    monkeypatch.setattr(truncated, "BLOCK", 20)
    docs = [(i, "the kayak announced the report", "notes") for i in range(500)] + [(1000 + i, f"the report announced number {i}; the kayak described the report", "notes") for i in range(300)] + [(2000, "the kayak announced the rep", "notes")]
    got = {x["doc_id"]: x["reason"] for x in truncated.judged(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert len(got) == len(docs) and {k for k, v in got.items() if v} == {2000}
