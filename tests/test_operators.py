import pytest
from pyspark.sql import functions as F

from lexigrid.functions import decomp as D
from lexigrid.functions import text as X
from lexigrid.functions.script import in_script, long_signs, roman_column, romans, syllabic_column, to_roman
from lexigrid.operators import analyzer as A
from lexigrid.operators.constraints import ConditionError, compiled
from lexigrid.operators.lookup import concordance, longest_prefix, word_index
from lexigrid.operators.ranks import numbered
from lexigrid.operators.trees import score_rows
from lexigrid.sources import files
from lexigrid.streaming import lines


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_script():
    assert to_roman("ᐃᓄᒃᑎᑐᑦ ᖃᔭᖅ ᖕ ᖐ") == "inuktitut qajaq ng ngii"
    assert long_signs()["ᐱ"] == "ᐲ"


@pytest.mark.parametrize(
    ("syllabic", "roman"),
    [("ᐃᓄᒃᑐᑦ, 2020", "inuktut, 2020"), ("ᐊᕐᕕᐊᕐᒦᖦᖢᑎᒃ", "arviarmii&&utik"), ("ᓄᓇᕗᑦ", "nunavut"), ("ᐃᖅᑭᖅ", "iqqiq"), ("ᐊᖓ ᐊᙱ", "anga anngi"), ("ᐆᒪ ᐋᖅ ᖃᐅ", "uuma aaq qau"), ("", "")],
)
def test_both_scripts(spark, syllabic, roman):
    assert one(spark, roman_column(F.col("t"), True), t=syllabic) == roman
    assert one(spark, syllabic_column(F.col("t")), t=roman) == syllabic


def test_finals_join_the_sign_after_them_and_aliases_are_known(spark):
    joined = {"ᐃᕐᑭᖅ": "iqiq", "ᐊᖕᒐ": "anga", "ᐃᕐᑎ": "irti", "ᕐᕿ": "rqi", "rki ᓄ": "rki nu"}
    for a, b in joined.items():
        assert one(spark, roman_column(F.col("t"), True), t=a) == b
    assert one(spark, syllabic_column(F.col("t")), t="subluit") == "ᓱᑉᓗᐃᑦ" and one(spark, syllabic_column(F.col("t")), t="irqi") == "ᐃᖅᑭ"


@pytest.mark.parametrize(("text", "wanted", "want"), [("ᐃᓄᒃᑐᑦ-1, inuktut-2", "roman", "inuktut-1, inuktut-2"), ("ᐃᓄᒃᑐᑦ-1, inuktut-2", "syllabic", "ᐃᓄᒃᑐᑦ-1, ᐃᓄᒃᑐᑦ-2"), ("inuk", "roman", "inuk")])
def test_in_script(spark, text, wanted, want):
    assert one(spark, in_script(F.col("t"), F.lit(wanted), X.script_of(F.col("t"))), t=text) == want


def test_roman_column_is_its_twin(spark):
    text = "".join(romans()) + " x 1"
    assert one(spark, roman_column(F.col("t")), t=text) == to_roman(text)


@pytest.mark.parametrize(("text", "word", "want"), [("one two three", "two", (4, 7)), ("One two", "one", (0, 3)), ("one", "x", None), ("one", " ", None)])
def test_highlight(spark, text, word, want):
    got = one(spark, X.highlight(F.col("t"), F.col("w")), t=text, w=word)
    assert (got and tuple(got)) == want


def test_text_functions(spark):
    assert one(spark, X.words(F.col("t")), t="A-b ᓄᓇ_1") == ["a", "b", "ᓄᓇ_1"]
    assert one(spark, X.date_of_source(F.col("t")), t="Hansard_19990401") == "19990401"
    assert one(spark, X.date_of_source(F.col("t")), t="mystery") == "mystery"
    assert [one(spark, X.script_of(F.col("t")), t=t) for t in ("ᓄᓇ", "nuna", "ᓄᓇna", "12")] == ["syllabic", "roman", "mixed", "none"]
    assert one(spark, X.unsimplified(X.simplified(F.col("t"))), t="nngangi") == "nngangi"
    assert one(spark, X.without_tags(F.col("t")), t="<b>a &lt; &amp;lt;</b>") == "a < &lt;"
    assert one(spark, X.last_section_bullets(F.col("t"), "## M"), t="## M\n- no\n## M\n\n- a\n* b\nend\n- c") == ["a", "b"]


def test_decompositions(spark):
    d = "{iglu:iglu/1n}{li:liuq/1nv}{mi:mi/tn-loc-s}"
    assert one(spark, D.keys(F.col("d")), d=d) == ["iglu/1n", "liuq/1nv", "mi/tn-loc-s"]
    assert one(spark, D.stem(D.keys(F.col("d"))), d=d) == ["iglu/1n", "liuq/1nv"]
    assert one(spark, D.of_analysis(D.analysis(F.col("d"))), d=d) == "{iglu/1n}{liuq/1nv}{mi/tn-loc-s}"
    assert tuple(one(spark, D.switches(D.part_column(F.col("d"), 3)), d=d)) == ("v", 1, 1)


def test_longest_prefix(spark):
    words = spark.createDataFrame([("abcde",), ("abc",), ("ab",), ("xyzw",)], ["word"])
    keys = spark.createDataFrame([("abcd",), ("abc",), ("ab",)], ["key"])
    assert [tuple(r) for r in longest_prefix(words, keys).collect()] == [("abcde", "abcd")]


def test_concordance_takes_the_first(spark):
    texts = spark.createDataFrame([(i, "Nuna nuna iglu") for i in range(30)] + [(99, None)], "id bigint, t string")
    index = word_index(texts, "id", "t")
    got = concordance(spark.createDataFrame([("nuna",), ("none",)], ["word"]), index, 20).collect()
    assert sorted(r["id"] for r in got) == list(range(20))


def test_numbered_equals_row_number(spark):
    rows = spark.range(500).select(F.expr("id % 3 * (id % 2)").alias("g"), F.expr("id * 7919 % 501").alias("o"))
    got = numbered(rows, "g", ["o"]).collect()
    for g in {r["g"] for r in got}:
        assert [r["pos"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"])] == list(range(1, sum(r["g"] == g for r in got) + 1))


@pytest.mark.parametrize(("text", "want"), [("", True), ("a:1", True), ("!a:1", False), ("a:2,b:x", False), ("a:2 b:x", True), ("!(a:2 b:x)", False), ("c:null", True), ("a:3 , b:x", False), ("a:Xd", True)])
def test_constraints(spark, text, want):
    rows = spark.createDataFrame([("1 5", "x", None, "5")], "a string, b string, c string, d string")
    assert rows.select(compiled(text, ["a", "b", "c", "d"]).alias("x")).first()["x"] is want


@pytest.mark.parametrize("text", ["a:", "z:1", "(a:1", "a:1)", "!", "a:1,,a:2"])
def test_bad_constraints(text, spark):
    with pytest.raises(ConditionError):
        compiled(text, ["a"])


def test_trees(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "k bigint, f double")
    got = {r["k"]: r["score"] for r in score_rows(rows, "k", ["f"], [{"feat": "f", "thr": 2, "left": 1.0, "right": -1.0}, 0.5], 0.1).collect()}
    assert got == pytest.approx({1: 0.15, 2: -0.05, 3: -0.05})


AFFIXES = [
    A.Affix("mi", "tn-loc-s", (A.Behaviour("mi"),)), A.Affix("mut", "tn-dat-s", (A.Behaviour("mut", "V"), A.Behaviour("mut", "C", "nasal"))), A.Affix("vik", "1vn", (A.Behaviour("vik", "V"), A.Behaviour("vik", "C", "drop"))),
    A.Affix("juq", "1vn", (A.Behaviour("juq", "V"), A.Behaviour("tuq", "C"))), A.Affix("suk", "2nn", (A.Behaviour("suk", "q", "voice", ""), A.Behaviour("suk", "V", "vdup"))), A.Affix("qaq", "1nv", (A.Behaviour("qaq", "t", "drop"), A.Behaviour("qaq", "V")), "type:n"),
]


@pytest.mark.parametrize(
    ("stem", "behaviour", "want"),
    [
        ("iglu", A.Behaviour("x", "V"), "iglu"), ("iglu", A.Behaviour("x", "t"), None), ("nanuq", A.Behaviour("x", "q", "drop"), "nanu"), ("nanuq", A.Behaviour("x", "C", "voice"), "nanur"),
        ("inuk", A.Behaviour("x", "k", "nasal"), "inuN"), ("ulu", A.Behaviour("x", "V", "vdup"), "uluu"), ("inuk", A.Behaviour("x", "", "gem"), "inukk"), ("iglu", A.Behaviour("x", "V", "ins(Na)"), "igluNa"),
        ("atiq", A.Behaviour("x", "q", "dropins(ra)"), "atira"), ("maniit", A.Behaviour("x", "t", "drop", "drop"), "mani"), ("maniit", A.Behaviour("x", "t", "drop", "ins(j)"), "maniij"), ("unnuat", A.Behaviour("x", "t", "drop", "drop(i)"), "unnua"),
        ("kamik", A.Behaviour("x", "k", "dropvdup"), "kamii"), ("iglu", A.Behaviour("x", "", "other"), None), ("aput", A.Behaviour("pa", "t", "assim"), "apup"),
    ],
)
def test_actions_and_their_inverse(stem, behaviour, want):
    assert A.acted(stem, behaviour) == want
    if want is not None:
        assert stem in A.stems_before(want, behaviour)


def test_search_finds_what_is_built_forwards():
    """Words are built from the root on along the graph, and every one must be read back."""
    roots = {"iglu": ["1n"], "nanuq": ["1n"], "tikit": ["1v"], "taku": ["1v"]}
    search, graph = A.Analyzer(AFFIXES), A.closed_arcs()

    def reads(parts):
        states = {"w"}
        for a in reversed(parts):
            states = {t for s in states for c, t in graph.get(s, ()) if A.holds(c, A.attributes(a.canonical, a.identifier))}
        return states

    n = 0
    for stem, ids in roots.items():
        todo = [(stem, [], "".join(f"{stem}/{ids[0]}"))]
        while todo:
            text, parts, _ = todo.pop()
            if any(t == "0" and A.holds(c, A.attributes(stem, ids[0])) for s in reads(parts) for c, t in graph.get(s, ())):
                want = [f"{stem}/{ids[0]}", *(f"{a.canonical}/{a.identifier}" for a in parts)]
                got = [[k.split(":")[1] for k in d.strip("{}").split("}{")] for d in search.first(text, roots)]
                assert want in got, (text, want, got)
                n += 1
            for a in AFFIXES if len(parts) < 3 else ():
                before = A.attributes(parts[-1].canonical, parts[-1].identifier) if parts else A.attributes(stem, ids[0])
                if parts and parts[-1] is a or not A.holds(a.before, before):
                    continue
                todo += [(shown + b.form, [*parts, a], "") for b in a.behaviours if (shown := A.acted(text, b)) is not None]
    assert n > 30


def test_search_stops_early_and_in_time():
    search = A.Analyzer(AFFIXES, A.ANY_ORDER)
    assert len(search.first("iglumi", {"iglumi": ["1n"], "iglu": ["1n"]})) == 2 and len(search.first("iglumi", {"iglumi": ["1n"], "iglu": ["1n"]}, 1)) == 1
    with pytest.raises(TimeoutError):
        search.first("iglumi", {}, seconds=-1)


def test_analyses_over_roots_of_any_number(spark):
    words = spark.createDataFrame([(f"rut{i}a{s}",) for i in (0, 2999) for s in ("", "mi", "x")] + [("nanurmi",), ("iglun",), (None,), ("",)], "word string")
    roots = spark.createDataFrame([(f"rut{i}a", "1n") for i in range(3000)] + [("nanuq", "1n"), ("iglut", "1n"), ("rut0aq", "1n")], "canonical string, identifier string")
    got = {r["word"]: r for r in A.analyses(words, roots, [*AFFIXES, A.Affix("mi", "1q", (A.Behaviour("mi", "q", "voice"),))], lenient=True).collect()}
    assert got["rut2999ami"]["decomps"] == ["{rut2999a:rut2999a/1n}{mi:mi/tn-loc-s}"] and got["rut2999ax"]["decomps"] == [] and len(got) == 8
    assert got["nanurmi"]["decomps"] == ["{nanur:nanuq/1n}{mi:mi/1q}"] and got["iglun"]["decomps"] == ["{iglut:iglut/1n}"]
    # A missing last consonant makes an analysis a lenient one, after the strict ones.
    assert got["rut0a"]["decomps"] == ["{rut0a:rut0a/1n}", "{rut0aq:rut0aq/1n}"] and got["rut0a"]["lenients"] == [False, True]
    late = A.analyses(words, roots, AFFIXES, seconds=-1).collect()
    assert {r["status"] for r in late} == {"timed_out"} and all(r["decomps"] == [] for r in late)


def test_composites_are_collapsed(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b", "c"]), (1, 2, ["a", "bc"]), (1, 3, ["x", "b", "c"]), (2, 4, ["a", "b", "c"]), (1, 5, ["b", "c", "b", "c"]), (1, 6, ["b", "c", "bc"])], "word_id bigint, cand_id bigint, keys array<string>")
    composites = spark.createDataFrame([("bc", ["b", "c"]), ("e", []), (None, None)], "id string, parts array<string>")
    assert {r["cand_id"] for r in A.collapsed(rows, composites).collect()} == {2, 3, 4, 6}
    assert A.collapsed(rows.limit(0), composites).count() == 0 and A.collapsed(rows, composites.limit(0)).count() == 6


def test_query_of_decompositions_keeps_all_roots(spark, tmp_path):
    from lexigrid.plans.morphology import r01_decompositions

    name = lambda i: "r" + "".join("bcdfghjklm"[int(x)] for x in str(i))
    cases = [(name(i), f"{{{name(i)}:{name(i)}/1n}}") for i in range(2300)]
    spark.createDataFrame(cases, "word string, all_correct_decomps string").write.parquet(f"{tmp_path}/analyzer_cases.parquet")
    got = r01_decompositions(spark, str(tmp_path)).collect()
    assert len(got) == 2300 and all(r["decomps"] == [f"{{{r['word']}:{r['word']}/1n}}"] for r in got)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('morpheme,type,meaning\na,n,"b, ""c"""\nd,,\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("a", "n", 'b, "c"'), ("d", None, None)]
    (tmp_path / "a.jsonl").write_text('{"a":1}\n{"a":2}\n{"a"')
    good, bad = files.read_json_lines(spark, str(tmp_path / "a.jsonl"), spark.createDataFrame([], "a int").schema)
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1
    (tmp_path / "d.json").write_text('[{"word":"a","meaning":"1"},{"word":"a","meaning":"2"}]')
    assert [tuple(r) for r in files.read_entries(spark, str(tmp_path / "d.json")).collect()] == [("a", "2")]
    for n, t in (("l", "a\n\nc\n"), ("r", "x\ny\nz\n"), ("i", "1\tq\n2\n3\n")):
        (tmp_path / n).write_text(t)
    got = files.read_aligned(spark, *(str(tmp_path / n) for n in "lri")).collect()
    assert sorted(map(tuple, got)) == [("1", "a", "x"), ("3", "c", "z")]


def test_index_and_resume(spark, tmp_path):
    index = spark.createDataFrame([("a", 1), ("b", 1)], "word string, id bigint")
    assert files.read_index(spark, str(tmp_path / "i"))[0] == "missing"
    files.write_index(index, str(tmp_path / "i"), "1")
    status, back = files.read_index(spark, str(tmp_path / "i"))
    assert status == "ready" and back.count() == 2
    done = str(tmp_path / "done")
    assert [files.append_missing(done, index, "word", "v1", lambda x: x.select("word")) for _ in range(2)] == [2, 0]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.txt").write_text("ᓄᓇ\n\n Iqkaluk \n")
    lines.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = lines.records(spark.read.text(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.read.schema(batch.schema).json(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
