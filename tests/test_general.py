import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.operators.multivalue import PACKED_FIELDS, FieldSpec, Segmenter, split_values
from lexigrid.operators.recover import NOUN_ENDING_FIELDS, Fault, noun_endings, parse_file, parse_files, parse_line, recovered

VARIANT, COMBINATION, SOURCE, CF = PACKED_FIELDS


@pytest.mark.parametrize(
    ("spec", "text", "want"),
    [
        (VARIANT, "a b,c;d|e/f\ng\th", list("abcdefgh")),
        (VARIANT, '"kuqu ""ujungak""" x', ['kuqu "ujungak"', "x"]),
        (VARIANT, "“Minim / siti” , a-b , «x; y»", ["Minim / siti", "a-b", "x; y"]),
        (VARIANT, "saqu'juluk; 'Ruvik, arav'", ["saqu'juluk", "Ruvik, arav"]),
        (VARIANT, "'suv'is gipi'/b", ["suv'is gipi", "b"]),
        (VARIANT, "open \"quote", ["open", '"quote']),
        (VARIANT, ",,; ", []),
        (VARIANT, '""', []),
        (COMBINATION, "{rima/1v}{?}", ["rima/1v", "?"]),
        (COMBINATION, "a/1n++#dup#/1vv + «suk/2nn»+\"vaqiq+ma/1v\"", ["a/1n", "#dup#/1vv", "suk/2nn", "vaqiq+ma/1v"]),
        (SOURCE, "N2 & V3:246/\"K2, p. 4\"", ["N2", "V3:246", "K2, p. 4"]),
        (CF, "na/tn-gen-d\ngija/1nn; 'pa, ma/1v'", ["na/tn-gen-d", "gija/1nn", "pa, ma/1v"]),
    ],
)
def test_values_of_a_field(spec, text, want):
    assert Segmenter(spec, ["abc/1v"]).split(text) == want


def test_known_value_protects_its_delimiter():
    assert Segmenter(VARIANT, ["a/b"]).split("a/b c/d") == ["a/b", "c", "d"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab ,;'\"“”/", max_size=30))
def test_values_are_pieces_of_the_text(text):
    for v in Segmenter(VARIANT, ["a", "ab"]).split(text):
        assert v and v.replace('"', "") in text.replace('"', "")


IDS = FieldSpec("t", "row_id", "f", ",;", "", "/", r"[^\s/]+/[a-z0-9]+")
PLACES = FieldSpec("t", "row_id", "f", ",;", quoted=True)


def _values(rows, spec, **more):
    return sorted((r["row_id"], r["pos"], r["val"]) for r in split_values(rows, spec, **more).collect())


def test_the_dictionary_decides_and_both_ways_of_it_agree(spark):
    rows = spark.createDataFrame([(1, "ab/1v"), (2, "cd/2n; ab/1v"), (3, "ab/1v/cd/2n"), (4, "ab/1v/xx"), (5, "x/y/z")], "row_id bigint, f string")
    want = [(1, 1, "ab/1v"), (2, 1, "cd/2n"), (2, 2, "ab/1v"), (3, 1, "ab/1v"), (3, 2, "cd/2n"), (4, 1, "ab/1v/xx"), (5, 1, "x/y/z")]
    assert _values(rows, IDS) == want == _values(rows, IDS, most_bytes=0)
    # Without the rows that vouch for the values the slashes separate nothing.
    assert _values(rows.where("row_id = 3"), IDS) == [(3, 1, "ab/1v/cd/2n")]
    # What stands in quotes somewhere keeps its blank and its comma elsewhere.
    rows = spark.createDataFrame([(1, '"Upper Bay, north"'), (2, "x, Upper Bay, north; y"), (3, "Upper Bay")], "row_id bigint, f string")
    want = [(1, 1, "Upper Bay, north"), (2, 1, "x"), (2, 2, "Upper Bay, north"), (2, 3, "y"), (3, 1, "Upper"), (3, 2, "Bay")]
    assert _values(rows, PLACES) == want == _values(rows, PLACES, most_bytes=0)


def test_more_known_values_than_a_broadcast_takes(spark):
    rows = spark.range(30_000).selectExpr("id AS row_id", "IF(id % 2 = 0, concat('v', id, '/1n'), concat('v', id - 1, '/1n/v', id - 1, '/1n')) AS f")
    for size in (1 << 30, 1000):
        assert split_values(rows, IDS, most_bytes=size).count() == 45_000


def test_split_values_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n", None), (4, "a a", "x"), (4, "a a", "x"), (5, "b," * 20000, None)], "row_id bigint, variant string, val string")
    got = split_values(rows, VARIANT).collect()
    assert sorted((r.row_id, r.pos, r.val) for r in got if r.row_id == 4) == [(4, 1, "a"), (4, 1, "a"), (4, 2, "a"), (4, 2, "a")]
    assert sum(r.row_id == 5 for r in got) == 20000 and {r.row_id for r in got} == {4, 5}
    assert split_values(rows.limit(0), VARIANT).count() == 0


def test_line_grammar():
    assert parse_line('a,"b ""c"", d",', 3) == ["a", 'b "c", d', ""]
    assert parse_line("", 1) == [""]
    assert parse_line("a,b", 3) == Fault("columns", 3)
    assert parse_line('a,"b', 2) == Fault("quoting", 2)
    assert parse_line('a,"b"x', 2).reason == "quoting"
    assert parse_line('a,b"x', 2) == Fault("quoting", 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab ",', max_size=6), min_size=1, max_size=5))
def test_line_round_trip(fields):
    assert parse_line(",".join('"' + f.replace('"', '""') + '"' for f in fields), len(fields)) == fields


def test_file_recovers_at_the_next_good_line():
    text = 'a,b\n"c\nd",e\n"broken,f\ng,h\ni\nj,k\n'
    records, faults = parse_file(text, 2)
    assert [f for _, f in records] == [["a", "b"], ["c\nd", "e"], ["g", "h"], ["j", "k"]]
    assert [f.reason for _, f in faults] == ["quoting", "columns"]


def test_parse_files_with_lines_inside_of_quotes_and_broken_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"c\nd",e\n"f,g\nh,i\nx\n\n"j ""k""",l\n\n')
    (tmp_path / "b.csv").write_text("")
    got = [(r["line"], r["x"], r["y"], r["reason"]) for r in parse_files(spark, str(tmp_path), ["x", "y"]).orderBy("line").collect()]
    assert got == [(1, "a", "b", None), (2, "c\nd", "e", None), (4, None, None, "quoting"), (5, "h", "i", None), (6, None, None, "columns"), (8, 'j "k"', "l", None)]


def test_recovery_takes_time_in_proportion_to_the_text():
    # A quote that is never closed, and no valid record after it.
    lines = ["a,b"] * 1000 + ['"x,y'] + ["z"] * 300_000 + ["c,d"]
    got = list(recovered(lines, 2, most_lines=1_000_000))
    assert [n for n, r in got if isinstance(r, list)] == [*range(1000), 301_001] and len(got) == 1002
    assert len(list(recovered(['"x,"'] * 20_000, 2))) <= 20_000


@pytest.mark.parametrize("most", [8 << 20, 0])
def test_action_codes_of_any_number(spark, most):
    rows = spark.createDataFrame([(i, _line(**{"V-form": "mut", "V-action1": f"a{i}", "condPrec": "" if i % 3 else "!"})) for i in range(12_000)], "line_id bigint, line string")
    actions = spark.range(11_000).selectExpr("concat('a', id) AS code")
    got = {r["reason"]: r["n"] for r in noun_endings(rows, actions, most).groupBy("reason").count().withColumnRenamed("count", "n").collect()}
    assert got == {None: 7333, "condprec": 3667, "v-action1": 1000}


def _line(**changed):
    fields = dict.fromkeys(NOUN_ENDING_FIELDS, "x") | {"V-form": "mut -", "V-action1": "keep drop", "condPrec": ""} | changed
    return ",".join(f'"{v}"' if "," in v else v for v in fields.values())


def test_noun_endings(spark):
    lines = {
        1: _line(), 2: _line(**{"condPrec": "pl:t,!nb:1"}), 3: _line(**{"V-form": "Mut -"}), 4: _line(**{"V-action1": "keep"}), 5: _line(**{"condPrec": "pl:t, nb:1"}),
        6: "a,b", 7: 'a,"b', 8: None, 9: "", 10: _line(**{"V-form": " mut - "}), 11: _line(**{"V-form": "mut  -"}), 12: _line(**{"V-action1": "keep drops"}),
    }
    rows = spark.createDataFrame([(k, v, "r") for k, v in lines.items()], "line_id bigint, line string, reason string")
    actions = spark.createDataFrame([("keep",), ("drop",), (None,)], "code string")
    got = {r["line_id"]: r["reason"] for r in noun_endings(rows, actions).collect()}
    assert got == {1: None, 2: None, 3: "v-form", 4: "v-action1", 5: "condprec", 6: "columns", 7: "quoting", 8: "columns", 9: "columns", 10: None, 11: "v-form", 12: "v-action1"}
    assert noun_endings(rows.limit(0), actions).count() == 0
