import pytest

from lexigrid.operators.batches import bisected
from lexigrid.operators.transducer import lookups, read_transducer, write_transducer

# iglu and iglumi; mi costs one; a flag lets qa stand only after q was set.
ARCS = [
    (0, "i", "i", 1, 0.0), (1, "g", "g", 2, 0.0), (2, "l", "l", 3, 0.0), (3, "u", "u", 4, 0.0), (4, "", "+n", 5, 0.0), (5, "m", "+", 6, 0.5), (6, "i", "loc", 7, 0.5), (4, "", "+v", 7, 2.0),
    (0, "q", "q", 8, 0.0), (8, "@P.F.on@", "@P.F.on@", 9, 0.0), (8, "", "", 9, 0.0), (9, "a", "a", 10, 0.0), (10, "@R.F.on@", "@R.F.on@", 7, 0.0), (10, "@D.F.on@", "@D.F.on@", 11, 3.0), (1, "ng", "N", 7, 0.25), (2, "", "", 2, 0.1),
]
DATA = write_transducer(ARCS, {5: 0.0, 7: 0.0, 11: 1.0})


@pytest.mark.parametrize(
    ("word", "want"),
    [("iglu", [("iglu+n", 0.0), ("iglu+v", 2.0)]), ("iglumi", [("iglu+n+loc", 1.0)]), ("qa", [("qa", 0.0)]), ("ing", [("iN", 0.25)]), ("igl", []), ("xyz", []), ("", [])],
)
def test_lookup(word, want):
    got = read_transducer(DATA).lookup(word)
    assert [o for o, _ in got] == [o for o, _ in want] and [w for _, w in got] == pytest.approx([w for _, w in want])


def test_header_and_broken_files():
    header = b"HFST\0" + (9).to_bytes(2, "little") + b"\0" + b"version\0x"
    assert read_transducer(header + DATA).lookup("iglu", 1) == [("iglu+n", 0.0)]
    with pytest.raises(Exception):  # noqa: B017
        read_transducer(DATA[:-20])


def test_lookups(spark, tmp_path):
    (tmp_path / "t.hfstol").write_bytes(DATA)
    df = spark.createDataFrame([("iglu",), ("iglu",), ("igl",), ("ö",), ("",), (None,)], "word string")
    got = {r["word"]: (r["status"], r["outputs"]) for r in lookups(df, str(tmp_path / "t.hfstol")).collect()}
    assert got == {"iglu": ("found", ["iglu+n", "iglu+v"]), "igl": ("none", []), "ö": ("unreadable", [])}


def test_bisected(spark):
    def work(texts):
        if "bad" in texts:
            raise RuntimeError("crash")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i in (3, 77) else None if i == 5 else f"w{i}") for i in range(100)], "id bigint, t string")
    got = {r["id"]: (r["result"], r["error"]) for r in bisected(rows, "id", "t", work).collect()}
    assert len(got) == 100 and got[3] == got[77] == (None, "RuntimeError: crash") and got[5] == (None, None) and all(got[i] == (f"W{i}", None) for i in range(100) if i not in (3, 5, 77))
    assert bisected(rows.limit(0), "id", "t", work).count() == 0
