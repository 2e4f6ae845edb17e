import gzip
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from lexigrid.operators import analyzer as A
from lexigrid.functions.text import quoted_tokens
from lexigrid.operators.ask import Reply, ask, next_turn
from lexigrid.operators.lookup import answered
from lexigrid.sources import files
from lexigrid.streaming import lines


def test_json_lines_end_at_the_first_bad_one(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "ᓄ"}\n\n{"a": 2}\n{"a": 3, "b\n{"a": 4}\n')
    schema = StructType().add("a", LongType()).add("b", StringType())
    assert sorted(tuple(r) for r in files.read_json_lines_to_the_first_bad(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [(1, "ᓄ"), (2, None)]
    df = spark.createDataFrame([(1, "ᓄ"), (2, None)], "a bigint, b string")
    files.write_json_lines(df, str(tmp_path / "out"))
    assert sorted(x for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()) == ['{"a":1,"b":"ᓄ"}', '{"a":2,"b":null}']


def test_tables_of_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"'), (2, "c")], "n int, w string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert sorted(x for p in (tmp_path / "t").glob("*.csv") for x in p.read_text().splitlines()) == ['1\ta "b"', "2\tc"]
    (tmp_path / "w.txt").write_text(" one \n\n two\nthree\n")
    assert [r["word"] for r in files.read_word_list(spark, str(tmp_path / "w.txt"), 2).orderBy("line_no").collect()] == ["one", "two"]
    (tmp_path / "s.txt").write_text("ᓄᓇ\niglu\nᐃᕐᑭ\n")
    assert [r["roman"] for r in files.transcoded_lines(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()] == ["nuna", "iglu", "iqi"]


def test_published_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("x\ny\n")
    assert files.unpacked(spark, str(tmp_path / "a.txt.gz"), str(tmp_path / "plain")) == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert files.wrong_digests(spark, str(tmp_path / "d"), {"x.bin": good.upper()}) == []
    assert files.wrong_digests(spark, str(tmp_path / "d"), {"x.bin": "0", "y.bin": good}) == ["x.bin", "y.bin"]


def test_replaced_table_may_be_read_while_it_is_written(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3).toDF("id"), path)
    old = files.read_table(spark, path)
    files.replace_table(old.selectExpr("id + 10 AS id").where("id > 10"), path)
    assert sorted(r["id"] for r in files.read_table(spark, path).collect()) == [11, 12] and old.count() == 3


def test_corpus_tables(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "Nuna nuna iglu", "a"), (2, "iglu", "b"), (3, None, "c")], "id bigint, inuktitut string, english string")
    files.write_corpus(pairs, str(tmp_path), "v1")
    words = {r["word"]: r["id"] for r in spark.read.parquet(str(tmp_path / "words")).collect()}
    assert words == {"iglu": 1, "nuna": 2}
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "word_index")).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert {r["key"]: r["value"] for r in spark.read.json(str(tmp_path / "meta")).collect()}["pair_count"] == "3"


def test_reports_and_scans(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, w string")
    assert files.markdown(df, "T").splitlines() == ["# T", "", "| n | w |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]
    source = """
        add("one", "{one:one/1n}") // add("no", "x")
        /* add("no") */ add("two (x)", other(1, ")"), "b").misspelled().note("(")
        add( "one", "{second}" ).borrowed() ; added("no")
    """
    assert files.called_cases(source, "add") == [(["two (x)", ")", "b"], ["misspelled", "note"]), (["one", "{second}"], ["borrowed"])]
    records = spark.createDataFrame([("a&b", "a&b/1n", "N"), (None, "x", "N"), ("", "x", "N")], "morpheme string, id string, state string")
    assert [r["value"] for r in files.lexicon_lines(records).collect()] == ["a&b/1n:a%&b N ;"]


AFFIXES = [A.Affix("mi", "tn-loc-s", (A.Behaviour("mi"),))]


@pytest.mark.parametrize("lenient", [True, None])
def test_analyzing_pipeline_as_batch_and_stream(spark, tmp_path, lenient):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("iglumi\n\n  ᐃᒡᓗᒥ \nxx\n")
    make = lambda df: lines.analyzed(df, {"iglu": ["1n"]}, AFFIXES, lenient)
    want = [("iglumi", ["{iglu:iglu/1n}{mi:mi/tn-loc-s}"]), ("xx", []), ("ᐃᒡᓗᒥ", ["{iglu:iglu/1n}{mi:mi/tn-loc-s}"])]
    batch = make(spark.read.text(str(tmp_path / "in")))
    assert ("decompositionsLenient" in batch.columns) is (lenient is not None)
    assert sorted((r["word"], r["decompositions"]) for r in batch.collect()) == want
    lines.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), make).awaitTermination(60)
    got = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((r["word"], r["decompositions"]) for r in got) == want and not any(r["timedOut"] for r in got)
    late = lines.analyzed(spark.read.text(str(tmp_path / "in")), {}, AFFIXES, seconds=-1).collect()
    assert all(r["timedOut"] and r["exception"] and r["decompositions"] == [] for r in late)


def test_snapshots_and_progress(spark, tmp_path):
    progress = lines.Progress()
    spark.streams.addListener(progress)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"word": "a", "kind": "dictionary", "n": 2}\n{"word": "b", "kind": "corpus", "n": 0}\n')
    (tmp_path / "in" / "b.json").write_text('{"word": "a", "kind": "corpus", "n": 5}\n')
    stream = spark.readStream.schema("word string, kind string, n bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = lines.snapshots(stream).writeStream.outputMode("update").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [tuple(r) for r in spark.table("seen").collect()]
    assert ("a", 2, 5, True) in rows and ("b", 0, 0, False) in rows
    for _ in range(100):
        if str(query.id) in progress.ended:
            break
        time.sleep(0.1)
    assert progress.rows[str(query.id)] == 3
    spark.streams.removeListener(progress)


def test_asking_a_service(spark):
    def client():
        def answer(p):
            if p == "boom":
                raise ValueError("no net")
            return Reply("unauthorized", message="key") if p == "stop" else Reply("ok", p.upper(), len(p), 1)

        return answer

    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None), (4, "stop"), (5, "b")], "id bigint, p string").coalesce(1)
    got = {r["id"]: (r["status"], r["text"], r["message"]) for r in ask(df, "id", "p", client).collect()}
    assert got == {1: ("ok", "A", None), 2: ("failed", None, "no net"), 3: ("failed", None, "no prompt"), 4: ("unauthorized", None, "key"), 5: ("unauthorized", None, "key")}
    assert ask(df.limit(0), "id", "p", client).count() == 0
    turns, reply = next_turn([("user", "x")], "y", client())
    assert reply.status == "ok" and turns[-1] == ("assistant", "USER: X\nUSER: Y")
    assert next_turn([], "boom", lambda p: client()("boom"))[0] == []


def test_many_tables_and_clashing_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("morpheme,nb,type\nx,1,n\ny,,n\n")
    (tmp_path / "b.csv").write_text("morpheme,type,extra\nz,v,e\n")
    paths = {n: str(tmp_path / f"{n}.csv") for n in "ab"}
    rows = files.load_tables(spark, paths, "concat(morpheme, '/', coalesce(nb, '1'), type)")
    assert sorted((r["id"], r["table_name"], r["extra"]) for r in rows.collect()) == [("x/1n", "a", None), ("y/1n", "a", None), ("z/1v", "b", "e")]
    (tmp_path / "b.csv").write_text("morpheme,type,extra\nx,n,e\n")
    with pytest.raises(ValueError, match="x/1n stands in a and b"):
        files.load_tables(spark, paths, "concat(morpheme, '/', coalesce(nb, '1'), type)")


def test_gold_table(spark, tmp_path):
    (tmp_path / "g.csv").write_text('word,is_misspelled,is_borrowed,all_correct_decomps\na,TRUE,no,"{a:b/1n};; {c:d/1v}"\n\n"x\ny",,False,\n')
    got = [(r["word"], r["is_misspelled"], r["is_borrowed"], r["all_correct_decomps"]) for r in files.read_gold(spark, str(tmp_path / "g.csv")).collect()]
    assert got == [("a", True, False, ["{a:b/1n}", "{c:d/1v}"]), ("x\ny", False, False, [])]


def test_answers_of_an_index(spark):
    words = spark.createDataFrame([("nuna",), ("nunavut",), ("xyz",), (None,), ("",)], "word string")
    index = spark.createDataFrame([("nuna", i) for i in range(30)] + [("nun", 99)], "word string, id bigint")
    got = {r["word"]: (r["status"], r["entry"], r["ids"]) for r in answered(words, "ready", index, 3).collect()}
    assert got == {"nuna": ("found", "nuna", [0, 1, 2]), "nunavut": ("found_for_shorter", "nuna", [0, 1, 2]), "xyz": ("not_found", None, [])}
    assert {(r["status"], tuple(r["ids"])) for r in answered(words, "mismatch", None).collect()} == {("mismatch", ())}


def test_quoted_tokens(spark):
    rows = spark.createDataFrame([('a;"b;c" d;;e',), ("",), (None,)], "t string")
    assert [r["x"] for r in rows.select(quoted_tokens(F.col("t"), ";").alias("x")).collect()] == [["a", '"b;c" d', "e"], [], None]
