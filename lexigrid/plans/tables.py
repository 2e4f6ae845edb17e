"""Linguistic tables, gold cases, usage logs, constraints and tree scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexigrid.functions import text as X
from lexigrid.operators.constraints import compiled
from lexigrid.operators.trees import score_rows
from lexigrid.plans.registry import Registry
from lexigrid.session import cut, table

R = Registry()
_FLAGS = ("is_misspelled", "is_possibly_misspelled", "is_borrowed", "decomp_unknown", "is_proper_name")


@R.query("SELECT case_id, NOT (" + " OR ".join(f"coalesce(lower(trim({f})) = 'true', false)" for f in _FLAGS) + ") AS fair FROM analyzer_cases")
def flt02_fair_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows, unfair = table(spark, sf, "analyzer_cases"), F.lit(False)
    for f in _FLAGS:
        unfair = unfair | F.coalesce(F.lower(F.trim(f)) == "true", F.lit(False))
    return rows.select("case_id", (~unfair).alias("fair"))


@R.query("SELECT case_id, item FROM (SELECT case_id, trim(unnest(string_split(all_correct_decomps, ';'))) AS item FROM analyzer_cases) WHERE item <> ''")
def src04_correct_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "analyzer_cases").select("case_id", F.explode(F.split("all_correct_decomps", ";")).alias("item"))
    return rows.select("case_id", F.trim("item").alias("item")).where("item <> ''")


@R.query("SELECT source, CAST(count(*) AS BIGINT) AS cases, count(all_correct_decomps) AS with_list, count_if(contains(all_correct_decomps, decomp_as_found_in_source)) AS found_in_list FROM analyzer_cases GROUP BY source")
def src04_case_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = F.coalesce(F.col("all_correct_decomps").contains(F.col("decomp_as_found_in_source")), F.lit(False))
    return table(spark, sf, "analyzer_cases").groupBy("source").agg(F.count("*").alias("cases"), F.count("all_correct_decomps").alias("with_list"), F.sum(found.cast("long")).alias("found_in_list"))


_UNION = "SELECT 'locations' AS table_name, row_id, morpheme, type, nb, nature, number FROM locations UNION ALL SELECT 'undecomposable_composite_words', row_id, morpheme, type, nb, nature, number FROM undecomposable_composite_words UNION ALL SELECT 'roots_schneider', row_id, morpheme, type, nb, nature, number FROM roots_schneider"


def _bases(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in ("locations", "undecomposable_composite_words", "roots_schneider"):
        rows = table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", "morpheme", "type", "nb", "nature", "number")
        out = rows if out is None else out.unionByName(rows)
    return out


@R.query(_UNION)
def src02_multi_table_load(spark: SparkSession, sf: str) -> DataFrame:
    return _bases(spark, sf)


@R.query(f"SELECT id, arg_min(table_name, (k, row_id)) AS table_name, count(*) AS rows FROM (SELECT *, morpheme || '/' || coalesce(nb, '1') || type AS id, CASE table_name WHEN 'locations' THEN 1 WHEN 'roots_schneider' THEN 2 ELSE 3 END AS k FROM ({_UNION})) WHERE id IS NOT NULL GROUP BY id")
def j07_id_with_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Each morpheme id with the first table that has it, in a fixed priority."""
    k = F.when(F.col("table_name") == "locations", 1).when(F.col("table_name") == "roots_schneider", 2).otherwise(3)
    rows = _bases(spark, sf).withColumn("id", F.concat("morpheme", F.lit("/"), F.coalesce("nb", F.lit("1")), "type")).where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.min_by("table_name", F.struct(k, "row_id")).alias("table_name"), F.count("*").alias("rows"))


_COND = "type:n,!nb:2 nature:zoo"


@R.query(f"SELECT table_name, row_id, (coalesce(list_contains(string_split(type, ' '), 'n'), false) AND NOT coalesce(list_contains(string_split(nb, ' '), '2'), false)) OR coalesce(list_contains(string_split(nature, ' '), 'zoo'), false) AS holds FROM ({_UNION})")
def flt08_constraint(spark: SparkSession, sf: str) -> DataFrame:
    """A condition in the constraint language, compiled to a column: comma and, blank or, ! not, attr:val membership."""
    return _bases(spark, sf).select("table_name", "row_id", compiled(_COND, ("type", "nb", "nature", "number")).alias("holds"))


@R.query("SELECT cand_id, round(CAST(0.1 * ((CASE WHEN n_parts < 3 THEN 1.0 ELSE -0.5 END) + (CASE WHEN native_rank < 5 THEN (CASE WHEN n_parts < 4 THEN 2.0 ELSE 0.25 END) ELSE -1.0 END)) AS DOUBLE), 6) AS tree_score FROM candidates")
def m04_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees over two features, evaluated in batches: x < threshold goes left."""
    trees = [{"feat": "n_parts", "thr": 3, "left": 1.0, "right": -0.5}, {"feat": "native_rank", "thr": 5, "left": {"feat": "n_parts", "thr": 4, "left": 2.0, "right": 0.25}, "right": -1.0}]
    out = score_rows(table(spark, sf, "candidates").select("cand_id", "n_parts", "native_rank"), "cand_id", ["n_parts", "native_rank"], trees, 0.1)
    return out.select("cand_id", F.round("score", 6).alias("tree_score"))


@R.query("SELECT date_trunc('day', ts) AS day, event_type AS model, round(sum(value), 4) AS cost, count(*) AS calls FROM events GROUP BY ALL")
def a26_cost_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("model")).agg(F.round(F.sum("value"), 4).alias("cost"), F.count("*").alias("calls"))


@R.query("SELECT event_type AS model, round(sum(CASE WHEN date_trunc('day', ts) = date_trunc('day', m) THEN value ELSE 0 END), 4) AS today, round(sum(CASE WHEN date_trunc('week', ts) = date_trunc('week', m) THEN value ELSE 0 END), 4) AS week, round(sum(CASE WHEN date_trunc('month', ts) = date_trunc('month', m) THEN value ELSE 0 END), 4) AS month FROM events, (SELECT max(ts) AS m FROM events) GROUP BY event_type")
def a26_cost_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of each model today, in this week (from Monday) and in this month, seen from the last event."""
    rows = table(spark, sf, "events")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("m"))))
    part = lambda p: F.round(F.sum(F.when(F.date_trunc(p, "ts") == F.date_trunc(p, "m"), F.col("value")).otherwise(0)), 4)
    return rows.groupBy(F.col("event_type").alias("model")).agg(part("day").alias("today"), part("week").alias("week"), part("month").alias("month"))


@R.query("SELECT event_id, CAST(string_split(line, ':')[1] AS BIGINT) AS at_millis, string_split(line, ':')[3] AS model FROM (SELECT event_id, (epoch_us(ts) // 1000) || ':' || CAST(event_id AS VARCHAR) || ':' || event_type AS line FROM events)")
def m20_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A log line written and parsed again: millis:cost:model, split into three parts at most."""
    line = F.concat_ws(":", F.unix_millis(F.to_timestamp("ts")).cast("string"), F.col("event_id").cast("string"), "event_type")
    rows = table(spark, sf, "events").select("event_id", F.split(line, ":", 3).alias("p"))
    return rows.select("event_id", F.expr("try_cast(p[0] AS BIGINT)").alias("at_millis"), F.expr("p[2]").alias("model"))


@R.query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def m21_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@R.query("SELECT doc_id, regexp_extract_all(text, 'Candidate ([0-9]+)', 1) AS numbers, coalesce(nullif(regexp_extract(text, 'Kept: ([^\\n]*)', 1), ''), 'none') AS kept FROM documents WHERE source = 'analysis_notes' AND text IS NOT NULL")
def x23_note_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source = 'analysis_notes' AND text IS NOT NULL")
    kept = F.coalesce(F.nullif(F.regexp_extract("text", "Kept: ([^\n]*)", 1), F.lit("")), F.lit("none"))
    return rows.select("doc_id", F.regexp_extract_all("text", F.lit("Candidate ([0-9]+)"), F.lit(1)).alias("numbers"), kept.alias("kept"))


_GLOSS = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE source = 'glossary'"


@R.query(rf"SELECT doc_id, m[1] AS word, m[2] AS syllabic, m[3] AS meaning FROM (SELECT doc_id, [regexp_extract(l, '^([^ (]+) \(([^)]*)\) – (.*)$', 1), regexp_extract(l, '^([^ (]+) \(([^)]*)\) – (.*)$', 2), regexp_extract(l, '^([^ (]+) \(([^)]*)\) – (.*)$', 3)] AS m FROM ({_GLOSS})) WHERE m[1] <> ''")
def src24_glossary_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the glossary texts: word, its syllabic spelling and the meaning."""
    rows = table(spark, sf, "documents").where("source = 'glossary'").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    part = lambda i: F.regexp_extract("l", r"^([^ (]+) \(([^)]*)\) – (.*)$", i)
    return rows.select("doc_id", part(1).alias("word"), part(2).alias("syllabic"), part(3).alias("meaning")).where("word <> ''")


@R.query("SELECT id, html, trim(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&amp;', '&')) AS bare FROM (SELECT id, '<td><b>' || replace(replace(english, '&', '&amp;'), '<', '&lt;') || '</b></td>' AS html FROM pairs WHERE english IS NOT NULL)")
def x09_tags_and_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pairs").where("english IS NOT NULL")
    html = F.concat(F.lit("<td><b>"), F.replace(F.replace("english", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</b></td>"))
    return rows.select("id", html.alias("html"), X.without_tags(html).alias("bare"))


@R.query("""
WITH RECURSIVE seg(id, w, rest, parts) AS (
  SELECT case_id, lower(word), lower(word), 0 FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+'
  UNION ALL
  SELECT id, w, rest[1:len(rest) - len(suf)], parts + 1 FROM seg, (VALUES ('mi'), ('mut'), ('punuk'), ('nuni'), ('vut'), ('put')) s(suf) WHERE ends_with(rest, suf) AND len(rest) > len(suf) + 2
) SELECT id AS case_id, max(parts) AS suffixes, min(len(rest)) AS shortest_stem FROM seg GROUP BY id""")
def r04_suffix_peeling(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive splitting from the right over a small set of endings: a frontier is expanded until no ending fits, one join a round; rounds are bounded by
    the length of the words.
    """
    endings = F.broadcast(spark.createDataFrame([(e,) for e in ("mi", "mut", "punuk", "nuni", "vut", "put")], "suf string"))
    seen = last = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]+$")).select("case_id", F.lower("word").alias("rest"), F.lit(0).alias("parts"))
    while not last.isEmpty():
        fits = F.endswith("rest", "suf") & (F.length("rest") > F.length("suf") + 2)
        last = cut(last.join(endings, fits).select("case_id", F.expr("substring(rest, 1, length(rest) - length(suf))").alias("rest"), (F.col("parts") + 1).alias("parts")).distinct())
        seen = seen.unionByName(last)
    return seen.groupBy("case_id").agg(F.max("parts").alias("suffixes"), F.min(F.length("rest")).alias("shortest_stem"))
