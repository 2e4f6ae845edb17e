"""Decompositions: parsing, stems, ranking, re-ranking features and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexigrid.functions import decomp as D
from lexigrid.operators.ranks import numbered
from lexigrid.plans.registry import Registry
from lexigrid.session import table

R = Registry()
_RE = r"\{([^:{}]*):([^/{}]*)/([^{}]*)\}"
_KEYS = f"list_transform(list_zip(regexp_extract_all(decomp, '{_RE}', 2), regexp_extract_all(decomp, '{_RE}', 3)), lambda p: p[1] || '/' || p[2])"
_IDS = f"regexp_extract_all(decomp, '{_RE}', 3)"
_C = "SELECT * FROM candidates WHERE decomp IS NOT NULL"


def _c(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "candidates").where("decomp IS NOT NULL")


@R.query(f"SELECT cand_id, pos, s AS surface, c AS canonical, i AS id FROM (SELECT cand_id, unnest(regexp_extract_all(decomp, '{_RE}', 1)) AS s, unnest(regexp_extract_all(decomp, '{_RE}', 2)) AS c, unnest({_IDS}) AS i, unnest(range(1, len({_IDS}) + 1)) AS pos FROM ({_C}))")
def x06_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _c(spark, sf).select("cand_id", F.posexplode(D.parts(F.col("decomp"))).alias("p", "x"))
    return rows.select("cand_id", (F.col("p") + 1).cast("long").alias("pos"), "x.surface", "x.canonical", "x.id")


@R.query(f"SELECT cand_id, a AS analysis, '{{' || replace(replace(a, '++', '}}{{'), '+', '/') || '}}' AS rendered FROM (SELECT cand_id, array_to_string(list_transform({_KEYS}, lambda x: replace(x, '/', '+')), '++') AS a FROM ({_C}))")
def x07_analysis_text(spark: SparkSession, sf: str) -> DataFrame:
    a = D.analysis(F.col("decomp"))
    return _c(spark, sf).select("cand_id", a.alias("analysis")).select("cand_id", "analysis", D.of_analysis(F.col("analysis")).alias("rendered"))


@R.query(r"SELECT case_id, array_to_string(regexp_extract_all(decomp_as_found_in_source, '\{([^:{}]*):([^/{}]*)/([^{}]*)\}', 1), '') AS surface, coalesce(array_to_string(regexp_extract_all(decomp_as_found_in_source, '\{([^:{}]*):([^/{}]*)/([^{}]*)\}', 1), '') = lower(word), false) AS rebuilds, regexp_replace(decomp_as_found_in_source, '\{[^:{}]+:', '{', 'g') AS bare FROM analyzer_cases WHERE decomp_as_found_in_source IS NOT NULL")
def x14_surfaces_rebuild_word(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("decomp_as_found_in_source")
    rows = table(spark, sf, "analyzer_cases").where(d.isNotNull())
    return rows.select("case_id", D.surface(d).alias("surface"), F.coalesce(D.surface(d) == F.lower("word"), F.lit(False)).alias("rebuilds"), D.without_surfaces(d).alias("bare"))


_STEM = "list_slice(k, 1, coalesce(list_position(list_transform(k, lambda x: regexp_matches(split_part(x, '/', 2), '^t[nv]-')), true) - 1, len(k) - coalesce(list_position(list_transform(list_reverse(k), lambda x: NOT regexp_matches(split_part(x, '/', 2), '^[0-9]+q$')), true) - 1, len(k))))"


@R.query(f"SELECT array_to_string({_STEM}, ' ') AS stem, count(*) AS n, count(DISTINCT word_id) AS words FROM (SELECT word_id, {_KEYS} AS k FROM ({_C})) GROUP BY 1")
def x28_stems(spark: SparkSession, sf: str) -> DataFrame:
    rows = _c(spark, sf).select("word_id", F.array_join(D.stem(D.keys(F.col("decomp"))), " ").alias("stem"))
    return rows.groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("words"))


@R.query(f"SELECT i AS id, CASE WHEN regexp_matches(i, '^t[nv]-') THEN 'ending' WHEN regexp_matches(i, '^[0-9]+[nv][nv]$') THEN 'deriv' WHEN regexp_matches(i, '^[0-9]+[a-z]+$') THEN 'root' ELSE 'other' END AS category, CASE WHEN regexp_matches(i, '^[0-9]+[nv][nv]$') THEN i[-2] WHEN regexp_matches(i, '^t[nv]-') THEN i[2] END AS attaches_to, CASE WHEN regexp_matches(i, '^[0-9]+[nv]+$') THEN i[-1] END AS results_in, regexp_matches(i, '^t[nv]-|^[0-9]+q$') AS may_end_word, count(*) AS n FROM (SELECT unnest({_IDS}) AS i FROM ({_C})) GROUP BY i")
def x32_categories(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    rows = _c(spark, sf).select(F.explode(D.part_column(F.col("decomp"), 3)).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    attaches = F.when(i.rlike("^[0-9]+[nv][nv]$"), F.substring(i, -2, 1)).when(i.rlike(D.ENDING), F.substring(i, 2, 1))
    return rows.select("id", D.category(i).alias("category"), attaches.alias("attaches_to"), F.when(i.rlike("^[0-9]+[nv]+$"), F.substring(i, -1, 1)).alias("results_in"), i.rlike("^t[nv]-|^[0-9]+q$").alias("may_end_word"), "n")


_FIRST = f"SELECT word_id, decomp, {_KEYS} AS k FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY native_rank, cand_id) AS r FROM ({_C})) WHERE r = 1"
_AFFIX = "CASE WHEN split_part(x, '/', 2) LIKE '%-%' THEN split_part(x, '/', 2) ELSE x END"


def _affixes(k: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), D.affix_key))


def _first(spark: SparkSession, sf: str) -> DataFrame:
    """The first analysis of each word with its affix keys; the least of a word is found before the shuffle."""
    rows = _c(spark, sf).groupBy("word_id").agg(F.min_by("decomp", F.struct("native_rank", "cand_id")).alias("decomp"))
    return rows.withColumn("k", D.keys(F.col("decomp"))).withColumn("affixes", _affixes(F.col("k")))


_AFF = f"SELECT word_id, list_distinct(list_transform(k[2:], lambda x: {_AFFIX})) AS affixes FROM ({_FIRST})"


@R.query(f"SELECT a AS affix, count(*) AS words FROM (SELECT unnest(affixes) AS a FROM ({_AFF})) GROUP BY a")
def a04_affix_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _first(spark, sf).select(F.explode("affixes").alias("affix")).groupBy("affix").agg(F.count("*").alias("words"))


@R.query(f"SELECT k[i] AS a, k[i + 1] AS b, count(*) AS n FROM (SELECT k, unnest(range(1, len(k))) AS i FROM ({_FIRST})) GROUP BY ALL")
def a05_affix_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    rows = _first(spark, sf).where(F.size("k") > 1).select(F.explode(F.expr("transform(sequence(0, size(k) - 2), i -> named_struct('a', k[i], 'b', k[i + 1]))")).alias("x"))
    return rows.select("x.a", "x.b").groupBy("a", "b").agg(F.count("*").alias("n"))


@R.query(f"""
WITH f AS ({_AFF}), n AS (SELECT a, row_number() OVER (ORDER BY count(*) DESC, a) AS rank FROM (SELECT unnest(affixes) AS a FROM f) GROUP BY a),
w AS (SELECT word_id, max(rank) AS needs FROM (SELECT word_id, unnest(affixes) AS a FROM f) JOIN n USING (a) GROUP BY word_id)
SELECT n.rank, n.a AS affix, count(w.word_id) AS unlocked, CAST(sum(count(w.word_id)) OVER (ORDER BY n.rank) AS BIGINT) AS covered FROM n LEFT JOIN w ON w.needs = n.rank GROUP BY n.rank, n.a""")
def a07_coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    """By how many words coverage grows when affixes are added by frequency: a word counts at the rank of its rarest affix."""
    words = _first(spark, sf).select("word_id", F.explode("affixes").alias("affix"))
    ranks = words.groupBy("affix").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "affix"))).drop("n")
    needs = words.join(ranks, "affix").groupBy("word_id").agg(F.max("rank").alias("rank")).groupBy("rank").agg(F.count("*").alias("unlocked"))
    out = ranks.join(needs, "rank", "left").withColumn("unlocked", F.coalesce("unlocked", F.lit(0)))
    return out.select("rank", "affix", "unlocked", F.sum("unlocked").over(W.orderBy("rank")).alias("covered"))


@R.query(f"""
WITH f AS ({_AFF}), top AS (SELECT a FROM (SELECT a, row_number() OVER (ORDER BY count(*) DESC, a) AS rank FROM (SELECT unnest(affixes) AS a FROM f) GROUP BY a) WHERE rank <= 10),
c AS (SELECT word_id, native_rank, cand_id, list_filter(list_distinct(list_transform(k[2:], lambda x: {_AFFIX})), lambda x: NOT list_contains(l, x)) AS missing FROM (SELECT *, {_KEYS} AS k FROM ({_C})), (SELECT list(a) AS l FROM top)),
least AS (SELECT word_id, arg_min(missing, (len(missing), native_rank, cand_id)) AS missing FROM c GROUP BY word_id)
SELECT missing[1] AS affix, count(*) AS words FROM least WHERE len(missing) = 1 GROUP BY 1""")
def a08_next_affix(spark: SparkSession, sf: str) -> DataFrame:
    """Words that lack one affix alone when the ten most frequent of the first analyses are supported, by that affix. Of all analyses
    of a word the one with the fewest missing affixes counts, the first of equals.
    """
    words = _first(spark, sf).select(F.explode("affixes").alias("affix"))
    top = words.groupBy("affix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "affix").limit(10).agg(F.collect_list("affix").alias("top"))
    rows = _c(spark, sf).select("word_id", "native_rank", "cand_id", _affixes(D.keys(F.col("decomp"))).alias("affixes"))
    missing = rows.crossJoin(F.broadcast(top)).withColumn("missing", F.array_except("affixes", "top"))
    least = missing.groupBy("word_id").agg(F.min_by("missing", F.struct(F.size("missing"), "native_rank", "cand_id")).alias("missing"))
    return least.where(F.size("missing") == 1).groupBy(F.get("missing", F.lit(0)).alias("affix")).agg(F.count("*").alias("words"))


@R.query(f"SELECT x AS key, count(*) AS n FROM (SELECT unnest(k) AS x FROM ({_FIRST})) GROUP BY x")
def a09_morpheme_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _first(spark, sf).select(F.explode("k").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@R.query(f"""SELECT cand_id, row_number() OVER (PARTITION BY word_id ORDER BY weight, rootlen DESC, nparts, prior DESC, decomp, cand_id) AS pos FROM (
SELECT c.*, len(k[1]) - len(split_part(k[1], '/', 2)) - 1 AS rootlen, len(k) - 1 AS nparts, coalesce(p.s, 0) AS prior FROM (SELECT *, {_KEYS} AS k FROM ({_C})) c
LEFT JOIN (SELECT cand_id, sum(n) AS s FROM (SELECT cand_id, unnest({_KEYS}) AS x FROM ({_C})) JOIN (SELECT x, count(*) AS n FROM (SELECT unnest(k) AS x FROM ({_FIRST})) GROUP BY x) USING (x) GROUP BY cand_id) p ON p.cand_id = c.cand_id)""")
def o01_five_key_order(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each analysis: weight, longer root, fewer parts, larger prior of its morphemes, then its text and input order."""
    prior = a09_morpheme_prior(spark, sf)
    rows = _c(spark, sf).withColumn("k", D.keys(F.col("decomp")))
    sums = rows.select("cand_id", F.explode("k").alias("key")).join(prior, "key").groupBy("cand_id").agg(F.sum("n").alias("prior"))
    rows = rows.join(sums, "cand_id", "left").withColumn("root", F.length(F.substring_index(F.get("k", F.lit(0)), "/", 1)))
    rows = rows.select("word_id", "weight", "root", F.size("k").alias("n"), F.coalesce("prior", F.lit(0)).alias("prior"), "decomp", "cand_id")
    return numbered(rows, "word_id", ["weight", F.desc_nulls_last("root"), "n", F.desc("prior"), "decomp", "cand_id"]).select("cand_id", "pos")


@R.query(f"SELECT word_id, decomp, weight, pos FROM (SELECT word_id, decomp, weight, row_number() OVER (PARTITION BY word_id ORDER BY weight, decomp) AS pos FROM (SELECT word_id, decomp, min(weight) AS weight FROM ({_C}) WHERE weight <= 1 GROUP BY word_id, decomp))")
def o04_cheapest_of_equals(spark: SparkSession, sf: str) -> DataFrame:
    """Lenient cut by weight, the least weight of equal analyses, and the order of those."""
    rows = _c(spark, sf).where("weight <= 1").groupBy("word_id", "decomp").agg(F.min("weight").alias("weight"))
    return numbered(rows, "word_id", ["weight", "decomp"])


_GOOD = f"SELECT * FROM ({_C}) WHERE score IS NOT NULL AND NOT isnan(score)"


def _good(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).where("score IS NOT NULL AND NOT isnan(score)")


@R.query(f"SELECT cand_id, native_rank, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, native_rank, cand_id) - 1 AS rank_score, row_number() OVER (PARTITION BY word_id ORDER BY n_parts, native_rank, cand_id) - 1 AS rank_parts, count(*) OVER (PARTITION BY word_id) AS candidates FROM ({_GOOD})")
def w01_ranks_in_word(spark: SparkSession, sf: str) -> DataFrame:
    rows = _good(spark, sf).select("word_id", "cand_id", "native_rank", "score", "n_parts")
    rows = numbered(rows, "word_id", [F.desc("score"), "native_rank", "cand_id"], "rank_score")
    rows = numbered(rows, "word_id", ["n_parts", "native_rank", "cand_id"], "rank_parts")
    sizes = rows.groupBy("word_id").agg(F.count("*").alias("candidates"))
    return rows.join(sizes, "word_id").select("cand_id", "native_rank", (F.col("rank_score") - 1).alias("rank_score"), (F.col("rank_parts") - 1).alias("rank_parts"), "candidates")


@R.query(f"SELECT word_id, max(CASE WHEN r = 1 THEN decomp END) AS top1, max(CASE WHEN r = 2 THEN decomp END) AS top2, round(max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END), 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, native_rank, cand_id) AS r FROM ({_GOOD}) WHERE native_rank < 40) WHERE r <= 2 GROUP BY word_id")
def w10_top_two(spark: SparkSession, sf: str) -> DataFrame:
    """The two best of the first forty analyses of each word, and how far apart they are."""
    order = W.partitionBy("word_id").orderBy(F.desc("score"), "native_rank", "cand_id")
    rows = _good(spark, sf).where("native_rank < 40").withColumn("r", F.row_number().over(order)).where("r <= 2")
    at = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return rows.groupBy("word_id").agg(at("decomp", 1).alias("top1"), at("decomp", 2).alias("top2"), F.round(at("score", 1) - at("score", 2), 6).alias("margin"))


@R.query("SELECT CASE WHEN margin < 0.05 THEN 0 WHEN margin < 0.1 THEN 1 WHEN margin < 0.3 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM (" + R.oracles["w10_top_two"] + ") WHERE margin IS NOT NULL AND NOT isinf(margin) GROUP BY 1")
def a21_margin_buckets(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("margin")
    rows = w10_top_two(spark, sf).where(m.isNotNull() & (F.abs(m) < float("inf")))
    return rows.groupBy(F.when(m < 0.05, 0).when(m < 0.1, 1).when(m < 0.3, 2).otherwise(3).alias("bucket")).agg(F.count("*").alias("n"))


_REL = "CASE WHEN top2 IS NULL THEN 'single' WHEN b = a THEN 'same' WHEN starts_with(a, b) OR starts_with(b, a) THEN 'prefix' WHEN string_split(a, '}')[1] = string_split(b, '}')[1] THEN 'same_root' ELSE 'other_root' END"


@R.query("SELECT " + _REL + " AS relation, count(*) AS n, median FROM (SELECT *, list_sort(list(margin) OVER (PARTITION BY " + _REL + "))[CAST(floor(count(margin) OVER (PARTITION BY " + _REL + ") / 2) AS BIGINT) + 1] AS median FROM (SELECT *, regexp_replace(top1, '\\{[^:{}]+:', '{', 'g') AS a, regexp_replace(top2, '\\{[^:{}]+:', '{', 'g') AS b FROM (" + R.oracles["w10_top_two"] + "))) GROUP BY ALL")
def a19_relation_of_top_two(spark: SparkSession, sf: str) -> DataFrame:
    """How the two best segmentations relate, with the count and the middle margin (an element, not a mean) of each class."""
    a, b = D.without_surfaces(F.col("top1")), D.without_surfaces(F.col("top2"))
    relation = F.when(F.col("top2").isNull(), "single").when(a == b, "same").when(a.startswith(b) | b.startswith(a), "prefix").when(F.substring_index(a, "}", 1) == F.substring_index(b, "}", 1), "same_root").otherwise("other_root")
    rows = w10_top_two(spark, sf).withColumn("relation", relation)
    # The middle element comes from the counts of each margin, of which there are few, not from a list of all.
    counts = rows.groupBy("relation", "margin").agg(F.count("*").alias("k"))
    by = W.partitionBy("relation")
    counts = counts.withColumn("upto", F.sum(F.when(F.col("margin").isNotNull(), F.col("k")).otherwise(0)).over(by.orderBy(F.asc_nulls_last("margin")))).withColumn("of", F.sum(F.when(F.col("margin").isNotNull(), F.col("k")).otherwise(0)).over(by)).withColumn("n", F.sum("k").over(by))
    middle = F.min(F.when(F.col("margin").isNotNull() & (F.col("upto") > F.floor(F.col("of") / 2)), F.col("margin")))
    return counts.groupBy("relation", "n").agg(middle.alias("median"))


@R.query(f"SELECT cand_id, CAST(list_reduce(list_prepend(struct_pack(cat := 'n', sw := 0, cl := 0), list_transform(i, lambda x: struct_pack(cat := x, sw := 0, cl := 0))), lambda a, x: struct_pack(cat := CASE WHEN regexp_matches(x.cat, '^[0-9]+[nv][nv]$') OR regexp_matches(x.cat, '^[0-9]+[nv]$') THEN x.cat[-1] ELSE a.cat END, sw := a.sw + CASE WHEN regexp_matches(x.cat, '^[0-9]+[nv][nv]$') AND x.cat[-1] <> a.cat THEN 1 ELSE 0 END, cl := a.cl + CASE WHEN (CASE WHEN regexp_matches(x.cat, '^[0-9]+[nv][nv]$') THEN x.cat[-2] WHEN regexp_matches(x.cat, '^t[nv]-') THEN x.cat[2] ELSE a.cat END) <> a.cat THEN 1 ELSE 0 END)).sw AS BIGINT) AS switches FROM (SELECT cand_id, {_IDS} AS i FROM ({_C}))")
def w08_category_switches(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).select("cand_id", D.switches(D.part_column(F.col("decomp"), 3))["switches"].cast("long").alias("switches"))


@R.query(f"SELECT cand_id, CAST(len(k) AS BIGINT) AS n_keys, CAST(len(list_distinct(k)) AS BIGINT) AS n_distinct, CAST(len(list_filter(range(2, len(k) + 1), lambda i: k[i] = k[i - 1])) AS BIGINT) AS repeats, round(CAST(len(k[1]) AS DOUBLE) / len(decomp), 6) AS root_part FROM (SELECT cand_id, decomp, {_KEYS} AS k FROM ({_C}))")
def m01_shape_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _c(spark, sf).withColumn("k", D.keys(F.col("decomp")))
    repeats = F.size(F.filter(F.zip_with(F.slice("k", 2, F.greatest(F.size("k"), F.lit(1))), F.slice("k", 1, F.greatest(F.size("k") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return rows.select("cand_id", F.size("k").cast("long").alias("n_keys"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), repeats.cast("long").alias("repeats"), F.round(F.length(F.get("k", F.lit(0))) / F.length("decomp"), 6).alias("root_part"))


@R.query(f"SELECT cand_id, round(score / nullif(max(score) OVER (PARTITION BY word_id), 0), 6) AS of_best, dense_rank() OVER (PARTITION BY word_id ORDER BY score DESC) AS level FROM ({_GOOD}) WHERE NOT isinf(score)")
def w09_relative_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = _good(spark, sf).where(F.abs("score") < float("inf")).select("word_id", "cand_id", "score")
    levels = numbered(rows.select("word_id", "score").distinct(), "word_id", [F.desc("score")], "level")
    best = rows.groupBy("word_id").agg(F.max("score").alias("best"))
    rows = rows.join(levels, ["word_id", "score"]).join(best, "word_id")
    return rows.select("cand_id", F.round(F.col("score") / F.nullif(F.col("best"), F.lit(0.0)), 6).alias("of_best"), "level")


@R.query(f"SELECT word_id, count_if(score = best) = 1 AS unique_best, round(any_value(best) - max(CASE WHEN score < best THEN score END), 6) AS to_next FROM (SELECT word_id, score, max(score) OVER (PARTITION BY word_id) AS best FROM ({_GOOD}) WHERE NOT isinf(score)) GROUP BY word_id")
def w09_lead_of_best(spark: SparkSession, sf: str) -> DataFrame:
    """Whether one candidate alone has the best score of its word, and how far the next level is; from the counts of the levels."""
    levels = _good(spark, sf).where("abs(score) < double('infinity')").groupBy("word_id", "score").agg(F.count("*").alias("n"))
    best = levels.groupBy("word_id").agg(F.max(F.struct("score", "n")).alias("b"))
    out = levels.join(best, "word_id").groupBy("word_id", "b").agg(F.max(F.when(F.col("score") < F.col("b.score"), F.col("score"))).alias("next"))
    return out.select("word_id", (F.col("b.n") == 1).alias("unique_best"), F.round(F.col("b.score") - F.col("next"), 6).alias("to_next"))


@R.query(f"SELECT word_id, arg_max(cand_id, (score, -native_rank, -cand_id)) AS cand_id FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY n_parts, native_rank, cand_id) AS h FROM ({_GOOD})) WHERE h <= 3 GROUP BY word_id")
def w12_best_of_hand_top(spark: SparkSession, sf: str) -> DataFrame:
    """The best by score among the first three of the hand-made order, which are cut in each task before the shuffle."""
    order = W.partitionBy("word_id").orderBy("n_parts", "native_rank", "cand_id")
    rows = _good(spark, sf).select("word_id", "cand_id", "native_rank", "score", "n_parts").withColumn("h", F.row_number().over(order)).where("h <= 3")
    return rows.groupBy("word_id").agg(F.max_by("cand_id", F.struct("score", -F.col("native_rank"), -F.col("cand_id"))).alias("cand_id"))


@R.query(f"SELECT word_id, min_by(cand_id, (r + 2 * h, native_rank, cand_id)) AS cand_id FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, native_rank, cand_id) AS r, row_number() OVER (PARTITION BY word_id ORDER BY n_parts, native_rank, cand_id) AS h FROM ({_GOOD})) GROUP BY word_id")
def w12_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = numbered(_good(spark, sf).select("word_id", "cand_id", "native_rank", "score", "n_parts"), "word_id", [F.desc("score"), "native_rank", "cand_id"], "r")
    rows = numbered(rows, "word_id", ["n_parts", "native_rank", "cand_id"], "h")
    return rows.groupBy("word_id").agg(F.min_by("cand_id", F.struct(F.col("r") + 2 * F.col("h"), "native_rank", "cand_id")).alias("cand_id"))


_EVAL = f"""
WITH gold AS (SELECT id AS word_id, decomps, len(list_distinct(decomps)) AS g FROM words WHERE len(decomps) > 0),
r AS (SELECT word_id, decomp, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, native_rank, decomp, cand_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY word_id, decomp ORDER BY score DESC, native_rank, cand_id) AS k FROM ({_GOOD})) WHERE k = 1),
j AS (SELECT gold.word_id, r, g, coalesce(list_contains(decomps, decomp), false) AS hit FROM gold LEFT JOIN r ON gold.word_id = r.word_id),
w AS (SELECT word_id, any_value(g) AS g, count(r) AS produced, count_if(hit) AS matched, min(CASE WHEN hit THEN r END) AS first, count_if(hit AND r <= g) AS in_r, count_if(hit AND r <= least(5, g)) AS in_5 FROM j GROUP BY word_id)
"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Each word's ranked analyses against its list: how many were produced and matched, and the place of the first match. Words with
    a list for which nothing usable was produced are kept with zeros.

    Analyses meet the lists by word and text, and are counted before the shuffle by word, so that a word with very many is spread.
    """
    words = table(spark, sf, "words").where(F.size("decomps") > 0).select(F.col("id").alias("word_id"), F.array_distinct("decomps").alias("d"))
    gold = words.select("word_id", F.size("d").alias("g"), F.explode("d").alias("decomp"))
    rows = _good(spark, sf).groupBy("word_id", "decomp").agg(F.max("score").alias("score"), F.max_by(F.struct("native_rank", "cand_id"), F.struct("score", -F.col("native_rank"), -F.col("cand_id"))).alias("x"))
    rows = numbered(rows.select("word_id", "decomp", "score", "x.native_rank", "x.cand_id"), "word_id", [F.desc("score"), "native_rank", "decomp", "cand_id"], "r")
    rows = rows.select("word_id", "decomp", "r").join(gold, ["word_id", "decomp"], "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sums = rows.groupBy("word_id").agg(
        F.count("r").alias("produced"), F.count("g").alias("matched"), F.min(F.when(F.col("g").isNotNull(), F.col("r"))).alias("first"),
        count(F.col("r") <= F.col("g")).alias("in_r"), count(F.col("g").isNotNull() & (F.col("r") <= F.least(F.lit(5), F.col("g")))).alias("in_5"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = words.select("word_id", F.size("d").alias("g")).join(sums, "word_id", "left")
    return out.select("word_id", "g", zero("produced"), zero("matched"), "first", zero("in_r"), zero("in_5"))


@R.query(_EVAL + "SELECT word_id, produced, matched, first FROM w")
def a12_matches_by_word(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("word_id", "produced", "matched", "first")


@R.query(_EVAL + "SELECT round(avg(CAST(matched AS DOUBLE) / g), 6) AS recall, round(avg(CAST(matched AS DOUBLE) / nullif(produced, 0)), 6) AS precision, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CAST(in_r AS DOUBLE) / g), 6) AS r_precision, round(avg(CAST(in_5 AS DOUBLE) / least(5, g)), 6) AS p_at_5, count_if(first = 1) AS at1, count_if(first <= 3) AS at3, count_if(first <= 5) AS at5 FROM w")
def a16_ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda a, b: F.round(F.avg(F.col(a) / b), 6)
    return _judged(spark, sf).agg(
        mean("matched", F.col("g")).alias("recall"), mean("matched", F.nullif(F.col("produced"), F.lit(0))).alias("precision"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        mean("in_r", F.col("g")).alias("r_precision"), mean("in_5", F.least(F.lit(5), F.col("g"))).alias("p_at_5"),
        *(F.sum(F.coalesce(F.col("first") <= n, F.lit(False)).cast("long")).alias(f"at{n}") for n in (1, 3, 5)),
    )


@R.query(_EVAL + "SELECT CASE WHEN produced = 0 THEN 'none' WHEN first = 1 THEN 'first' WHEN first > 1 THEN 'later' ELSE 'absent' END AS outcome, count(*) AS n, round(avg(produced), 6) AS mean_produced FROM w GROUP BY 1")
def a15_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("produced") == 0, "none").when(F.col("first") == 1, "first").when(F.col("first") > 1, "later").otherwise("absent")
    return _judged(spark, sf).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("produced"), 6).alias("mean_produced"))


@R.query(_EVAL + "SELECT n, round(avg(CASE WHEN first <= n THEN 1.0 ELSE 0.0 END), 6) AS share FROM w, range(1, 6) t(n) GROUP BY n")
def a14_top_n_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of words with a right analysis among the first n, n from 1 to 5."""
    each = F.explode(F.expr("transform(sequence(1, 5), n -> named_struct('n', CAST(n AS BIGINT), 'hit', coalesce(first <= n, false)))"))
    return _judged(spark, sf).select(each.alias("x")).groupBy("x.n").agg(F.round(F.avg(F.when(F.col("x.hit"), 1.0).otherwise(0.0)), 6).alias("share"))


@R.query(_EVAL + "SELECT count(*) AS words, count_if(produced = 0) AS no_output, round(avg(CAST(matched AS DOUBLE) / g), 6) AS recall, round(avg(CAST(matched AS DOUBLE) / nullif(produced, 0)), 6) AS precision, count_if(produced > 0) AS with_precision FROM w")
def a13_recall_and_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Means over words; precision is undefined for words without output, which are counted."""
    none = (F.col("produced") == 0).cast("long")
    mean = lambda a, b: F.round(F.avg(F.col(a) / b), 6)
    return _judged(spark, sf).agg(F.count("*").alias("words"), F.sum(none).alias("no_output"), mean("matched", F.col("g")).alias("recall"), mean("matched", F.nullif(F.col("produced"), F.lit(0))).alias("precision"), F.sum(1 - none).alias("with_precision"))


@R.query(f"SELECT analyzer, count(*) AS n, count(DISTINCT word_id) AS words, count_if(weight <= 0) AS strict, count_if(weight > 0 AND weight <= 1) AS lenient, count_if(isinf(weight)) AS dropped, round(avg(n_parts), 6) AS mean_parts FROM ({_C}) GROUP BY analyzer")
def a18_analyzer_volume(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda c: F.sum(F.expr(c).cast("long"))
    return _c(spark, sf).groupBy("analyzer").agg(F.count("*").alias("n"), F.countDistinct("word_id").alias("words"), count("weight <= 0").alias("strict"), count("weight > 0 AND weight <= 1").alias("lenient"), count("weight = double('infinity')").alias("dropped"), F.round(F.avg("n_parts"), 6).alias("mean_parts"))


def _stem_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "words").where(F.size("top_decomp") > 0)
    return rows.select("id", "word", "freq", F.array_join(D.stem(F.col("top_decomp")), " ").alias("stem"), F.size("top_decomp").alias("n_parts"))


_WSTEM = f"SELECT id, word, freq, array_to_string({_STEM}, ' ') AS stem, len(k) AS n_parts FROM (SELECT id, word, freq, top_decomp AS k FROM words WHERE len(top_decomp) > 0)"


@R.query(f"SELECT s.id, s.stem, count(*) OVER (PARTITION BY stem) AS size, first_value(id) OVER (PARTITION BY stem ORDER BY n_parts, freq DESC NULLS LAST, id) AS base_id, id <> first_value(id) OVER (PARTITION BY stem ORDER BY n_parts, freq DESC NULLS LAST, id) AS inflected FROM ({_WSTEM}) s")
def a24_paradigms(spark: SparkSession, sf: str) -> DataFrame:
    """Words by stem with the size of the paradigm and its base form: the fewest parts, then the most frequent. The base is found
    before the shuffle and joined back, so that a stem with very many forms isn't gathered.
    """
    rows = _stem_rows(spark, sf)
    base = rows.groupBy("stem").agg(F.count("*").alias("size"), F.min(F.struct("n_parts", (-F.coalesce("freq", F.lit(-1))).alias("f"), "id"))["id"].alias("base_id"))
    return rows.join(base, "stem").select("id", "stem", "size", "base_id", (F.col("id") != F.col("base_id")).alias("inflected"))


@R.query(f"SELECT size, count(*) AS paradigms FROM (SELECT stem, count(*) AS size FROM ({_WSTEM}) GROUP BY stem) GROUP BY size")
def a25_paradigm_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _stem_rows(spark, sf).groupBy("stem").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("paradigms"))


@R.query(f"SELECT id AS word_id, decomp FROM (SELECT id, unnest(decomps) AS decomp FROM words) EXCEPT SELECT word_id, decomp FROM ({_C})")
def u08_lost_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses that the dictionary lists and the candidates no longer hold: none where the later snapshot is a superset."""
    before = table(spark, sf, "words").select(F.col("id").alias("word_id"), F.explode("decomps").alias("decomp")).distinct()
    return before.join(_c(spark, sf).select("word_id", "decomp"), ["word_id", "decomp"], "left_anti")


@R.query(_EVAL + "SELECT coalesce(o.id, w.word_id) AS id, coalesce(w.matched, -1) AS live, coalesce(o.n_decomps, 0) AS expected, coalesce(w.matched, -1) <> coalesce(o.n_decomps, 0) AS differs FROM w FULL JOIN (SELECT id, n_decomps FROM words WHERE analyzer_outcome = 'completed') o ON o.id = w.word_id")
def j18_snapshot_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """What was matched now against what is on record, with a default where one side lacks the word."""
    live = _judged(spark, sf).select(F.col("word_id").alias("id"), "matched")
    old = table(spark, sf, "words").where("analyzer_outcome = 'completed'").select("id", F.col("n_decomps"))
    a, b = F.coalesce("matched", F.lit(-1)), F.coalesce("n_decomps", F.lit(0))
    return live.join(old, "id", "full").select("id", a.alias("live"), b.alias("expected"), (a != b).alias("differs"))


@R.query(f"WITH s AS (SELECT id, freq, pos, array_to_string({_STEM}, ' ') AS stem FROM (SELECT id, freq, pos, {_KEYS} AS k FROM (SELECT id, freq, unnest(decomps[1:2]) AS decomp, unnest(range(len(decomps[1:2]))) AS pos FROM words))) SELECT id, arg_min(stem, pos) AS stem FROM s WHERE stem <> '' AND stem IN (SELECT stem FROM s WHERE freq >= 1000) GROUP BY id")
def j17_seed_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """All words that share a stem with a frequent word, by the stems of the first two analyses of both; each once, with the first
    stem that links it.
    """
    rows = table(spark, sf, "words").select("id", "freq", F.posexplode(F.slice("decomps", 1, 2)).alias("pos", "decomp"))
    rows = rows.select("id", "freq", "pos", F.array_join(D.stem(D.keys(F.col("decomp"))), " ").alias("stem")).where("stem <> ''")
    linked = rows.join(rows.where("freq >= 1000").select("stem").distinct(), "stem", "left_semi")
    return linked.groupBy("id").agg(F.min_by("stem", "pos").alias("stem"))


@R.query(f"SELECT cand_id, o FROM (SELECT cand_id, word_id, row_number() OVER (PARTITION BY split_part({_KEYS}[1], '/', 1) ORDER BY 10000 * score DESC, len(decomp), decomp, cand_id) AS o FROM ({_GOOD}) WHERE NOT isinf(score)) WHERE o <= 5")
def o12_examples_by_root(spark: SparkSession, sf: str) -> DataFrame:
    """The five best examples of each root, with their round."""
    root = F.substring_index(F.get(D.keys(F.col("decomp")), F.lit(0)), "/", 1)
    rows = _good(spark, sf).where(F.abs("score") < float("inf")).withColumn("root", root)
    order = W.partitionBy("root").orderBy(F.desc(10000 * F.col("score")), F.length("decomp"), "decomp", "cand_id")
    return rows.withColumn("o", F.row_number().over(order)).where("o <= 5").select("cand_id", "o")


@R.query(f"SELECT word_id, CAST(len(list_intersect(a, b)) AS BIGINT) AS common, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS only_r2l, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS covers FROM (SELECT word_id, list(DISTINCT decomp) FILTER (analyzer = 'r2l') AS a, list(DISTINCT decomp) FILTER (analyzer = 'fst') AS b FROM ({_C}) GROUP BY word_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def u03_analyzer_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How many analyses of a word both analyzers give, one alone gives, and whether one covers the other; counted without lists."""
    rows = _c(spark, sf).groupBy("word_id", "decomp").agg(F.max((F.col("analyzer") == "r2l").cast("long")).alias("a"), F.max((F.col("analyzer") == "fst").cast("long")).alias("b"))
    sums = rows.groupBy("word_id").agg(F.sum(F.col("a") * F.col("b")).alias("common"), F.sum(F.col("a") * (1 - F.col("b"))).alias("only_r2l"), F.sum(F.col("b") * (1 - F.col("a"))).alias("only_b"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return sums.where("n_a > 0 AND n_b > 0").select("word_id", "common", "only_r2l", (F.col("only_b") == 0).alias("covers"))


@R.query("SELECT w.id FROM words w WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.word_id = w.id)")
def j13_words_to_do(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words").join(table(spark, sf, "candidates").select("word_id"), F.col("id") == F.col("word_id"), "left_anti").select("id")


@R.query("SELECT w.id FROM words w WHERE EXISTS (SELECT 1 FROM candidates c WHERE c.word_id = w.id AND list_contains(w.decomps, c.decomp))")
def j12_words_with_a_match(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "words").select("id", F.explode("decomps").alias("decomp")).distinct()
    return words.join(_c(spark, sf).select(F.col("word_id").alias("id"), "decomp"), ["id", "decomp"], "left_semi").select("id").distinct()


@R.query("SELECT id, analyzer_outcome, CASE WHEN freq >= 1000 THEN 'high' WHEN freq >= 100 THEN 'middle' ELSE 'tail' END AS band, list_slice(decomps, 1, 3) AS preview, len(decomps) > 3 AS has_more FROM words WHERE analyzer_outcome = 'completed' AND len(decomps) > 0")
def flt19_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "words").where("analyzer_outcome = 'completed' AND size(decomps) > 0")
    band = F.when(F.col("freq") >= 1000, "high").when(F.col("freq") >= 100, "middle").otherwise("tail")
    return rows.select("id", "analyzer_outcome", band.alias("band"), F.slice("decomps", 1, 3).alias("preview"), (F.size("decomps") > 3).alias("has_more"))


@R.query("SELECT analyzer_outcome, count(*) AS n, count_if(len(decomps) > 0) AS with_decomps, count_if(r2l_error IS NOT NULL) AS errors, CAST(sum(n_decomps) AS BIGINT) AS decomps FROM words GROUP BY 1")
def a28_run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words").groupBy("analyzer_outcome").agg(F.count("*").alias("n"), F.sum((F.coalesce(F.size("decomps"), F.lit(0)) > 0).cast("long")).alias("with_decomps"), F.count("r2l_error").alias("errors"), F.sum("n_decomps").alias("decomps"))


@R.query("SELECT word, id, freq FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY loaded_at DESC, id DESC) AS k FROM words WHERE word IS NOT NULL) WHERE k = 1")
def w06_last_write_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "words").where("word IS NOT NULL").groupBy("word").agg(F.max(F.struct("loaded_at", "id", "freq")).alias("x"))
    return rows.select("word", "x.id", "x.freq")


@R.query("SELECT id, (row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1) % 5 AS fold FROM words")
def m09_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds of words: shuffled by hash and dealt in turn. The places come from range partitions, as many as the session has."""
    rows = table(spark, sf, "words").select("id", F.md5(F.col("id").cast("string")).alias("h"), F.lit(0).alias("all"))
    return numbered(rows, "all", ["h", "id"]).select("id", ((F.col("pos") - 1) % 5).alias("fold"))


@R.query(f"SELECT key, count(DISTINCT word_id) AS words FROM (SELECT word_id, unnest({_KEYS}) AS key FROM ({_C})) WHERE key IN ('mi/tn-loc-d', 'lu/2vv', 'suk/2nn', 'mu/3vv') GROUP BY key")
def j21_words_by_morpheme(spark: SparkSession, sf: str) -> DataFrame:
    """Words of which some analysis has a morpheme."""
    rows = _c(spark, sf).select("word_id", F.explode(D.keys(F.col("decomp"))).alias("key"))
    return rows.where(F.col("key").isin("mi/tn-loc-d", "lu/2vv", "suk/2nn", "mu/3vv")).groupBy("key").agg(F.countDistinct("word_id").alias("words"))


@R.query(f"WITH f AS ({_AFF}) SELECT word_id, len(list_filter(affixes, lambda x: x NOT IN ('lu/2vv', 'suk/2nn', 'mu/3vv', 'sagu/2nn'))) = 0 AS supported FROM f")
def u05_supported_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the affixes of a word's first analysis are all among the supported ones."""
    known = F.array(*map(F.lit, ("lu/2vv", "suk/2nn", "mu/3vv", "sagu/2nn")))
    return _first(spark, sf).select("word_id", (F.size(F.array_except("affixes", known)) == 0).alias("supported"))


@R.query(_EVAL + "SELECT g, count(*) AS words, count_if(first IS NULL OR first > 1) AS missed, round(avg(CASE WHEN first IS NULL OR first > 1 THEN 1.0 ELSE 0.0 END), 6) AS miss_rate FROM w GROUP BY g")
def a30_miss_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often the first analysis is wrong, by the number of right ones."""
    missed = F.when(F.coalesce(F.col("first") > 1, F.lit(True)), 1.0).otherwise(0.0)
    return _judged(spark, sf).groupBy("g").agg(F.count("*").alias("words"), F.sum(missed).cast("long").alias("missed"), F.round(F.avg(missed), 6).alias("miss_rate"))


@R.query(f"SELECT word_id, max(score) - min(score) > 0 AS any_spread, max(CASE WHEN lenient THEN 1 ELSE 0 END) = 1 AS ever_lenient, min(CASE WHEN lenient THEN 1 ELSE 0 END) = 1 AS always_lenient FROM ({_GOOD}) WHERE NOT isinf(score) GROUP BY word_id")
def a29_stability(spark: SparkSession, sf: str) -> DataFrame:
    lenient = F.when(F.col("lenient"), 1).otherwise(0)
    rows = _good(spark, sf).where(F.abs("score") < float("inf"))
    return rows.groupBy("word_id").agg((F.max("score") - F.min("score") > 0).alias("any_spread"), (F.max(lenient) == 1).alias("ever_lenient"), (F.min(lenient) == 1).alias("always_lenient"))


@R.query(f"SELECT c.cand_id, CASE WHEN g.top = c.decomp THEN 2 WHEN list_contains(g.decomps, c.decomp) THEN 1 ELSE 0 END AS tier FROM ({_C}) c JOIN (SELECT id, decomps, decomps[1] AS top FROM words WHERE len(decomps) > 0) g ON g.id = c.word_id")
def m11_relevance_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """2 for the first of a word's listed analyses, 1 for another of them, 0 for the rest."""
    gold = table(spark, sf, "words").where(F.size("decomps") > 0).select(F.col("id").alias("word_id"), "decomps")
    rows = _c(spark, sf).join(gold, "word_id")
    tier = F.when(F.get("decomps", F.lit(0)) == F.col("decomp"), 2).when(F.array_contains("decomps", F.col("decomp")), 1).otherwise(0)
    return rows.select("cand_id", tier.alias("tier"))


@R.query(f"SELECT coalesce(r.word_id, f.word_id) AS word_id, r.decomp IS NOT DISTINCT FROM f.decomp AS same_top, r.decomp IS NULL AS only_fst, f.decomp IS NULL AS only_r2l FROM (SELECT word_id, arg_min(decomp, (native_rank, cand_id)) AS decomp FROM ({_C}) WHERE analyzer = 'r2l' GROUP BY 1) r FULL JOIN (SELECT word_id, arg_min(decomp, (native_rank, cand_id)) AS decomp FROM ({_C}) WHERE analyzer = 'fst' GROUP BY 1) f ON r.word_id = f.word_id")
def j20_first_of_both_analyzers(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the two analyzers' first analyses agree, and which one alone has the word; one aggregation, no join."""
    first = lambda a: F.min_by(F.when(F.col("analyzer") == a, F.col("decomp")), F.when(F.col("analyzer") == a, F.struct("native_rank", "cand_id")))
    rows = _c(spark, sf).groupBy("word_id").agg(first("r2l").alias("r"), first("fst").alias("f")).where("r IS NOT NULL OR f IS NOT NULL")
    return rows.select("word_id", F.col("r").eqNullSafe(F.col("f")).alias("same_top"), F.col("r").isNull().alias("only_fst"), F.col("f").isNull().alias("only_r2l"))


@R.query(f"SELECT a.word_id, a.key, a.n AS in_word, p.n AS prior FROM (SELECT word_id, key, count(*) AS n FROM (SELECT word_id, unnest(k) AS key FROM ({_FIRST})) GROUP BY ALL) a LEFT JOIN (SELECT x AS key, count(*) AS n FROM (SELECT unnest(k) AS x FROM ({_FIRST})) GROUP BY x) p ON p.key = a.key")
def j06_morpheme_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """The morphemes of each word's first analysis with their frequency."""
    rows = _first(spark, sf).select("word_id", F.explode("k").alias("key")).groupBy("word_id", "key").agg(F.count("*").alias("in_word"))
    return rows.join(a09_morpheme_prior(spark, sf).withColumnRenamed("n", "prior"), "key", "left").select("word_id", "key", "in_word", "prior")
