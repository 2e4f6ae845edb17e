"""Features of analyses, their statistics, rankers and paradigms."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexigrid.functions import decomp as D
from lexigrid.operators import candidates as C
from lexigrid.operators import ranker
from lexigrid.operators.ranks import numbered
from lexigrid.operators.trees import score_rows
from lexigrid.plans.ranking import _C, _FIRST, _GOOD, _IDS, _KEYS, _RE, _c, _first, _good, a09_morpheme_prior, w10_top_two
from lexigrid.plans.registry import Registry
from lexigrid.session import cut, table

R = Registry()
#: Words that the rankers here are trained on at most.
MOST_WORDS = 2000


def _own(rows: DataFrame, *more: str) -> DataFrame:
    """The word of a candidate is what its surfaces spell."""
    return C.own_features(rows.select("cand_id", "word_id", D.surface(F.col("decomp")).alias("word"), "decomp", "native_rank", "weight", *more))


def _rounded(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("cand_id", *(F.round(F.col(n).cast("double"), 6).alias(n) for n in names))


_CAT = "CASE WHEN regexp_matches(i[1], '^[0-9]+[nv]$') THEN i[1][-1] ELSE 'n' END"
_DER = "regexp_matches(x.c, '^[0-9]+(vn|nv|vv|nn)$')"
_WALK = f"list_reduce(list_prepend(struct_pack(c := {_CAT}, s := 0, v := 0), list_transform(i[2:], lambda z: struct_pack(c := z, s := 0, v := 0))), lambda a, x: struct_pack(c := CASE WHEN {_DER} THEN x.c[-1] ELSE a.c END, s := a.s + CASE WHEN {_DER} AND x.c[-1] <> a.c THEN 1 ELSE 0 END, v := a.v + CASE WHEN {_DER} AND x.c[-2] <> a.c THEN 1 ELSE 0 END))"
_OWN = f"""
WITH p AS (SELECT cand_id, word_id, native_rank, weight, decomp, array_to_string(regexp_extract_all(decomp, '{_RE}', 1), '') AS word, regexp_extract_all(decomp, '{_RE}', 2) AS c, {_IDS} AS i FROM ({_C})),
q AS (SELECT *, len(i) AS n, array_to_string(c, '') AS cat, list_transform(c, lambda x: len(x)) AS l FROM p WHERE len(i) > 0),
f AS (SELECT cand_id, word_id, native_rank, weight, decomp, n AS n_morphemes, n - 1 AS n_nonroot, len(list_filter(i[2:], lambda x: regexp_matches(x, '^[0-9]+(vn|nv|vv|nn)$'))) AS n_deriv,
  len(list_filter(i, lambda x: regexp_matches(x, '^(tn|tv|tad|tpd)-'))) AS n_ending, len(list_filter(range(2, n + 1), lambda k: i[k] = i[k - 1])) AS n_consec_dup_id,
  CAST(len(word) AS DOUBLE) / n AS wordlen_per_morph, l[1] AS root_canon_len, CAST(len(cat) AS DOUBLE) / n AS mean_canon_len, list_min(l) AS min_canon_len, len(list_filter(l, lambda x: x <= 1)) AS n_thin_canon,
  len(list_filter(i, lambda x: regexp_matches(x, '^[0-9]+vv$'))) AS n_vv, len(list_filter(i, lambda x: regexp_matches(x, '^[0-9]+nn$'))) AS n_nn, len(list_filter(i, lambda x: regexp_matches(x, '^[0-9]+vn$'))) AS n_vn, len(list_filter(i, lambda x: regexp_matches(x, '^[0-9]+nv$'))) AS n_nv,
  ({_WALK}).s AS cat_switches, ({_WALK}).v AS type_violations, CAST(regexp_matches(i[-1], '^(tn|tv|tad|tpd)-') AS INT) AS ends_with_ending, CAST(regexp_matches(i[-1], '^[0-9]+(vn|nv|vv|nn)$') AS INT) AS ends_with_bare_deriv,
  levenshtein(cat, word) AS edit_dist, CAST(levenshtein(cat, word) AS DOUBLE) / greatest(len(word), 1) AS edit_dist_norm, len(cat) - len(word) AS concat_len_minus_word, CAST(starts_with(word, c[1]) AS INT) AS first_canon_is_prefix
FROM q)"""
_OWN_NAMES = C.FEATURES[:22]
_ROUNDED = lambda names: ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


@R.query(_OWN + f"SELECT cand_id, {_ROUNDED(_OWN_NAMES)} FROM f")
def m01_own_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_own(_c(spark, sf)), _OWN_NAMES)


def _features(rows: DataFrame, prior: DataFrame, *more: str) -> DataFrame:
    """(cand_id, word_id, native_rank, features, more) of rows of candidates, with all those of a word; prior is a table."""
    own = cut(_own(rows, *more).drop("word", "decomp"))
    out = own.join(C.places(own), "cand_id").join(C.frequencies(own, prior), "cand_id")
    return out.select("cand_id", "word_id", "native_rank", *C.FEATURES, *more)


def _prior(spark: SparkSession, sf: str) -> DataFrame:
    return cut(a09_morpheme_prior(spark, sf))


_RANKS = ", ".join(
    f"row_number() OVER (PARTITION BY word_id ORDER BY {o}, native_rank, cand_id) - 1 AS {n}"
    for n, o in (("rank_current_sort", "weight, root_canon_len DESC, n_nonroot"), ("edit_dist_rank_in_word", "edit_dist"), ("n_morphemes_rank_in_word", "n_morphemes"), ("root_canon_len_rank_in_word", "root_canon_len DESC"), ("type_violations_rank_in_word", "type_violations"))
)
_ALL = _OWN + f""", g AS (SELECT *, {_RANKS}, count(*) OVER (PARTITION BY word_id) AS n_candidates FROM f),
pr AS (SELECT x AS key, count(*) AS n FROM (SELECT unnest(k) AS x FROM ({_FIRST})) GROUP BY x),
k AS (SELECT cand_id, unnest({_KEYS}) AS key, unnest(range(len({_KEYS}))) AS pos FROM ({_C})),
s AS (SELECT cand_id, sum(coalesce(n, 0)) AS freq_sum, avg(coalesce(n, 0)) AS freq_mean, min(coalesce(n, 0)) AS freq_min, max(CASE WHEN pos = 0 THEN coalesce(n, 0) END) AS freq_root, count_if(n IS NULL) AS n_zero_freq FROM k LEFT JOIN pr USING (key) GROUP BY cand_id)
"""


@R.query(_ALL + f"SELECT cand_id, {_ROUNDED(C.FEATURES)} FROM g JOIN s USING (cand_id)")
def m01_candidate_features(spark: SparkSession, sf: str) -> DataFrame:
    """All features of every candidate; ranks within a word come from range partitions, frequencies from a join of the parts."""
    return _rounded(_features(_c(spark, sf), _prior(spark, sf)), C.FEATURES)


_STATS = f"""
WITH w AS (SELECT {_KEYS} AS k, {_IDS} AS i, regexp_extract(decomp, '{_RE}', 2) AS root FROM (SELECT decomp FROM ({_FIRST})) WHERE len({_KEYS}) > 0), st AS (
SELECT 'unigram' AS kind, a, CAST(NULL AS VARCHAR) AS b FROM (SELECT unnest(k) AS a FROM w) UNION ALL
SELECT 'bigram', i[j], i[j + 1] FROM (SELECT i, unnest(range(1, len(i))) AS j FROM w) UNION ALL
SELECT 'before', i[j], NULL FROM (SELECT i, unnest(range(1, len(i))) AS j FROM w) UNION ALL
SELECT 'root', i[1], NULL FROM w UNION ALL
SELECT 'letters', root[j:j + 1], NULL FROM (SELECT root, unnest(range(1, len(root))) AS j FROM w)), stats AS (SELECT kind, a, b, count(*) AS n FROM st GROUP BY ALL)
"""


@R.query(_STATS + "SELECT * FROM stats")
def a10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return C.statistics(_first(spark, sf))


@R.query(_STATS + f""", c AS (SELECT cand_id, {_IDS} AS i, regexp_extract(decomp, '{_RE}', 2) AS root FROM ({_C}) WHERE len({_IDS}) > 0),
t AS (SELECT cand_id, pos, coalesce(CAST(g.n AS DOUBLE) / v.n, 0) AS share FROM (SELECT cand_id, i[j] AS a, i[j + 1] AS b, j AS pos FROM (SELECT cand_id, i, unnest(range(1, len(i))) AS j FROM c)) x LEFT JOIN stats g ON g.kind = 'bigram' AND g.a = x.a AND g.b = x.b LEFT JOIN stats v ON v.kind = 'before' AND v.a = x.a),
tt AS (SELECT cand_id, min(share) AS mi, avg(share) AS me, count_if(share = 0) AS z, max(CASE WHEN pos = 1 THEN share END) AS f FROM t GROUP BY cand_id),
l AS (SELECT cand_id, avg(coalesce(n, 0)) AS m FROM (SELECT cand_id, root[j:j + 1] AS a FROM (SELECT cand_id, root, unnest(range(1, len(root))) AS j FROM c)) x LEFT JOIN stats g ON g.kind = 'letters' AND g.a = x.a GROUP BY cand_id)
SELECT c.cand_id, round(coalesce(mi, 1), 6) AS bigram_min, round(coalesce(me, 1), 6) AS bigram_mean, coalesce(z, 0) AS bigram_nzero, round(coalesce(f, 1), 6) AS bigram_root_first, coalesce(r.n, 0) AS root_id_freq, round(coalesce(m, 0), 6) AS root_charbi
FROM c LEFT JOIN tt USING (cand_id) LEFT JOIN l USING (cand_id) LEFT JOIN stats r ON r.kind = 'root' AND r.a = c.i[1]""")
def m02_identity_features(spark: SparkSession, sf: str) -> DataFrame:
    out = C.with_identity(_c(spark, sf).select("cand_id", "decomp"), cut(C.statistics(_first(spark, sf))))
    r = lambda c: F.round(F.col(c), 6).alias(c)
    return out.select("cand_id", r("bigram_min"), r("bigram_mean"), "bigram_nzero", r("bigram_root_first"), "root_id_freq", r("root_charbi"))


@R.query(f"""
WITH r AS (SELECT word_id, decomp, min(k) AS k FROM (SELECT word_id, decomp, row_number() OVER (PARTITION BY word_id ORDER BY native_rank, cand_id) - 1 AS k FROM ({_C}) WHERE analyzer = 'r2l') GROUP BY ALL), a AS (SELECT DISTINCT word_id FROM r)
SELECT c.cand_id, a.word_id IS NOT NULL AS available, coalesce(r.k = 0, false) AS top1, r.k IS NOT NULL AS produced, round(coalesce(1.0 / (r.k + 1), 0), 6) AS rank_inv
FROM (SELECT * FROM ({_C}) WHERE analyzer = 'fst') c LEFT JOIN a ON a.word_id = c.word_id LEFT JOIN r ON r.word_id = c.word_id AND r.decomp = c.decomp""")
def m03_cross_analyzer(spark: SparkSession, sf: str) -> DataFrame:
    """What the other analyzer says of each analysis: whether it has the word, gives this analysis first or at all, and its place there."""
    rows = _c(spark, sf)
    other = numbered(rows.where("analyzer = 'r2l'").select("word_id", "decomp", "native_rank", "cand_id"), "word_id", ["native_rank", "cand_id"], "k")
    other = cut(other.groupBy("word_id", "decomp").agg((F.min("k") - 1).alias("k")))
    out = rows.where("analyzer = 'fst'").select("cand_id", "word_id", "decomp").join(other, ["word_id", "decomp"], "left")
    out = out.join(other.select("word_id", F.lit(True).alias("has")).distinct(), "word_id", "left")
    return out.select("cand_id", F.col("has").isNotNull().alias("available"), F.coalesce(F.col("k") == 0, F.lit(False)).alias("top1"), F.col("k").isNotNull().alias("produced"), F.round(F.coalesce(1 / (F.col("k") + 1), F.lit(0.0)), 6).alias("rank_inv"))


@R.query(f"WITH v AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM ({_GOOD}) WHERE NOT isinf(score)) SELECT DISTINCT score AS edge FROM v, range(1, 16) t(q) WHERE k = n * q // 16")
def m07_quantile_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Borders of sixteen cells with equal numbers of scores."""
    return C.quantile_edges(_good(spark, sf).where("abs(score) < double('infinity')"), "score", 16).distinct()


@R.query(f"SELECT cand_id, levenshtein(array_to_string(regexp_extract_all(decomp, '{_RE}', 2), ''), array_to_string(regexp_extract_all(decomp, '{_RE}', 1), '')) AS distance FROM ({_C})")
def x13_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("decomp")
    return _c(spark, sf).select("cand_id", F.levenshtein(F.array_join(D.part_column(d, 2), ""), D.surface(d)).cast("long").alias("distance"))


_DELTA = ["n_morphemes", "root_canon_len", "type_violations", "edit_dist", "mean_canon_len"]


@R.query(_OWN + f""", j AS (SELECT f.*, c.score, list_contains(w.decomps, f.decomp) AS hit FROM f JOIN ({_GOOD}) c USING (cand_id) JOIN words w ON w.id = f.word_id WHERE len(w.decomps) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, native_rank, cand_id) AS r, row_number() OVER (PARTITION BY word_id, hit ORDER BY score DESC, native_rank, cand_id) AS h FROM j),
m AS (SELECT p.word_id, {', '.join(f'p.{x} - c.{x} AS {x}' for x in _DELTA)} FROM (SELECT * FROM o WHERE r = 1 AND NOT hit) p JOIN (SELECT * FROM o WHERE hit AND h = 1) c ON p.word_id = c.word_id)
{' UNION ALL '.join(f"SELECT '{x}' AS feature, round(avg(CAST({x} AS DOUBLE)), 6) AS mean_delta, round(avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, count(*) AS misses FROM m" for x in _DELTA)}""")
def a31_feature_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Over words whose first analysis by score is wrong: pick minus the best right one, feature by feature."""
    gold = table(spark, sf, "words").select(F.col("id").alias("word_id"), F.explode("decomps").alias("decomp")).distinct().withColumn("hit", F.lit(True))
    rows = _own(_c(spark, sf)).join(_good(spark, sf).select("cand_id", "score"), "cand_id").join(gold, ["word_id", "decomp"], "left")
    best = lambda c: F.max_by(F.struct(*(F.col(x).cast("double").alias(x) for x in _DELTA)), F.when(c, F.struct("score", -F.col("native_rank"), -F.col("cand_id"))))
    pick_hit = F.max_by(F.coalesce("hit", F.lit(False)), F.struct("score", -F.col("native_rank"), -F.col("cand_id")))
    words = rows.groupBy("word_id").agg(best(F.lit(True)).alias("p"), pick_hit.alias("hit"), best(F.col("hit")).alias("c")).where("NOT hit AND c IS NOT NULL")
    each = words.select(F.explode(F.array(*(F.struct(F.lit(x).alias("feature"), (F.col(f"p.{x}") - F.col(f"c.{x}")).alias("d")) for x in _DELTA))).alias("x")).select("x.*")
    return each.groupBy("feature").agg(F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)), 6).alias("positive"), F.count("*").alias("misses"))


_ORDER = f"SELECT c.cand_id, c.word_id, c.native_rank, c.weight, c.decomp, len(c.k) - 1 AS parts, len(regexp_extract(c.decomp, '{_RE}', 2)) AS root FROM (SELECT *, {_KEYS} AS k FROM ({_C})) c"


def _order_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = D.keys(F.col("decomp"))
    return _c(spark, sf).select("cand_id", "word_id", "native_rank", "weight", "decomp", (F.size(k) - 1).alias("parts"), F.length(F.regexp_extract("decomp", D.PART, 2)).alias("root"))


@R.query(f"SELECT cand_id, row_number() OVER (PARTITION BY word_id ORDER BY root DESC, parts, native_rank, cand_id) AS pos FROM ({_ORDER})")
def o02_native_order(spark: SparkSession, sf: str) -> DataFrame:
    """Longer root first, then fewer parts; ties keep the order of the input."""
    return numbered(_order_keys(spark, sf), "word_id", [F.desc("root"), "parts", "native_rank", "cand_id"]).select("cand_id", "pos")


@R.query(f"SELECT cand_id, row_number() OVER (PARTITION BY word_id ORDER BY weight, root DESC, parts, native_rank, cand_id) AS by_weight, row_number() OVER (PARTITION BY word_id ORDER BY root DESC, parts, decomp, native_rank, cand_id) AS by_text FROM ({_ORDER})")
def o03_order_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = numbered(_order_keys(spark, sf), "word_id", ["weight", F.desc("root"), "parts", "native_rank", "cand_id"], "by_weight")
    return numbered(rows, "word_id", [F.desc("root"), "parts", "decomp", "native_rank", "cand_id"], "by_text").select("cand_id", "by_weight", "by_text")


def _numbers() -> list[Column]:
    return [F.least(F.col(f).cast("double"), F.lit(1e9)).alias(f) for f in C.FEATURES]


def training_rows(spark: SparkSession, sf: str, prior: DataFrame, most_words: int = MOST_WORDS, most_rows: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and groups of the first most_rows candidates of at most most_words words with a listed analysis, drawn by hash. Only these words get
    features; their places are among all candidates of the word.
    """
    words = table(spark, sf, "words").where(F.size("decomps") > 0).select(F.col("id").alias("word_id"), F.get("decomps", F.lit(0)).alias("top"), "decomps")
    drawn = words.orderBy(F.xxhash64("word_id"), "word_id").limit(most_words)
    label = F.when(F.col("decomp") == F.col("top"), 2).when(F.array_contains("decomps", F.col("decomp")), 1).otherwise(0)
    rows = _features(_c(spark, sf).join(F.broadcast(drawn), "word_id").withColumn("label", label), prior, "label").where((F.col("native_rank") < most_rows) & F.col("weight").isNotNull())
    # The order of rows decides which ones a tree is grown from.
    got = rows.select("cand_id", "word_id", "label", *_numbers()).toPandas().sort_values(["word_id", "cand_id"])
    return got[C.FEATURES].to_numpy(float), got["label"].to_numpy(float), got["word_id"].to_numpy()


@R.query()
def m05_trained_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all candidates by trees trained on a bounded sample of words; the model is written, read and checked in between."""
    prior = _prior(spark, sf)
    x, labels, groups = training_rows(spark, sf, prior)
    settings = ranker.Boosting(rounds=20)
    trees, rate = ranker.read_model(ranker.write_model(ranker.train_trees(x, labels, groups, C.FEATURES, settings), C.FEATURES, settings.rate), C.FEATURES)
    return score_rows(_features(_c(spark, sf), prior).select("cand_id", *_numbers()), "cand_id", C.FEATURES, trees, rate)


@R.query()
def m10_nested_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Hits at the first place on each outer fold of a bounded sample of words, with the settings that the inner folds chose."""
    x, labels, groups = training_rows(spark, sf, _prior(spark, sf), 400)
    grid = [ranker.Boosting(rounds=8, depth=d) for d in (2, 3)]
    rows = ranker.nested_validation(x, labels, groups, C.FEATURES, [replace(s, negatives=5) for s in grid], outer=4, inner=2)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "fold int, depth int, rounds int, hits int, words int")


@R.query()
def m06_linear_rankers(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the pairwise and the listwise linear model on a bounded sample of words."""
    x, labels, groups = training_rows(spark, sf, _prior(spark, sf), 400)
    a, b = ranker.train_linear(x, labels, groups), ranker.train_linear(x, labels, groups, listwise=True)
    return spark.createDataFrame([(f, float(u), float(v)) for f, u, v in zip(C.FEATURES, a, b, strict=True)], "feature string, pairwise double, listwise double")


# Paradigms.

_TIER = "CASE WHEN len(list_filter(i, lambda x: regexp_matches(x, '^(tn|tv|tad|tpd)-'))) > 0 THEN 2 WHEN len(list_filter(i, lambda x: regexp_matches(x, '^[0-9]+q$'))) > 0 THEN 1 ELSE 0 END"
_CUT = "coalesce(list_position(list_transform(i, lambda x: regexp_matches(x, '^t[nv]-')), true) - 1, len(i) - coalesce(list_position(list_transform(list_reverse(i), lambda x: NOT regexp_matches(x, '^[0-9]+q$')), true) - 1, len(i)))"
_MEMBERS = f"SELECT id, freq, i, {_TIER} AS tier, array_to_string(list_slice(k, 1, {_CUT}), '+') AS stem FROM (SELECT id, freq, top_decomp AS k, list_transform(top_decomp, lambda x: split_part(x, '/', 2)) AS i FROM words WHERE len(top_decomp) > 0)"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "words").where(F.size("top_decomp") > 0).withColumn("i", F.transform("top_decomp", lambda x: F.substring_index(x, "/", -1)))
    return rows.select("id", "freq", "i", D.tier(F.col("i")).alias("tier"), F.array_join(D.stem(F.col("top_decomp")), "+").alias("stem"))


_KIND = lambda i: f"CASE WHEN {i} IS NULL THEN 'bare' WHEN starts_with({i}, 'tv-') THEN 'v' ELSE 'n' END"
_VAL = lambda i: f"CASE WHEN len(string_split({i}, '-')) >= 4 THEN 'tr' ELSE 'itr' END"


@R.query(f"""
WITH m AS ({_MEMBERS}), e AS (SELECT *, list_filter(i, lambda x: regexp_matches(x, '^(tn|tv|tad|tpd)-'))[-1] AS last FROM m),
b AS (SELECT stem, count(*) AS size, min(tier) AS best, arg_min(id, (tier, -coalesce(freq, -1), id)) AS base_id, arg_min(struct_pack(l := last), (tier, -coalesce(freq, -1), id)).l AS base_last FROM e GROUP BY stem)
SELECT e.id, e.stem, b.size AS paradigm_size, e.id <> b.base_id AS is_inflection, CASE WHEN e.id <> b.base_id THEN b.base_id END AS base_id, b.best = 2 AS base_is_inflected,
CASE WHEN e.id = b.base_id THEN NULL WHEN b.base_last IS NULL AND e.last IS NULL THEN 'enclitic-only'
  WHEN {_KIND('b.base_last')} = 'v' AND {_KIND('e.last')} = 'v' THEN CASE WHEN string_split(b.base_last, '-')[2] <> string_split(e.last, '-')[2] THEN 'verbal-mood-change' WHEN {_VAL('b.base_last')} <> {_VAL('e.last')} THEN 'verbal-valency-change' ELSE 'verbal-agreement' END
  WHEN {_KIND('e.last')} = 'v' THEN 'verbal-inflection' ELSE 'nominal-inflection' END AS base_relation
FROM e JOIN b USING (stem)""")
def x30_base_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Every word with the base of its paradigm (the lowest tier, then the most frequent) and how it relates to it. The base is found before the shuffle
    and joined back, so that a stem with very many words isn't gathered.
    """
    rows = cut(_members(spark, sf))
    base = rows.groupBy("stem").agg(F.count("*").alias("paradigm_size"), F.min(F.struct("tier", (-F.coalesce("freq", F.lit(-1))).alias("f"), "id", "i")).alias("b"))
    out = rows.join(base, "stem")
    other = F.col("id") != F.col("b.id")
    return out.select("id", "stem", "paradigm_size", other.alias("is_inflection"), F.when(other, F.col("b.id")).alias("base_id"), (F.col("b.tier") == 2).alias("base_is_inflected"), F.when(other, D.base_relation(F.col("b.i"), F.col("i"))).alias("base_relation"))


@R.query(f"SELECT id, tier, coalesce(list_filter(i, lambda x: regexp_matches(x, '^(tn|tv|tad|tpd)-'))[1], 'none') AS ending, CASE WHEN len(list_filter(i, lambda x: regexp_matches(x, '^(tn|tv|tad|tpd)-'))) = 0 THEN 'none' WHEN starts_with(list_filter(i, lambda x: regexp_matches(x, '^(tn|tv|tad|tpd)-'))[1], 'tv-') THEN 'verbal' ELSE 'nominal' END AS ending_class, CAST(len(list_filter(i, lambda x: regexp_matches(x, '^[0-9]+q$'))) AS BIGINT) AS enclitics FROM ({_MEMBERS})")
def x29_endings(spark: SparkSession, sf: str) -> DataFrame:
    first = F.get(D.endings(F.col("i")), F.lit(0))
    kind = F.when(first.isNull(), "none").when(first.startswith("tv-"), "verbal").otherwise("nominal")
    return _members(spark, sf).select("id", "tier", F.coalesce(first, F.lit("none")).alias("ending"), kind.alias("ending_class"), F.size(D.enclitics(F.col("i"))).cast("long").alias("enclitics"))


@R.query(f"SELECT stem, count(*) AS size, min(tier) AS tier, row_number() OVER (ORDER BY count(*) DESC, stem) AS rank FROM ({_MEMBERS}) GROUP BY stem QUALIFY rank <= 8")
def a25_biggest_paradigms(spark: SparkSession, sf: str) -> DataFrame:
    top = _members(spark, sf).groupBy("stem").agg(F.count("*").alias("size"), F.min("tier").alias("tier")).orderBy(F.desc("size"), "stem").limit(8)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "stem")))


# Reports on the two best analyses.

_BAND = "CASE WHEN freq >= 1000 THEN 'high' WHEN freq >= 100 THEN 'middle' ELSE 'tail' END"


def _canon(d: str) -> str:
    return f"regexp_extract_all({d}, '{_RE}', 2)"


def _two_sql() -> str:
    from lexigrid.plans.ranking import R as ranking

    c1, c2 = _canon("top1"), _canon("top2")
    relation = f"CASE WHEN top2 IS NULL THEN 'single' WHEN {c1} = {c2} THEN 'same' WHEN {c1}[1] <> {c2}[1] AND (starts_with({c1}[1], {c2}[1]) OR starts_with({c2}[1], {c1}[1])) THEN 'root_prefix' WHEN {c1}[1] = {c2}[1] THEN 'same_root' ELSE 'diff_root' END"
    return f"SELECT t.word_id, t.margin, w.freq, {_BAND} AS band, {relation} AS relation, w.word, top1, top2 FROM ({ranking.oracles['w10_top_two']}) t JOIN words w ON w.id = t.word_id"


def _two(spark: SparkSession, sf: str) -> DataFrame:
    rows = w10_top_two(spark, sf).join(table(spark, sf, "words").select(F.col("id").alias("word_id"), "freq", "word"), "word_id")
    c1, c2 = D.part_column(F.col("top1"), 2), D.part_column(F.col("top2"), 2)
    r1, r2 = F.get(c1, F.lit(0)), F.get(c2, F.lit(0))
    relation = F.when(F.col("top2").isNull(), "single").when(c1 == c2, "same").when((r1 != r2) & (r1.startswith(r2) | r2.startswith(r1)), "root_prefix").when(r1 == r2, "same_root").otherwise("diff_root")
    band = F.when(F.col("freq") >= 1000, "high").when(F.col("freq") >= 100, "middle").otherwise("tail")
    return rows.select("word_id", "margin", "freq", "word", "top1", "top2", band.alias("band"), relation.alias("relation"))


@R.query(f"SELECT relation, band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY relation), 4) AS percent FROM ({_two_sql()}) GROUP BY relation, band")
def a20_relation_by_band(spark: SparkSession, sf: str) -> DataFrame:
    counts = _two(spark, sf).groupBy("relation", "band").agg(F.count("*").alias("n"))
    # A handful of classes.
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("relation")), 4))


@R.query(f"SELECT label, count(*) AS n FROM (SELECT unnest(list_filter([relation, band, CASE WHEN margin < 0.05 THEN 'close' END, CASE WHEN len({_canon('top1')}) > len({_canon('top2')}) THEN 'longer_first' END], lambda x: x IS NOT NULL)) AS label FROM ({_two_sql()})) GROUP BY label")
def a22_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A word counts under every label that it has."""
    longer = F.size(D.part_column(F.col("top1"), 2)) > F.size(D.part_column(F.col("top2"), 2))
    labels = F.array_compact(F.array("relation", "band", F.when(F.col("margin") < 0.05, "close"), F.when(F.col("top2").isNotNull() & longer, "longer_first")))
    return _two(spark, sf).select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@R.query(f"SELECT relation, word_id, k FROM (SELECT relation, word_id, row_number() OVER (PARTITION BY relation ORDER BY margin, word_id) AS k FROM ({_two_sql()}) WHERE margin < 0.2) WHERE k <= 10")
def a23_examples_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten words of each class, closest first; cut in each task before the shuffle."""
    order = W.partitionBy("relation").orderBy("margin", "word_id")
    return _two(spark, sf).where("margin < 0.2").withColumn("k", F.row_number().over(order)).where("k <= 10").select("relation", "word_id", "k")


@R.query(f"SELECT relation, n, m[len(m) // 2 + 1] AS median, m[len(m) // 10 + 1] AS p10 FROM (SELECT relation, count(*) AS n, list_sort(list(margin) FILTER (margin IS NOT NULL AND NOT isnan(margin))) AS m FROM ({_two_sql()}) GROUP BY relation)")
def a19_margins_by_relation(spark: SparkSession, sf: str) -> DataFrame:
    """Count, middle margin and the one at a tenth (elements, not means) of each class, from the counts of the distinct margins."""
    counts = _two(spark, sf).groupBy("relation", "margin").agg(F.count("*").alias("c"))
    by = W.partitionBy("relation")
    real = F.when(F.col("margin").isNotNull() & ~F.isnan("margin"), F.col("c")).otherwise(0)
    counts = counts.withColumn("upto", F.sum(real).over(by.orderBy(F.asc_nulls_last("margin")))).withColumn("of", F.sum(real).over(by)).withColumn("n", F.sum("c").over(by))
    at = lambda k: F.min(F.when(F.col("margin").isNotNull() & ~F.isnan("margin") & (F.col("upto") > F.floor(F.col("of") / k)), F.col("margin")))
    return counts.groupBy("relation", "n").agg(at(2).alias("median"), at(10).alias("p10"))


@R.query(f"SELECT w.id, w.freq, t.decomp AS top1, round(t.score, 6) AS score, regexp_extract(t.decomp, '{_RE}', 2) AS root FROM words w LEFT JOIN (SELECT word_id, arg_max(decomp, (score, -native_rank, -cand_id)) AS decomp, max(score) AS score FROM ({_GOOD}) GROUP BY word_id) t ON t.word_id = w.id")
def j15_lexicon_with_best(spark: SparkSession, sf: str) -> DataFrame:
    """Every word with its best analysis by score, nulls where there is none."""
    best = _good(spark, sf).groupBy("word_id").agg(F.max_by("decomp", F.struct("score", -F.col("native_rank"), -F.col("cand_id"))).alias("top1"), F.max("score").alias("score"))
    out = table(spark, sf, "words").select("id", "freq").join(best.withColumnRenamed("word_id", "id"), "id", "left")
    return out.select("id", "freq", "top1", F.round("score", 6).alias("score"), F.regexp_extract("top1", D.PART, 2).alias("root"))


@R.query(f"SELECT word_id, pos, decomp, weight FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY weight, root DESC, parts, prior DESC, decomp) AS pos FROM (SELECT d.word_id, d.decomp, d.weight, d.root, d.parts, coalesce(p.s, 0) AS prior FROM (SELECT word_id, decomp, min(weight) AS weight, len(regexp_extract(decomp, '{_RE}', 2)) AS root, len({_IDS}) - 1 AS parts FROM ({_C}) WHERE weight <= 1 GROUP BY word_id, decomp) d LEFT JOIN (SELECT decomp, sum(n) AS s FROM (SELECT decomp, unnest({_KEYS}) AS x FROM (SELECT DISTINCT decomp FROM ({_C}))) JOIN (SELECT x, count(*) AS n FROM (SELECT unnest(k) AS x FROM ({_FIRST})) GROUP BY x) USING (x) GROUP BY decomp) p USING (decomp)))")
def o04_ranked_raw_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Cut by weight, the least weight of equal analyses, and the place of each by weight, longer root, fewer parts, larger prior and text."""
    d = F.col("decomp")
    rows = _c(spark, sf).where("weight <= 1").groupBy("word_id", "decomp").agg(F.min("weight").alias("weight"))
    texts = rows.select("decomp").distinct()
    sums = texts.select("decomp", F.explode(D.keys(d)).alias("key")).join(a09_morpheme_prior(spark, sf), "key").groupBy("decomp").agg(F.sum("n").alias("prior"))
    rows = rows.join(sums, "decomp", "left").select("word_id", "decomp", "weight", F.length(F.regexp_extract("decomp", D.PART, 2)).alias("root"), F.size(D.keys(d)).alias("n"), F.coalesce("prior", F.lit(0)).alias("prior"))
    return numbered(rows, "word_id", ["weight", F.desc("root"), "n", F.desc("prior"), "decomp"]).select("word_id", "pos", "decomp", "weight")


@R.query("SELECT id, rank, CASE WHEN rank <= 100 THEN 'top100' WHEN rank <= 1000 THEN 'top1k' WHEN rank <= 10000 THEN 'top10k' ELSE 'tail' END AS band FROM (SELECT id, row_number() OVER (ORDER BY freq DESC NULLS LAST, id) AS rank FROM words)")
def flt23_rank_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands by the rank of the frequency."""
    rows = numbered(table(spark, sf, "words").select("id", "freq", F.lit(0).alias("all")), "all", [F.desc_nulls_last("freq"), "id"], "rank")
    r = F.col("rank")
    return rows.select("id", "rank", F.when(r <= 100, "top100").when(r <= 1000, "top1k").when(r <= 10000, "top10k").otherwise("tail").alias("band"))


@R.query(f"SELECT word_id, count(*) AS runs, max(n) = 0 AS always_zero, max(n) > 0 AS ever, min(n) > 0 AS always FROM (SELECT word_id, date_trunc('day', scored_at) AS run, count_if(score > 0.7) AS n FROM ({_GOOD}) GROUP BY ALL) GROUP BY word_id")
def a29_attestation_over_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Over the days on which a word was scored: whether it never, ever or always had an analysis above the mark."""
    runs = _good(spark, sf).groupBy("word_id", F.date_trunc("day", "scored_at").alias("run")).agg(F.sum((F.col("score") > 0.7).cast("long")).alias("n"))
    return runs.groupBy("word_id").agg(F.count("*").alias("runs"), (F.max("n") == 0).alias("always_zero"), (F.max("n") > 0).alias("ever"), (F.min("n") > 0).alias("always"))


_PREDICATES = {"lenient": "p_lenient", "many_parts": "p_parts > 4", "ends_with_ending": "p_ending", "from_r2l": "p_analyzer = 'r2l'"}


@R.query(f"""
WITH gold AS (SELECT id AS word_id, decomps FROM words WHERE len(decomps) > 0), p AS (SELECT word_id, arg_max(struct_pack(d := decomp, l := lenient, n := n_parts, a := analyzer), (score, -native_rank, -cand_id)) AS x FROM ({_GOOD}) GROUP BY word_id),
j AS (SELECT NOT list_contains(decomps, x.d) AS miss, coalesce(x.l, false) AS p_lenient, x.n AS p_parts, regexp_matches(regexp_extract_all(x.d, '{_RE}', 3)[-1], '^(tn|tv|tad|tpd)-') AS p_ending, x.a AS p_analyzer FROM p JOIN gold USING (word_id))
{' UNION ALL '.join(f"SELECT '{n}' AS given, coalesce({c}, false) AS holds, count(*) AS words, count_if(miss) AS misses, round(avg(CASE WHEN miss THEN 1.0 ELSE 0.0 END), 6) AS miss_rate FROM j GROUP BY 2" for n, c in _PREDICATES.items())}""")
def a30_miss_rates_given(spark: SparkSession, sf: str) -> DataFrame:
    """How often the first analysis by score is wrong, where a predicate of it holds and where not. The first is found before the shuffle."""
    first = _good(spark, sf).groupBy("word_id").agg(F.max_by(F.struct("decomp", "lenient", "n_parts", "analyzer"), F.struct("score", -F.col("native_rank"), -F.col("cand_id"))).alias("x"))
    gold = table(spark, sf, "words").where(F.size("decomps") > 0).select(F.col("id").alias("word_id"), "decomps")
    rows = first.join(gold, "word_id").select((~F.array_contains("decomps", F.col("x.decomp"))).alias("miss"), F.coalesce("x.lenient", F.lit(False)).alias("p_lenient"), F.col("x.n_parts").alias("p_parts"), F.try_element_at(D.part_column(F.col("x.decomp"), 3), F.lit(-1)).rlike(D.ENDINGS).alias("p_ending"), F.col("x.analyzer").alias("p_analyzer"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("given"), F.coalesce(F.expr(c), F.lit(False)).alias("holds")) for n, c in _PREDICATES.items())))
    out = rows.select("miss", each.alias("x")).groupBy("x.given", "x.holds")
    return out.agg(F.count("*").alias("words"), F.sum(F.col("miss").cast("long")).alias("misses"), F.round(F.avg(F.when(F.col("miss"), 1.0).otherwise(0.0)), 6).alias("miss_rate"))
