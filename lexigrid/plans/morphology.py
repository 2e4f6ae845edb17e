"""Actions of affixes, their forms, the word graph, composites and analysis of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import decomp as D
from lexigrid.functions import text as X
from lexigrid.functions.script import roman_column
from lexigrid.operators import analyzer as A
from lexigrid.operators.multivalue import PACKED_FIELDS, split_values
from lexigrid.operators.ranks import numbered
from lexigrid.plans.general import _FIELDS, _endings
from lexigrid.plans.general import oracles as general_sql
from lexigrid.plans.ranking import _C, _KEYS, _c
from lexigrid.plans.registry import Registry
from lexigrid.session import cut, table

R = Registry()

_ARC_ROWS = ", ".join(f"('{a}', {'NULL' if c is None else repr(c)}, '{b}')" for a, c, b in A.arcs())


@R.query(f"""
WITH RECURSIVE arcs AS (SELECT * FROM (VALUES {_ARC_ROWS}) t(state, cond, target)), reach(state, place) AS (SELECT DISTINCT state, state FROM arcs UNION SELECT r.state, a.target FROM reach r JOIN arcs a ON a.state = r.place AND a.cond IS NULL)
SELECT DISTINCT r.state, a.cond AS condition, a.target FROM reach r JOIN arcs a ON a.state = r.place WHERE a.cond IS NOT NULL""")
def r07_closed_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """The arcs of the word graph that each state reaches over arcs without a condition."""
    rows = [(s, c, t) for s, out in A.closed_arcs().items() for c, t in out]
    return spark.createDataFrame(rows, "state string, condition string, target string").distinct()


_CONTEXTS = {"V": (7, 8, 9), "t": (10, 11, 12), "k": (13, 14, 15), "q": (16, 17, 18)}


def _lists(f: int, a: int, b: int) -> str:
    blank = lambda i: f"list_filter(string_split_regex(f[{i}], '\\s+'), lambda x: x <> '')"
    return f"{blank(f)} AS fs, {blank(a)} AS a1, {blank(b)} AS a2"


_FORMS = _FIELDS + ", l AS (" + " UNION ALL ".join(f"SELECT line_id, f[1] AS morpheme, '{c}' AS context, {_lists(*i)} FROM judged WHERE reason IS NULL" for c, i in _CONTEXTS.items()) + """),
b AS (SELECT line_id, morpheme, context, CASE WHEN len(fs) = 1 AND len(a1) > 1 THEN list_transform(range(len(a1)), lambda i: fs[1]) ELSE fs END AS fs, CASE WHEN len(a1) = 1 AND len(fs) > 1 THEN list_transform(range(len(fs)), lambda i: a1[1]) ELSE a1 END AS a1, CASE WHEN len(a2) = 1 AND len(a1) = 1 AND len(fs) > 1 THEN list_transform(range(len(fs)), lambda i: a2[1]) ELSE a2 END AS a2 FROM l WHERE len(fs) > 0 AND len(a1) > 0 AND a1[1] <> '-'),
forms AS (SELECT line_id, morpheme, context, i AS pos, fs[i] AS form, a1[i] AS action1, a2[i] AS action2 FROM (SELECT *, unnest(range(1, least(len(fs), len(a1)) + 1)) AS i FROM b))
"""


def _behaviours(spark: SparkSession, sf: str) -> DataFrame:
    """Forms and actions of the good noun-ending lines, a row for each: single forms or actions stand for all of a context."""
    good = _endings(spark, sf).where("reason IS NULL")
    blank = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda x: x != "")
    per = [F.struct(F.lit(c).alias("context"), blank(f"{c}-form").alias("fs"), blank(f"{c}-action1").alias("a1"), blank(f"{c}-action2").alias("a2")) for c in _CONTEXTS]
    rows = good.select("line_id", "morpheme", F.explode(F.array(*per)).alias("x")).select("line_id", "morpheme", "x.*").where("size(fs) > 0 AND size(a1) > 0 AND a1[0] <> '-'")
    spread = {"fs": "IF(size(fs) = 1 AND size(a1) > 1, array_repeat(fs[0], size(a1)), fs)", "a1": "IF(size(a1) = 1 AND size(fs) > 1, array_repeat(a1[0], size(fs)), a1)", "a2": "IF(size(a2) = 1 AND size(a1) = 1 AND size(fs) > 1, array_repeat(a2[0], size(fs)), a2)"}
    rows = rows.select("line_id", "morpheme", "context", *(F.expr(e).alias(c) for c, e in spread.items()))
    each = F.expr("transform(sequence(1, least(size(fs), size(a1))), i -> named_struct('pos', CAST(i AS BIGINT), 'form', fs[i - 1], 'action1', a1[i - 1], 'action2', get(a2, i - 1)))")
    return rows.select("line_id", "morpheme", "context", F.explode(each).alias("x")).select("line_id", "morpheme", "context", "x.*")


@R.query(_FORMS + "SELECT * FROM forms")
def r10_forms_and_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _behaviours(spark, sf)


@R.query(_FORMS + "SELECT CASE WHEN contains(action1, '(') THEN split_part(action1, '(', 1) ELSE action1 END AS kind, nullif(regexp_extract(action1, '\\((.*)\\)$', 1), '') AS argument, count(*) AS n, count(DISTINCT line_id) AS lines FROM forms GROUP BY ALL")
def r09_action_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Action codes read into kind and argument, with how often they occur."""
    kind = F.substring_index("action1", "(", 1)
    argument = F.nullif(F.regexp_extract("action1", r"\((.*)\)$", 1), F.lit(""))
    return _behaviours(spark, sf).groupBy(kind.alias("kind"), argument.alias("argument")).agg(F.count("*").alias("n"), F.countDistinct("line_id").alias("lines"))


_MERGED = _FORMS + ", m AS (SELECT line_id, morpheme, form, action1, action2, count(DISTINCT context) FILTER (context <> 'V') = 3 AS all_c, list(DISTINCT context) AS cs FROM forms GROUP BY line_id, morpheme, form, action1, action2), merged AS (SELECT line_id, morpheme, form, action1, action2, unnest(CASE WHEN all_c THEN list_concat(['C'], list_filter(cs, lambda c: c = 'V')) ELSE cs END) AS context FROM m)"


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _behaviours(spark, sf).groupBy("line_id", "morpheme", "form", "action1", "action2").agg(F.collect_set("context").alias("cs"))
    return rows.select("line_id", "morpheme", "form", "action1", "action2", F.explode(F.expr("IF(size(array_remove(cs, 'V')) = 3, concat(array('C'), filter(cs, c -> c = 'V')), cs)")).alias("context"))


@R.query(_MERGED + " SELECT * FROM merged")
def r11_merged_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """A form that acts alike after t, k and q has one row for all consonants. At most four contexts are gathered."""
    return _merged(spark, sf)


_SURFACE = "replace(replace(CASE WHEN {a} IS NULL THEN form WHEN starts_with({a}, 'ins(') THEN regexp_extract({a}, '\\((.*)\\)$', 1) || form ELSE form END, 'nng', 'NN'), 'ng', 'N')"


@R.query(_MERGED + f" SELECT surface, count(DISTINCT morpheme) AS morphemes, count(*) AS behaviours FROM (SELECT DISTINCT surface, morpheme, line_id, context, form, action1, action2 FROM (SELECT *, {_SURFACE.format(a='action1')} AS surface FROM merged UNION ALL SELECT *, {_SURFACE.format(a='action2')} FROM merged WHERE action2 IS NOT NULL AND action2 <> '-') WHERE surface <> '-') GROUP BY surface")
def r12_surface_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The index of surface forms: what each action makes of a form, in the simplified orthography, with the morphemes that have it."""
    rows = _merged(spark, sf)
    made = lambda a: X.simplified(F.when(F.col(a).startswith("ins("), F.concat(F.regexp_extract(a, r"\((.*)\)$", 1), "form")).otherwise(F.col("form")))
    both = F.array_distinct(F.array_compact(F.array(made("action1"), F.when(F.col("action2").isNotNull() & (F.col("action2") != "-"), made("action2")))))
    out = rows.select("*", F.explode(both).alias("surface")).where("surface <> '-'")
    return out.groupBy("surface").agg(F.countDistinct("morpheme").alias("morphemes"), F.count("*").alias("behaviours"))


@R.query("SELECT row_id, morpheme, form, CAST(pos AS BIGINT) AS pos FROM (SELECT row_id, morpheme, unnest(list_concat([morpheme], list_filter(string_split_regex(coalesce(trim(variant), ''), '\\s+'), lambda x: x <> ''))) AS form, unnest(range(1 + len(list_filter(string_split_regex(coalesce(trim(variant), ''), '\\s+'), lambda x: x <> '')))) AS pos FROM roots_schneider WHERE morpheme IS NOT NULL)")
def r13_root_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each root's canonical form (place 0) and each of its variants."""
    forms = F.concat(F.array("morpheme"), X.blank_separated(F.coalesce(F.trim("variant"), F.lit(""))))
    rows = table(spark, sf, "roots_schneider").where("morpheme IS NOT NULL").select("row_id", "morpheme", F.posexplode(forms).alias("pos", "form"))
    return rows.select("row_id", "morpheme", "form", F.col("pos").cast("long").alias("pos"))


#: The edits that turn a shown stem into what an action may have acted on; each is tested by the action itself.
_V, _UNVOICED = "aiu", {"voice": ("vlgr", "ptkq"), "nasal": ("mnNr", "ptkq")}


def stems_before(shown: Column, action: Column) -> Column:
    """Array of the stems that an action code turns into shown; the column form of operators.analyzer.stems_before for the codes of the table."""
    last, rest = F.substring(shown, -1, 1), F.expr("substring({0}, 1, length({0}) - 1)".replace("{0}", "shown"))
    vowel = last.rlike("^[aiu]$")
    of = lambda kind: F.translate(last, *_UNVOICED[kind])
    inner = F.regexp_extract(action, r"\((.*)\)$", 1)
    none = F.array().cast("array<string>")
    twice = F.expr("substring(shown, -1, 1) = substring(shown, -2, 1) AND length(shown) > 1")
    return (
        F.when(action == "keep", F.array(shown))
        .when(action == "drop", F.transform(F.array(*map(F.lit, "ptkqgmnNsljvr")), lambda c: F.concat(shown, c)))
        .when(action == "dropv", F.transform(F.array(*map(F.lit, _V)), lambda c: F.concat(shown, c)))
        .when(action == "nasal", F.when(last.rlike("^[mnNr]$"), F.array(F.concat(rest, of("nasal")))).otherwise(none))
        .when(action == "voice", F.when(last.rlike("^[vlgr]$"), F.array(F.concat(rest, of("voice")))).otherwise(none))
        .when(action == "vdup", F.when(vowel & twice, F.array(rest)).otherwise(none))
        .when(action == "gem", F.when(~vowel & twice, F.array(rest)).otherwise(none))
        .when(action.startswith("ins("), F.when(F.endswith(shown, inner) & (F.length(shown) > F.length(inner)), F.array(F.expr("substring(shown, 1, length(shown) - length(regexp_extract(action1, '\\\\((.*)\\\\)$', 1)))"))).otherwise(none))
        .otherwise(none)
    )


@R.query(_FORMS + r"""
, e AS (SELECT DISTINCT form, action1 FROM forms WHERE context = 'V' AND form <> '-'), w AS (SELECT DISTINCT replace(replace(lower(word), 'nng', 'NN'), 'ng', 'N') AS w FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+'),
h AS (SELECT w, form, action1, w[1:len(w) - len(form)] AS p FROM w JOIN e ON ends_with(w, replace(replace(form, 'nng', 'NN'), 'ng', 'N')) AND len(w) > len(form) WHERE NOT contains(form, 'ng'))
SELECT w AS word, form, action1 AS action, unnest(CASE WHEN action1 = 'keep' THEN [p] WHEN action1 = 'drop' THEN list_transform(string_split('ptkqgmnNsljvr', ''), lambda c: p || c) WHEN action1 = 'dropv' THEN [p || 'a', p || 'i', p || 'u']
  WHEN action1 = 'nasal' AND regexp_matches(p, '[mnNr]$') THEN [p[:-2] || translate(p[-1], 'mnNr', 'ptkq')] WHEN action1 = 'voice' AND regexp_matches(p, '[vlgr]$') THEN [p[:-2] || translate(p[-1], 'vlgr', 'ptkq')]
  WHEN action1 = 'vdup' AND regexp_matches(p, '(aa|ii|uu)$') THEN [p[:-2]] WHEN action1 = 'gem' AND len(p) > 1 AND p[-1] = p[-2] AND NOT regexp_matches(p, '[aiu]$') THEN [p[:-2]]
  WHEN starts_with(action1, 'ins(') AND ends_with(p, regexp_extract(action1, '\((.*)\)$', 1)) AND len(p) > 1 THEN [p[:-2]] ELSE [] END) AS stem FROM h""")
def r08_stems_before_endings(spark: SparkSession, sf: str) -> DataFrame:
    """What may stand before the endings of the case words, by their actions after vowels; endings meet words by their last letters."""
    ends = _behaviours(spark, sf).where("context = 'V' AND form <> '-' AND NOT contains(form, 'ng')").select("form", "action1").distinct()
    words = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]+$")).select(X.simplified(F.lower("word")).alias("word")).distinct()
    cuts = words.where(F.length("word") > 1).select("word", F.explode(F.expr("sequence(1, length(word) - 1)")).alias("i")).select("word", F.expr("substring(word, 1, i)").alias("shown"), F.expr("substring(word, i + 1)").alias("form"))
    return cuts.join(ends, "form").select("word", "form", F.col("action1").alias("action"), F.explode(stems_before(F.col("shown"), F.col("action1"))).alias("stem"))


_COMPOSITES = f"SELECT id, list(val ORDER BY pos) AS parts FROM (SELECT morpheme || '/' || coalesce(nb, '1') || type AS id, row_id FROM undecomposable_composite_words WHERE morpheme IS NOT NULL AND type IS NOT NULL) u JOIN ({general_sql['p3_found']}) v ON v.table_name = 'undecomposable_composite_words' AND v.row_id = u.row_id GROUP BY id, u.row_id UNION SELECT x, [x, x] FROM (SELECT DISTINCT unnest({_KEYS}) AS x FROM ({_C}))"


@R.query(f"""
WITH c AS ({_COMPOSITES}), k AS (SELECT word_id, cand_id, {_KEYS} AS keys FROM ({_C})),
h AS (SELECT k.*, c.id, c.parts, i FROM (SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM k) k JOIN c ON c.parts[1] = keys[i] AND keys[i:i + len(c.parts) - 1] = c.parts),
g AS (SELECT word_id, cand_id, array_to_string(list_concat(list_concat(keys[:i - 1], [id]), keys[i + len(parts):]), '|') AS other, array_to_string(keys, '|') AS own FROM h)
SELECT cand_id FROM k WHERE cand_id NOT IN (SELECT g.cand_id FROM g JOIN (SELECT DISTINCT word_id, array_to_string(keys, '|') AS t FROM k) o ON o.word_id = g.word_id AND o.t = g.other WHERE g.other <> g.own)""")
def m13_composites_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates without those that spell out a composite which another one of the word has as a whole; the same morpheme twice counts as itself."""
    spec = next(s for s in PACKED_FIELDS if s.name == "combination")
    rows = table(spark, sf, "undecomposable_composite_words")
    parts = split_values(rows, spec).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda x: x["val"]).alias("parts"))
    own = rows.where("morpheme IS NOT NULL AND type IS NOT NULL").select("row_id", F.concat("morpheme", F.lit("/"), F.coalesce("nb", F.lit("1")), "type").alias("id"))
    keys = _c(spark, sf).select("word_id", "cand_id", D.keys(F.col("decomp")).alias("keys"))
    twice = keys.select(F.explode("keys").alias("id")).distinct().select("id", F.array("id", "id").alias("parts"))
    return A.collapsed(keys, own.join(parts, "row_id").select("id", "parts").unionByName(twice)).select("cand_id")


#: The suffixes of the invented language that the tables are written in.
SUFFIXES = """
gavut/tn-acc-d gi/tn-gen-d gija/1nn git/tn-loc-p givak/2nn ja/tn-dat-p japup/tv-caus-3s jatuk/1nv ji/1nv jigi/1vv jitak/1nn la/3vv lagiq/1vv li/1vv
li/tv-ger-1s ligit/tv-dec-2s lik/tn-dat-d lipu/2vv lu/2vv luk/3vv ma/3vv mamit/3vv mi/tv-int-4s mu/3vv mupit/1nv mupuk/2vv na/3vv na/tn-gen-d nagi/2vv
nagit/3vv nak/tv-int-4s naq/1vv natu/1vv ni/tn-sim-d nik/1nn nu/1vv nu/tn-loc-p nun/tv-ger-1s nuni/tn-abl-p-1s nupup/tn-gen-p pa/3vv pa/tv-caus-3s
pagit/1nn pani/tv-int-4s pap/tn-via-p pi/tv-dec-2s pimap/tv-ger-1s pu/tn-acc-p pujat/2vv pula/tn-nom-d-1s punuk/tn-nom-p-1s put/tn-via-d sagu/2nn sat/1nv
situt/tn-abl-d-1s su/tn-loc-d suk/2nn suq/3vv sut/2vv tava/tn-abl-d-1s ti/1vv tipu/2vv tipuq/1nn tiq/1nn tuta/1nn tutit/1vv vak/2vv vat/tn-acc-p
vavak/2nn vinut/1nv viq/1vn visuq/1vv vit/2nn vut/tn-sim-p
""".split()


def invented_affixes() -> list[A.Affix]:
    """Each suffix stands behind a whole stem, or behind one whose last letter it has taken."""
    return [A.Affix(c, i, (A.Behaviour(c), A.Behaviour(c, action="dropl"))) for c, i in (x.split("/") for x in SUFFIXES)]


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    roman = F.lower(roman_column(F.trim("word"), True))
    return table(spark, sf, "analyzer_cases").withColumn("roman", roman).where(F.col("roman").rlike("^[a-z]+$"))


def _roots(cases: DataFrame) -> DataFrame:
    first = cases.select(F.explode(F.split("all_correct_decomps", ";")).alias("d")).select(F.regexp_extract("d", r"^\s*\{[^:{}]*:([^/{}]*)/([0-9]+[a-z]+)\}", 1).alias("canonical"), F.regexp_extract("d", r"^\s*\{[^:{}]*:([^/{}]*)/([0-9]+[a-z]+)\}", 2).alias("identifier"))
    return first.where("identifier <> ''").distinct()


@R.query()
def r01_decompositions(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of the case words along the word graph, over the roots of the cases' own lists."""
    cases = cut(_cases(spark, sf))
    return A.analyses(cases.select(F.col("roman").alias("word")), _roots(cases), invented_affixes(), lenient=True, seconds=10)


@R.query()
def r02_listed_analyses_found(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the search, with affixes in any order, finds an analysis that is listed for the case; surfaces don't count."""
    cases = cut(_cases(spark, sf))
    got = A.analyses(cases.select(F.col("roman").alias("word")), _roots(cases), invented_affixes(), A.ANY_ORDER, seconds=10).select(F.col("word").alias("roman"), F.explode("decomps").alias("d"))
    got = got.select("roman", D.without_surfaces(F.col("d")).alias("bare")).distinct().withColumn("hit", F.lit(True))
    listed = cases.select("case_id", "roman", F.explode(F.split("all_correct_decomps", ";")).alias("d")).select("case_id", "roman", D.without_surfaces(F.trim("d")).alias("bare")).where("bare <> ''")
    return listed.join(got, ["roman", "bare"], "left").groupBy("case_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("found"))


_PROBES = "SELECT DISTINCT unnest([right(w, 3), right(w, 2) || 't', right(w, 2) || 'k', right(w, 2) || 'q', right(w, 2) || 'p']) AS probe FROM (SELECT DISTINCT replace(replace(lower(word), 'nng', 'NN'), 'ng', 'N') AS w FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+') WHERE len(w) > 3"


def expanded(ends: Column) -> Column:
    """A form as it is, or, where it ends with a star, with each consonant that may be missing there."""
    return F.when(ends.endswith("*"), F.transform(F.array(*map(F.lit, "tkqp")), lambda c: F.concat(F.regexp_replace(ends, r"\*$", ""), c))).otherwise(F.array(ends))


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]+$")).select(X.simplified(F.lower("word")).alias("w")).where(F.length("w") > 3)
    both = F.array(F.expr("right(w, 3)"), F.concat(F.expr("right(w, 2)"), F.lit("*")))
    return words.select(F.explode(both).alias("p")).select(F.explode(expanded(F.col("p"))).alias("probe")).distinct()


@R.query(_MERGED + f" SELECT p.probe, m.morpheme, count(*) AS behaviours FROM ({_PROBES}) p JOIN (SELECT *, {_SURFACE.format(a='action1')} AS surface FROM merged) m ON m.surface = p.probe GROUP BY ALL")
def j08_affixes_by_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of the case words, also with a missing consonant, with the affixes that have them as a surface form."""
    made = X.simplified(F.when(F.col("action1").startswith("ins("), F.concat(F.regexp_extract("action1", r"\((.*)\)$", 1), "form")).otherwise(F.col("form")))
    index = _merged(spark, sf).select("morpheme", made.alias("probe"))
    return _probes(spark, sf).join(index, "probe").groupBy("probe", "morpheme").agg(F.count("*").alias("behaviours"))


@R.query(r"""
WITH r AS (SELECT DISTINCT regexp_extract(d, '^\s*\{[^:{}]*:([^/{}]*)/([0-9]+[a-z]+)\}', 1) AS c, regexp_extract(d, '^\s*\{[^:{}]*:([^/{}]*)/([0-9]+[a-z]+)\}', 2) AS i FROM (SELECT unnest(string_split(all_correct_decomps, ';')) AS d FROM analyzer_cases)),
s AS (SELECT DISTINCT w, unnest(CASE WHEN regexp_matches(p, '[aiu]$') THEN [p, p || 't', p || 'k', p || 'q', p || 'p'] ELSE [p] END) AS stem FROM (SELECT w, unnest(list_transform(range(3, len(w) + 1), lambda k: w[1:k])) AS p FROM (SELECT DISTINCT lower(word) AS w FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+')))
SELECT s.w AS word, s.stem, r.i AS identifier FROM s JOIN r ON r.c = s.stem WHERE r.i <> ''""")
def j09_roots_by_form(spark: SparkSession, sf: str) -> DataFrame:
    """Beginnings of the case words, with a missing consonant after a vowel, with the roots of that canonical form."""
    cases = table(spark, sf, "analyzer_cases")
    words = cases.where(F.col("word").rlike("^[A-Za-z]+$")).select(F.lower("word").alias("word")).distinct().where(F.length("word") > 2)
    begins = words.select("word", F.explode(F.expr("transform(sequence(3, length(word)), k -> substring(word, 1, k))")).alias("p"))
    # The consonant is taken off the roots, which are fewer than the beginnings.
    c = F.col("canonical")
    short = F.substring(c, -1, 1).isin(*"tkqp") & F.substring(c, -2, 1).isin(*"aiu")
    roots = _roots(cases).select("canonical", "identifier", F.explode(F.when(short, F.array(c, F.expr("left(canonical, length(canonical) - 1)"))).otherwise(F.array(c))).alias("p"))
    # Never broadcast: both sides grow with the cases, and the optimizer takes the beginnings for as few as the words.
    return begins.join(roots.hint("merge"), "p").select("word", F.col("canonical").alias("stem"), "identifier").distinct()


@R.query("SELECT id, row_number() OVER (ORDER BY freq DESC NULLS LAST, id) AS rank FROM words WHERE word IS NOT NULL")
def o10_merged_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of the dictionary, worked on apart, merged by rank: ranges of ranks are numbered on their own."""
    rows = table(spark, sf, "words").where("word IS NOT NULL").select("id", "freq")
    shards = [rows.where(F.col("id") % 4 == k) for k in range(4)]
    merged = shards[0]
    for s in shards[1:]:
        merged = merged.unionByName(s)
    return numbered(merged.withColumn("all", F.lit(0)), "all", [F.desc_nulls_last("freq"), "id"], "rank").select("id", "rank")


@R.query("SELECT id, sha256('{\"word\":\"' || lower(word) || '\",\"most\":10,\"lenient\":' || coalesce(top_decomp_is_lenient, false) || '}') AS key FROM words WHERE word SIMILAR TO '[A-Za-z]+'")
def m18_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the settings with which a word was looked up."""
    setting = F.struct(F.lower("word").alias("word"), F.lit(10).alias("most"), F.coalesce("top_decomp_is_lenient", F.lit(False)).alias("lenient"))
    return table(spark, sf, "words").where(F.col("word").rlike("^[A-Za-z]+$")).select("id", F.sha2(F.to_json(setting), 256).alias("key"))
