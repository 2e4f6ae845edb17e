"""Records of morphemes: search, descriptions, meanings, glossary pages, prompts and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexigrid.functions import decomp as D
from lexigrid.functions import morphemes as M
from lexigrid.functions import text as X
from lexigrid.functions.script import roman_column
from lexigrid.operators.constraints import compiled
from lexigrid.operators.lookup import longest_prefix
from lexigrid.operators.ranks import numbered
from lexigrid.plans.ranking import _C, _FIRST, _GOOD, _KEYS, _RE, _c, _first, _good
from lexigrid.plans.registry import Registry
from lexigrid.session import table
from lexigrid.sources.files import lexicon_lines

R = Registry()
_TABLES = ("locations", "undecomposable_composite_words", "roots_schneider")
#: Tables of composites.
COMPOSITE = ("undecomposable_composite_words", "common_composite_words", "words_related_to_roots")
_ALL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_id, morpheme, nb, type, eng_mean, fre_mean, morpheme || '/' || coalesce(nb, '1') || type AS id FROM {t}" for t in _TABLES)


def records(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in _TABLES:
        rows = table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", "morpheme", "nb", "type", "eng_mean", "fre_mean")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("id", F.concat("morpheme", F.lit("/"), F.coalesce("nb", F.lit("1")), "type"))


def morpheme_search(rows: DataFrame, prefix: str = "", grammar: str = "", meaning: str = "", include_composite: bool = False, prefer_french: bool = False) -> DataFrame:
    """(table_name, row_id, id, meaning) of the records whose canonical form begins with prefix (whatever its case and script), whose grammar and whose English or
    French meaning contain the other texts; blank filters hold always. Records of composites only on request. The meaning is the preferred one, else the other.
    """
    begins, kinds, means = prefix.strip(), grammar.strip(), meaning.strip().lower()
    if not include_composite:
        rows = rows.where(~F.col("table_name").isin(*COMPOSITE))
    if begins:
        rows = rows.where(F.lower("morpheme").startswith(F.lower(roman_column(F.lit(begins), True))))
    if kinds:
        rows = rows.where(M.grammar(F.col("id")).contains(kinds))
    if means:
        rows = rows.where(F.coalesce(F.lower("eng_mean").contains(means), F.lit(False)) | F.coalesce(F.lower("fre_mean").contains(means), F.lit(False)))
    eng, fre = (F.nullif(F.trim(c), F.lit("")) for c in ("eng_mean", "fre_mean"))
    return rows.select("table_name", "row_id", "id", (F.coalesce(fre, eng) if prefer_french else F.coalesce(eng, fre)).alias("meaning"))


@R.query(f"SELECT table_name, row_id, id, coalesce(nullif(trim(fre_mean), ''), nullif(trim(eng_mean), '')) AS meaning FROM ({_ALL}) WHERE starts_with(lower(morpheme), 'ni') AND type = 'n' AND (coalesce(contains(lower(eng_mean), 'place'), false) OR coalesce(contains(lower(fre_mean), 'place'), false)) AND table_name <> 'undecomposable_composite_words'")
def flt01_morpheme_search(spark: SparkSession, sf: str) -> DataFrame:
    """All three tables, a prefix in syllabics, a kind of morpheme, a word of the meaning, French first."""
    return morpheme_search(records(spark, sf), "ᓂ", "noun root", "Place", prefer_french=True)


@R.query(f"SELECT table_name, row_id, table_name IN ('undecomposable_composite_words', 'common_composite_words', 'words_related_to_roots') AS composite FROM ({_ALL})")
def flt03_composites(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("table_name", "row_id", F.col("table_name").isin(*COMPOSITE).alias("composite"))


@R.query(f"SELECT row_id, table_name, row_number() OVER (ORDER BY lower(morpheme), id, table_name, row_id) AS place FROM ({_ALL}) WHERE id IS NOT NULL AND starts_with(lower(morpheme), 'k')")
def o09_search_order(spark: SparkSession, sf: str) -> DataFrame:
    """The places of the found records by lower-case canonical form and id."""
    rows = records(spark, sf).where("id IS NOT NULL").where(F.lower("morpheme").startswith("k")).select(F.lit(0).alias("all"), F.lower("morpheme").alias("low"), "id", "table_name", "row_id")
    return numbered(rows, "all", ["low", "id", "table_name", "row_id"], "place").select("row_id", "table_name", "place")


_CASES = "(transitivity IS NOT DISTINCT FROM 't')"


@R.query("SELECT row_id, asked, CASE WHEN asked IS NULL THEN true WHEN transitivity = 't' AND asked = 't' THEN true WHEN transitivity = 'i' AND (asked = 'i' OR asked = 't' AND trans_suffix = 'nil') THEN true WHEN transitivity = 't' AND antipassive IS NOT NULL AND asked = 'i' THEN true ELSE false END AS agrees FROM roots_schneider, (VALUES ('t'), ('i'), (NULL)) a(asked)")
def flt14_transitivity(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.explode(F.array(F.lit("t"), F.lit("i"), F.lit(None).cast("string")))
    rows = table(spark, sf, "roots_schneider").select("row_id", "transitivity", "antipassive", "trans_suffix", asked.alias("asked"))
    return rows.select("row_id", "asked", M.agrees(F.col("asked"), F.col("transitivity"), F.col("antipassive"), F.col("trans_suffix")).alias("agrees"))


@R.query(f"SELECT i AS id, regexp_matches(i, '^[0-9]+n$') OR regexp_matches(i, '^t[nv]-') OR regexp_matches(i, '^[0-9]*(a|e|c|q|ad|pd|p|pr)(-|$)') AS may_end FROM (SELECT DISTINCT unnest(regexp_extract_all(decomp, '{_RE}', 3)) AS i FROM ({_C}))")
def flt16_may_end_a_word(spark: SparkSession, sf: str) -> DataFrame:
    """Nouns, endings, and words that take none."""
    i = F.col("id")
    rows = _c(spark, sf).select(F.explode(D.part_column(F.col("decomp"), 3)).alias("id")).distinct()
    return rows.select("id", (i.rlike("^[0-9]+n$") | i.rlike("^t[nv]-") | i.rlike("^[0-9]*(a|e|c|q|ad|pd|p|pr)(-|$)")).alias("may_end"))


@R.query("SELECT w.id, d.n IS NOT NULL AS has_definition, d.n IS NULL AND analyzer_outcome IS DISTINCT FROM 'timed_out' AND trim(coalesce(word, '')) <> '' AS offer_guess FROM words w LEFT JOIN (SELECT lower(morpheme) AS m, count(*) AS n FROM roots_schneider WHERE trim(coalesce(eng_mean, '')) <> '' GROUP BY 1) d ON d.m = lower(split_part(w.top_decomp[1], '/', 1))")
def flt20_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a word has a definition, and whether a guess is offered: there is none, all sources have answered, and the word isn't blank."""
    defined = table(spark, sf, "roots_schneider").where("trim(coalesce(eng_mean, '')) <> ''").select(F.lower("morpheme").alias("m"), F.lit(True).alias("has")).distinct()
    rows = table(spark, sf, "words").withColumn("m", F.lower(F.substring_index(F.get("top_decomp", F.lit(0)), "/", 1))).join(defined, "m", "left")
    settled = ~F.col("analyzer_outcome").eqNullSafe("timed_out")
    return rows.select("id", F.col("has").isNotNull().alias("has_definition"), (F.col("has").isNull() & settled & (F.trim(F.coalesce("word", F.lit(""))) != "")).alias("offer_guess"))


@R.query("SELECT id, word, len(decomps) AS n, decomps[1] AS first, CAST(NULL AS VARCHAR) AS attested, list_transform(coalesce(top_decomp, []), lambda k: split_part(k, '/', 1)) AS canonicals, list_transform(coalesce(top_decomp, []), lambda k: split_part(k, '/', 2)) AS ids FROM words WHERE len(decomps) > 0")
def flt21_dictionary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the dictionary made from nested ones, with nulls for what isn't known yet."""
    rows = table(spark, sf, "words").where(F.size("decomps") > 0)
    parts = F.transform(F.coalesce("top_decomp", F.array().cast("array<string>")), lambda k: F.struct(F.substring_index(k, "/", 1).alias("canonical"), F.substring_index(k, "/", -1).alias("id")))
    rows = rows.select("id", "word", F.struct(F.size("decomps").cast("long").alias("n"), F.get("decomps", F.lit(0)).alias("first"), F.lit(None).cast("string").alias("attested"), parts.alias("parts")).alias("record"))
    return rows.select("id", "word", "record.n", "record.first", "record.attested", F.col("record.parts.canonical").alias("canonicals"), F.col("record.parts.id").alias("ids"))


@R.query(f"SELECT w.id, w.decomps, list_transform(range(1, len(w.decomps) + 1), lambda i: coalesce(list_contains(r.ranks, i - 1), false)) AS marks, CAST(coalesce(len(list_filter(r.ranks, lambda x: x < len(w.decomps))), 0) AS BIGINT) AS attested FROM words w LEFT JOIN (SELECT word_id, list(DISTINCT native_rank) AS ranks FROM ({_GOOD}) WHERE score > 0.8 AND native_rank < 50 GROUP BY word_id) r ON r.word_id = w.id WHERE len(w.decomps) > 0")
def flt22_merged_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses marked as attested by their place in a list that came back for the word; places beyond the list don't count. A list has 50 places at most."""
    replies = _good(spark, sf).where("score > 0.8 AND native_rank < 50").groupBy("word_id").agg(F.collect_set("native_rank").alias("ranks"))
    rows = table(spark, sf, "words").where(F.size("decomps") > 0).select("id", "decomps").join(replies.withColumnRenamed("word_id", "id"), "id", "left")
    marked = F.expr("transform(decomps, (d, i) -> coalesce(array_contains(ranks, i), false))")
    return rows.select("id", "decomps", marked.alias("marks"), F.coalesce(F.expr("CAST(size(filter(ranks, x -> x < size(decomps))) AS BIGINT)"), F.lit(0)).alias("attested"))


@R.query(f"SELECT table_name, row_id, CASE WHEN morpheme IS NULL OR NOT regexp_matches(morpheme, '^[a-z&]+$') THEN 'skip' WHEN type IS NULL THEN 'speculative' WHEN nb IS NULL THEN 'redundant' ELSE 'ok' END AS status FROM ({_ALL})")
def flt24_lexicon_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Which records may go to a generated lexicon: clean forms of a known kind; those without a number repeat number one."""
    clean = F.coalesce(F.col("morpheme").rlike("^[a-z&]+$"), F.lit(False))
    return records(spark, sf).select("table_name", "row_id", F.when(~clean, "skip").when(F.col("type").isNull(), "speculative").when(F.col("nb").isNull(), "redundant").otherwise("ok").alias("status"))


@R.query(f"SELECT x AS id, nullif(regexp_extract(x, '^([^/]+)/[0-9]*(.*)$', 1), '') AS canonical, regexp_extract(x, '^([^/]+)/[0-9]*(.*)$', 2) AS specs, '{{' || x || '}}' AS braced FROM (SELECT DISTINCT unnest({_KEYS}) AS x FROM ({_C}))")
def x17_id_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _c(spark, sf).select(F.explode(D.keys(F.col("decomp"))).alias("id")).distinct()
    i = F.col("id")
    return rows.select("id", M.canonical(i).alias("canonical"), M.specs(i).alias("specs"), M.braced(M.unbraced(F.concat(F.lit(" {"), i))).alias("braced"))


_T = ", ".join(f"('{a}', '{b}')" for a, b in M.TYPES.items())
_CS = ", ".join(f"('{a}', '{b}')" for a, b in M.CASES.items())
_PERSON = lambda c: f"nullif(concat_ws(' ', CASE {c}[1] WHEN '1' THEN '1st person' WHEN '2' THEN '2nd person' WHEN '3' THEN '3rd person' WHEN '4' THEN '4th person' END, CASE WHEN contains({c}, 's') THEN 'singular' WHEN contains({c}, 'd') THEN 'dual' WHEN contains({c}, 'p') THEN 'plural' END), '')"


@R.query(f"""
WITH i AS (SELECT DISTINCT unnest({_KEYS}) AS id FROM ({_C})), p AS (SELECT id, string_split(regexp_replace(split_part(id, '/', 2), '^[0-9]', ''), '-') AS a FROM i),
d AS (SELECT id, a, concat_ws(' ', CASE WHEN a[1] = 'tn' AND len(a) > 3 THEN 'possessive' WHEN a[1] = 'tv' AND len(a) > 3 THEN 'transitive' WHEN a[1] = 'tv' THEN 'intransitive' END, t.n) AS head,
  CASE WHEN a[1] IN ('tn', 'tv', 'ad', 'rad', 'pd', 'rpd') THEN CASE WHEN c.n = 'participial' AND a[-1] = 'fut' THEN 'future ' WHEN c.n = 'participial' AND a[-1] = 'prespas' THEN 'past/present ' ELSE '' END || c.n END AS cm,
  CASE WHEN a[1] IN ('tn', 'tv', 'ad', 'rad', 'pd', 'rpd') AND len(a) > 2 THEN {_PERSON('a[3]')} END AS one, CASE WHEN starts_with(a[1], 't') AND len(a) > 3 THEN {_PERSON('a[4]')} || CASE a[1] WHEN 'tn' THEN ' possessor' WHEN 'tv' THEN ' object' ELSE '' END END AS two
  FROM p LEFT JOIN (VALUES {_T}) t(k, n) ON t.k = a[1] LEFT JOIN (VALUES {_CS}) c(k, n) ON c.k = a[2])
SELECT id, concat_ws(' ', nullif(head || CASE WHEN cm IS NOT NULL OR one IS NOT NULL THEN ';' ELSE '' END, ''), cm, one) || CASE WHEN two IS NOT NULL THEN '; ' || two ELSE '' END AS grammar FROM d""")
def x18_grammar_in_words(spark: SparkSession, sf: str) -> DataFrame:
    return _c(spark, sf).select(F.explode(D.keys(F.col("decomp"))).alias("id")).distinct().select("id", M.grammar(F.col("id")).alias("grammar"))


_NOM = ", ".join(f"('{e}', '{a}', '{n}', '{b}')" for e, (a, n, b) in M.NOMINAL.items())


_VERB = ", ".join(f"('{e}', '{a.replace(chr(39), chr(39) * 2)}', '{b}')" for e, (a, b) in M.VERBAL.items())


@R.query(f"""
SELECT w.id, CASE WHEN v.ending IS NOT NULL THEN v.subject || ' ' || CASE WHEN v.pattern = 'Vs' THEN w.lemma || 's' ELSE w.lemma || v.pattern[2:] END ELSE m.before || w.lemma || CASE WHEN m.number = 'pl' THEN 's' ELSE '' END || m.behind END AS meaning
FROM (SELECT id, coalesce(list_filter(list_transform(top_decomp, lambda x: split_part(x, '/', 2)), lambda x: regexp_matches(x, '^t[nv]-'))[1], '') AS ending, split_part(top_decomp[1], '/', 1) AS lemma FROM words WHERE len(top_decomp) > 0) w
LEFT JOIN (VALUES {_NOM}) m(ending, before, number, behind) ON m.ending = w.ending LEFT JOIN (VALUES {_VERB}) v(ending, subject, pattern) ON v.ending = w.ending""")
def x20_inflected_meanings(spark: SparkSession, sf: str) -> DataFrame:
    """What a word's ending makes of its root, by the rules for nouns and verbs; null where no rule covers the ending."""
    rows = table(spark, sf, "words").where(F.size("top_decomp") > 0)
    ending = F.get(F.filter(F.transform("top_decomp", lambda x: F.substring_index(x, "/", -1)), lambda x: x.rlike(D.ENDING)), F.lit(0))
    lemma = F.substring_index(F.get("top_decomp", F.lit(0)), "/", 1)
    return rows.select("id", F.coalesce(M.verb_meaning(lemma, ending), M.noun_meaning(lemma, ending)).alias("meaning"))


#: Words that carry no content.
STOP = ["a", "an", "of", "to", "in", "the", "on", "at", "and", "or", "one", "ones", "it"]


@R.query("SELECT row_id, list_sort(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(lower(eng_mean), '[()/]', ' ', 'g'), '[^a-z''-]+'), lambda w: trim(w, '.,')), lambda w: w <> '' AND NOT list_contains(['a', 'an', 'of', 'to', 'in', 'the', 'on', 'at', 'and', 'or', 'one', 'ones', 'it'], w)))) AS words FROM roots_schneider WHERE eng_mean IS NOT NULL")
def x21_content_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "roots_schneider").where("eng_mean IS NOT NULL").select("row_id", M.content_words(F.col("eng_mean"), STOP).alias("words"))


@R.query("SELECT id, replace(replace('The word {word} means {meaning}.', '{word}', coalesce(inuktitut, '')), '{meaning}', coalesce(english, '')) AS filled, '\"' || replace(replace(coalesce(english, ''), '\\', '\\\\'), '\"', '\\\"') || '\"' AS quoted FROM pairs")
def x22_filled_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Two placeholders filled in order, and a text as it stands in JSON."""
    text = M.filled(F.lit("The word {word} means {meaning}."), {"{word}": F.col("inuktitut"), "{meaning}": F.col("english")})
    return table(spark, sf, "pairs").select("id", text.alias("filled"), F.concat(F.lit('"'), M.json_text(F.coalesce("english", F.lit(""))), F.lit('"')).alias("quoted"))


@R.query("SELECT id, array_to_string(list_filter([analyzer_outcome, r2l_error, CASE WHEN analyzer_outcome = 'crashed' THEN 'crashed' END, CASE WHEN n_decomps = 0 THEN 'nothing found' END], lambda x: x IS NOT NULL), ': ') AS raw, array_to_string(list_transform(list_filter(list_zip([analyzer_outcome, r2l_error, CASE WHEN analyzer_outcome = 'crashed' THEN 'crashed' END], [1, 2, 3]), lambda x: x[1] IS NOT NULL AND list_position([analyzer_outcome, r2l_error, CASE WHEN analyzer_outcome = 'crashed' THEN 'crashed' END], x[1]) = x[2]), lambda x: x[1]), ': ') AS chain FROM words")
def x26_cause_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Messages from the outermost to the innermost cause, each once, without nulls."""
    crashed = F.when(F.col("analyzer_outcome") == "crashed", "crashed")
    nothing = F.when(F.col("n_decomps") == 0, "nothing found")
    return table(spark, sf, "words").select("id", F.array_join(F.array_compact(F.array("analyzer_outcome", "r2l_error", crashed, nothing)), ": ").alias("raw"), M.cause_chain(F.array("analyzer_outcome", "r2l_error", crashed)).alias("chain"))


@R.query("SELECT id, coalesce(word, '?') || CASE WHEN freq IS NULL THEN '' ELSE ' (' || freq || ')' END || chr(10) || array_to_string(list_transform(range(1, least(3, coalesce(len(decomps), 0)) + 1), lambda i: i || '. ' || coalesce(decomps[i], '?') || chr(10)), '') || CASE WHEN coalesce(len(decomps), 0) > 3 THEN '…' || chr(10) ELSE '' END AS rendered FROM words")
def x27_rendered_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """A block of text of a nested result: the word, its first three analyses numbered, and a mark if there are more."""
    lines = F.expr("array_join(transform(slice(decomps, 1, 3), (d, i) -> concat(i + 1, '. ', coalesce(d, '?'), '\\n')), '')")
    head = F.concat(F.coalesce("word", F.lit("?")), F.when(F.col("freq").isNull(), "").otherwise(F.concat(F.lit(" ("), F.col("freq").cast("string"), F.lit(")"))), F.lit("\n"))
    return table(spark, sf, "words").select("id", F.concat(head, F.coalesce(lines, F.lit("")), F.when(F.coalesce(F.size("decomps"), F.lit(0)) > 3, "…\n").otherwise("")).alias("rendered"))


_LINES = "SELECT doc_id, l, i, regexp_matches(l, '^\\s*Candidate ') AS bullet FROM (SELECT doc_id, unnest(list_slice(s, 2, len(s))) AS l, unnest(range(len(s) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE source = 'analysis_notes' AND contains(text, ': {')) WHERE len(s) > 1)"


@R.query(f"SELECT doc_id, count(*) AS bullets, min(l) AS least FROM (SELECT *, count_if(NOT bullet AND trim(l) <> '') OVER (PARTITION BY doc_id ORDER BY i) AS stops FROM ({_LINES})) WHERE bullet AND stops = 0 GROUP BY doc_id")
def x23_lines_after_the_header(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a kind right after a note's first line, up to the first line of another kind."""
    rows = table(spark, sf, "documents").where("source = 'analysis_notes'").where(F.col("text").contains(": {"))
    got = X.leading_lines(F.slice(F.split("text", "\n"), F.lit(2), F.size(F.split("text", "\n"))), r"^\s*Candidate ")
    return rows.select("doc_id", F.explode(got).alias("l")).groupBy("doc_id").agg(F.count("*").alias("bullets"), F.min("l").alias("least"))


_PROMPT = "'Word: ' || coalesce(word, '?') || CASE WHEN len(decomps) > 0 THEN chr(10) || 'Decompositions:' || chr(10) || array_to_string(list_transform(range(1, least(len(decomps), 5) + 1), lambda i: i || '. ' || coalesce(decomps[i], '?')), chr(10)) ELSE '' END || CASE WHEN n > 0 THEN chr(10) || 'Examples: ' || n ELSE '' END"


@R.query(f"SELECT w.id, {_PROMPT} AS prompt FROM words w LEFT JOIN (SELECT t, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(inuktitut), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS t FROM pairs) GROUP BY t) e ON e.t = lower(w.word)")
def x24_assembled_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt for each word: numbered analyses if there are any, the number of example sentences if there are any."""
    counts = table(spark, sf, "pairs").select(F.explode(F.array_distinct(X.words(F.col("inuktitut")))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "words").withColumn("t", F.lower("word")).join(counts, "t", "left")
    numbered_ = F.expr("array_join(transform(slice(decomps, 1, 5), (d, i) -> concat(i + 1, '. ', coalesce(d, '?'))), '\\n')")
    parts = [F.concat(F.lit("Word: "), F.coalesce("word", F.lit("?"))), F.when(F.size("decomps") > 0, F.concat(F.lit("Decompositions:\n"), numbered_)), F.when(F.col("n") > 0, F.concat(F.lit("Examples: "), F.col("n").cast("string")))]
    return rows.select("id", F.concat_ws("\n", *parts).alias("prompt"))


# Glossary pages, made of the glossary texts.

_ENTRY = r"^([^ (]+) \(([^)]*)\) – (.*)$"
_CELLS = f"[regexp_extract(l, '{_ENTRY}', 1), regexp_extract(l, '{_ENTRY}', 2), regexp_extract(l, '{_ENTRY}', 3)]"
_PAGE = f"""SELECT doc_id, string_agg('<div id="romanized" class="w">' || replace(m[1], 'q', '&#113;') || '</div>' || chr(10) || '<div id="syllabic">' || m[2] || '</div> <div id="term"><b>' || replace(replace(m[3], ';', '&#x3B;'), ' to ', '&nbsp;to ') || '</b></div>', chr(10) ORDER BY i) AS html
FROM (SELECT doc_id, i, {_CELLS} AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE source = 'glossary')) WHERE m[1] <> '' GROUP BY doc_id"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("source = 'glossary'").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    part = lambda k: F.regexp_extract("l", _ENTRY, k)
    word, term = F.replace(part(1), F.lit("q"), F.lit("&#113;")), F.replace(F.replace(part(3), F.lit(";"), F.lit("&#x3B;")), F.lit(" to "), F.lit("&nbsp;to "))
    html = F.concat(F.lit('<div id="romanized" class="w">'), word, F.lit('</div>\n<div id="syllabic">'), part(2), F.lit('</div> <div id="term"><b>'), term, F.lit("</b></div>"))
    rows = rows.where(part(1) != "").select("doc_id", "i", html.alias("h"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "\n").alias("html"))


@R.query(rf"SELECT doc_id, trim(m[1]) AS word, trim(m[2]) AS syllabic, trim(m[3]) AS meaning, count(*) AS n FROM (SELECT doc_id, [regexp_extract(l, '{_ENTRY}', 1), regexp_extract(l, '{_ENTRY}', 2), regexp_extract(l, '{_ENTRY}', 3)] AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE source = 'glossary')) WHERE m[1] <> '' GROUP BY ALL")
def x08_page_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of glossary texts in HTML, read back: cells in rows, tags and entities of three kinds."""
    rows = _pages(spark, sf).select("doc_id", F.explode(M.table_rows(F.col("html"))).alias("x"))
    return rows.groupBy("doc_id", "x.word", "x.syllabic", "x.meaning").agg(F.count("*").alias("n"))


@R.query(f"SELECT doc_id, trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&#113;', 'q'), '&#x3B;', ';'), '\\s+', ' ', 'g')) AS plain FROM ({_PAGE})")
def x10_plain_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Tags as blanks, all entities decoded, white space collapsed."""
    return _pages(spark, sf).select("doc_id", M.unescaped(F.col("html")).alias("plain"))


@R.query("SELECT id, list_filter([CASE WHEN strpos(lower(english), w) > 0 THEN (strpos(lower(english), w) - 1) || '-' || (strpos(lower(english), w) - 1 + len(w)) END for w in ['the', 'committee', 'in']], lambda x: x IS NOT NULL) AS ranges FROM pairs WHERE english IS NOT NULL")
def x04_highlight_ranges(spark: SparkSession, sf: str) -> DataFrame:
    found = M.highlights(F.col("english"), F.array(*map(F.lit, ("The", "committee", " ", "in"))))
    return table(spark, sf, "pairs").where("english IS NOT NULL").select("id", F.transform(found, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))).alias("ranges"))


# Records of morphemes.

_FIRST_OF = f"SELECT id, arg_min(struct_pack(t := table_name, e := eng_mean), (k, row_id)) AS x FROM (SELECT *, CASE table_name WHEN 'roots_schneider' THEN 1 WHEN 'locations' THEN 2 ELSE 3 END AS k FROM ({_ALL}) WHERE id IS NOT NULL) GROUP BY id"


def _first_record(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(F.col("table_name") == "roots_schneider", 1).when(F.col("table_name") == "locations", 2).otherwise(3)
    return records(spark, sf).where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("table_name", "eng_mean"), F.struct(k, "row_id")).alias("x"))


@R.query(f"SELECT id, x.t AS table_name, x.e AS gloss FROM ({_FIRST_OF})")
def j19_first_glosses(spark: SparkSession, sf: str) -> DataFrame:
    """Of several tables the gloss of the first one that has the id."""
    return _first_record(spark, sf).select("id", "x.table_name", F.col("x.eng_mean").alias("gloss"))


@R.query(f"SELECT p.word_id, p.pos, p.key, r.x.t AS table_name, r.x.e AS gloss FROM (SELECT word_id, unnest(k) AS key, unnest(range(len(k))) AS pos FROM ({_FIRST})) p LEFT JOIN ({_FIRST_OF}) r ON r.id = p.key")
def j06_morpheme_records(spark: SparkSession, sf: str) -> DataFrame:
    """Each part of a word's first analysis with its dictionary record, or nulls."""
    parts = _first(spark, sf).select("word_id", F.posexplode("k").alias("pos", "key"))
    out = parts.join(_first_record(spark, sf).withColumnRenamed("id", "key"), "key", "left")
    return out.select("word_id", F.col("pos").cast("long").alias("pos"), "key", F.col("x.table_name").alias("table_name"), F.col("x.eng_mean").alias("gloss"))


@R.query(f"SELECT word_id, count(*) AS parses, list(decomp ORDER BY native_rank, cand_id)[1:3] AS first FROM ({_C}) GROUP BY word_id")
def a11_parses_by_word(spark: SparkSession, sf: str) -> DataFrame:
    """The parses of each word: their number and the first three in order, cut in each task before the shuffle."""
    order = W.partitionBy("word_id").orderBy("native_rank", "cand_id")
    top = _c(spark, sf).select("word_id", "decomp", "native_rank", "cand_id").withColumn("k", F.row_number().over(order)).where("k <= 3")
    lists = top.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "decomp"))), lambda x: x["decomp"]).alias("first"))
    return _c(spark, sf).groupBy("word_id").agg(F.count("*").alias("parses")).join(lists, "word_id")


@R.query(f"WITH s AS (SELECT word_id, cand_id, split_part({_KEYS}[1], '/', 1) AS root, 10000 * score + coalesce(w.freq, 0) AS fit, len(decomp) AS n, decomp FROM ({_GOOD}) c JOIN words w ON w.id = c.word_id WHERE NOT isinf(score)), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY fit DESC, n, decomp, cand_id) AS round FROM s) SELECT cand_id, round, row_number() OVER (ORDER BY round, fit DESC, n, decomp, cand_id) AS place FROM r QUALIFY place <= 20")
def o12_balanced_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty examples, the best of each root in turn: ten thousand times the fitness plus the frequency, then shorter, then by text. Rounds beyond the
    twentieth can't be among them, so that each root is cut to twenty in its tasks before the shuffle.
    """
    words = table(spark, sf, "words").select(F.col("id").alias("word_id"), "freq")
    rows = _good(spark, sf).where("abs(score) < double('infinity')").select("word_id", "cand_id", F.substring_index(F.get(D.keys(F.col("decomp")), F.lit(0)), "/", 1).alias("root"), "score", "decomp").join(words, "word_id")
    rows = rows.withColumn("fit", 10000 * F.col("score") + F.coalesce("freq", F.lit(0))).withColumn("n", F.length("decomp"))
    order = [F.desc("fit"), "n", "decomp", "cand_id"]
    rows = rows.withColumn("round", F.row_number().over(W.partitionBy("root").orderBy(*order))).where("round <= 20")
    top = rows.orderBy("round", *order).limit(20)
    return top.withColumn("place", F.row_number().over(W.orderBy("round", *order))).select("cand_id", "round", "place")


# Costs.

#: Prices of a million tokens, in and out; a parameter.
PRICES = {"view": (1.0, 5.0), "click": (0.25, 1.25)}


def estimated_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Null for a model without a price."""
    table_ = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.array(F.lit(a), F.lit(b)))])
    price = F.try_element_at(table_, model)
    return tokens_in / 1e6 * F.get(price, F.lit(0)) + tokens_out / 1e6 * F.get(price, F.lit(1))


_COST = "CASE event_type WHEN 'view' THEN CAST(event_id * 1 + event_id % 1000 * 5 AS DOUBLE) / 1e6 WHEN 'click' THEN CAST(event_id + event_id % 1000 * 5 AS DOUBLE) / 4e6 END"


@R.query(f"SELECT event_id, round({_COST}, 9) AS cost FROM events")
def m12_estimated_costs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(estimated_cost(F.col("event_type"), F.col("event_id"), F.col("event_id") % 1000, PRICES), 9).alias("cost"))


@R.query(f"SELECT user_id % 50 AS run, count(*) AS calls, count({_COST}) AS priced, count_if(value IS NULL OR value < 0) AS failed, round(sum({_COST}), 8) AS cost, count({_COST}) = count(*) AS sure FROM events GROUP BY 1")
def a35_costs_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated cost of each run, with the calls that have no price and those that failed; a total is sure only if every call has a price."""
    cost = estimated_cost(F.col("event_type"), F.col("event_id"), F.col("event_id") % 1000, PRICES)
    failed = F.coalesce(F.col("value") < 0, F.lit(True)).cast("long")
    return table(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("run")).agg(F.count("*").alias("calls"), F.count(cost).alias("priced"), F.sum(failed).alias("failed"), F.round(F.sum(cost), 8).alias("cost"), (F.count(cost) == F.count("*")).alias("sure"))


@R.query("SELECT event_type AS model, round(sum(CASE WHEN d >= date_trunc('day', n) THEN value ELSE 0 END), 4) AS today, round(sum(CASE WHEN d >= date_trunc('week', n) THEN value ELSE 0 END), 4) AS week, round(sum(CASE WHEN d >= date_trunc('month', n) THEN value ELSE 0 END), 4) AS month, count_if(d >= least(date_trunc('month', n), date_trunc('week', n))) AS kept FROM (SELECT event_type, value, ts - INTERVAL 5 HOUR AS d FROM events), (SELECT max(ts) - INTERVAL 5 HOUR AS n FROM events) GROUP BY 1")
def a26_costs_in_a_zone(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of each model today, this week (from Monday) and this month by the clock of a zone, and how many entries are kept when those before
    both starts are pruned.
    """
    at = lambda c: F.convert_timezone(F.lit("UTC"), F.lit("GMT-5"), F.col(c).cast("timestamp_ntz"))
    rows = table(spark, sf, "events").select("event_type", "value", at("ts").alias("d"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("d").alias("n"))))
    start = lambda p: F.date_trunc(p, "n")
    part = lambda p: F.round(F.sum(F.when(F.col("d") >= start(p), F.col("value")).otherwise(0)), 4)
    kept = F.sum((F.col("d") >= F.least(start("month"), start("week"))).cast("long"))
    return rows.groupBy(F.col("event_type").alias("model")).agg(part("day").alias("today"), part("week").alias("week"), part("month").alias("month"), kept.alias("kept"))


@R.query("SELECT event_type AS model, count(*) AS calls, round(coalesce(avg(value), 0), 6) AS mean_latency, round(coalesce(avg(event_id % 1000), 0), 6) AS mean_tokens FROM events GROUP BY 1")
def a27_running_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Mean latency and tokens of each backend, 0 without a call."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), mean(F.col("value")).alias("mean_latency"), mean(F.col("event_id") % 1000).alias("mean_tokens"))


@R.query("SELECT label, k AS component, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS spread FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY label, k")
def a34_standardisation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread of every component, by label."""
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return rows.groupBy("label", F.col("k").cast("long").alias("component")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("x").cast("double")), 6).alias("spread"))


@R.query(f"WITH a AS (SELECT word_id, decomp, loaded FROM (SELECT word_id, decomp, scored_at AS loaded, row_number() OVER (PARTITION BY word_id, decomp ORDER BY scored_at DESC, cand_id DESC) AS k FROM ({_C})) WHERE k = 1), b AS (SELECT id AS word_id, decomp, loaded_at AS loaded FROM (SELECT id, loaded_at, unnest(decomps) AS decomp FROM words) GROUP BY ALL) SELECT word_id, decomp, loaded, src FROM (SELECT *, row_number() OVER (PARTITION BY word_id, decomp ORDER BY p DESC) AS k FROM (SELECT *, 'run' AS src, 2 AS p FROM a UNION ALL SELECT *, 'dictionary', 1 FROM b)) WHERE k = 1")
def u02_merge_with_override(spark: SparkSession, sf: str) -> DataFrame:
    """Analyses of the dictionary and of the last run in one table; where both have one, the run's wins. One aggregation, no join."""
    run = _c(spark, sf).groupBy("word_id", "decomp").agg(F.max("scored_at").alias("loaded")).select("*", F.lit("run").alias("src"), F.lit(2).alias("p"))
    old = table(spark, sf, "words").select(F.col("id").alias("word_id"), F.explode("decomps").alias("decomp"), F.col("loaded_at").alias("loaded")).distinct().select("*", F.lit("dictionary").alias("src"), F.lit(1).alias("p"))
    return run.unionByName(old).groupBy("word_id", "decomp").agg(F.max_by(F.struct("loaded", "src"), "p").alias("x")).select("word_id", "decomp", "x.loaded", "x.src")


@R.query("SELECT source_file, list_transform(list_sort(list({'i': first, 'w': w})), lambda x: x.w)[1:10] AS words FROM (SELECT source_file, w, min(id * 100000 + i) AS first FROM (SELECT source_file, id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT source_file, id, regexp_extract_all(lower(english), '[\\p{L}\\p{M}\\p{N}_]+') AS x FROM pairs)) GROUP BY ALL) GROUP BY source_file")
def u07_distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten distinct words of each file in the order in which they first appear. The words are counted before the shuffle and cut to ten."""
    rows = table(spark, sf, "pairs").select("source_file", "id", F.posexplode(X.words(F.col("english"))).alias("i", "w"))
    first = rows.groupBy("source_file", "w").agg(F.min(F.col("id") * 100000 + F.col("i")).alias("first"))
    top = first.withColumn("k", F.row_number().over(W.partitionBy("source_file").orderBy("first", "w"))).where("k <= 10")
    return top.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("words"))


@R.query(f"SELECT id || ':' || regexp_replace(morpheme, '([&%])', '%\\1', 'g') || ' ' || upper(coalesce(type, 'x')) || ' ;' AS value, count(*) AS n FROM ({_ALL}) WHERE morpheme <> '' AND id IS NOT NULL GROUP BY 1")
def src29_lexicon_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a lexicon source."""
    rows = records(spark, sf).where("id IS NOT NULL").select("morpheme", "id", F.upper(F.coalesce("type", F.lit("x"))).alias("state"))
    return lexicon_lines(rows).groupBy("value").agg(F.count("*").alias("n"))


_CONDS = {"cp abc/1v": "type:v nature:zoo", "cf abc/1v": "!nb:2"}


@R.query(f"SELECT table_name, row_id, (coalesce(type = 'v', false) OR coalesce(nature = 'zoo', false)) AND NOT coalesce(nb = '1', false) OR NOT coalesce(nb = '2', false) AND coalesce(type = 'a', false) AS holds FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{t}{chr(39)} AS table_name, row_id, type, nb, nature FROM {t}' for t in _TABLES)})")
def flt12_conditions_of_others(spark: SparkSession, sf: str) -> DataFrame:
    """A condition that refers to those that other morphemes set."""
    out = None
    for t in _TABLES:
        rows = table(spark, sf, t).select(F.lit(t).alias("table_name"), "row_id", "type", "nb", "nature")
        out = rows if out is None else out.unionByName(rows)
    return out.select("table_name", "row_id", compiled("cp(abc/1v),!nb:1 cf(abc/1v),type:a", ("type", "nb", "nature"), _CONDS).alias("holds"))


@R.query("""
WITH u AS (SELECT row_id, type, root, root_type FROM undecomposable_composite_words), r AS (SELECT morpheme, arg_min(struct_pack(t := type, n := nature), row_id) AS x FROM roots_schneider WHERE morpheme IS NOT NULL GROUP BY morpheme)
SELECT u.row_id, coalesce(u.type = 'v', false) OR r.morpheme IS NOT NULL AND coalesce(r.x.t = 'v', false) AS holds FROM u LEFT JOIN r ON r.morpheme = u.root""")
def flt09_last_part(spark: SparkSession, sf: str) -> DataFrame:
    """A condition on a compound that may hold for its last part instead, which is joined by its form."""
    parts = table(spark, sf, "roots_schneider").where("morpheme IS NOT NULL").groupBy("morpheme").agg(F.min_by(F.struct("type", "nature"), "row_id").alias("x"))
    parts = parts.select(F.col("morpheme").alias("root"), F.col("morpheme").alias("last_id"), F.col("x.type").alias("last_type"))
    rows = table(spark, sf, "undecomposable_composite_words").select("row_id", "type", "root").join(parts, "root", "left")
    return rows.select("row_id", compiled("type:v", ("type",), None, "last_").alias("holds"))


_TOKENS_SQL = r"SELECT DISTINCT unnest(regexp_extract_all(lower(inuktitut), '[\p{L}\p{M}\p{N}_]+')) AS t FROM pairs"


@R.query(f"WITH g AS ({_FIRST_OF}), t AS ({_TOKENS_SQL}) SELECT w.id, x.e AS definition, CASE WHEN x.e IS NULL THEN t.t IS NOT NULL END AS in_corpus, coalesce(len(w.decomps), 0) AS analyses FROM words w LEFT JOIN (SELECT id, x FROM g WHERE x.e IS NOT NULL) d ON d.id = w.top_decomp[1] LEFT JOIN t ON t.t = lower(w.word)")
def r20_word_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """The final state of a lookup: the definition of the word's root; the corpus is asked only where there is none; the number of analyses."""
    glosses = _first_record(spark, sf).where("x.eng_mean IS NOT NULL").select(F.col("id").alias("key"), F.col("x.eng_mean").alias("definition"))
    words = table(spark, sf, "words").select("id", F.lower("word").alias("t"), F.get("top_decomp", F.lit(0)).alias("key"), F.coalesce(F.size("decomps"), F.lit(0)).cast("long").alias("analyses")).join(glosses, "key", "left")
    seen = table(spark, sf, "pairs").select(F.explode(X.words(F.col("inuktitut"))).alias("t")).distinct().withColumn("hit", F.lit(True))
    asked = words.where("definition IS NULL").join(seen, "t", "left").select("id", "definition", F.coalesce("hit", F.lit(False)).alias("in_corpus"), "analyses")
    return asked.unionByName(words.where("definition IS NOT NULL").select("id", "definition", F.lit(None).cast("boolean").alias("in_corpus"), "analyses"))


@R.query(f"WITH e AS (SELECT DISTINCT upper(m[1][1]) AS letter, trim(m[1]) AS word, min(trim(m[3])) AS meaning FROM (SELECT {_CELLS} AS m FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE source = 'glossary' AND doc_id % 7 <> 0)) WHERE regexp_matches(m[1], '^[A-Za-z]') GROUP BY ALL), q AS (SELECT id, lower(split_part(top_decomp[1], '/', 1)) AS w FROM words WHERE len(top_decomp) > 0), h AS (SELECT q.id, q.w, max_by(e.word, len(e.word)) AS word FROM q JOIN e ON starts_with(q.w, lower(e.word)) AND (len(e.word) >= 3 OR e.word = q.w) GROUP BY ALL) SELECT q.id, CASE WHEN NOT regexp_matches(q.w, '^[a-z]') THEN 'not_found' WHEN h.word IS NULL THEN 'not_found' WHEN lower(h.word) = q.w THEN 'found' ELSE 'found_for_shorter' END AS status, lower(h.word) AS entry FROM q LEFT JOIN h USING (id)")
def src17_glossary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Roots of the words looked up in the pages of the glossary by their first letters; the longest beginning counts where the whole isn't there. Pages that
    couldn't be fetched (here each seventh) have no entries.
    """
    pages = _pages(spark, sf).where("doc_id % 7 <> 0")
    entries = pages.select(F.explode(M.table_rows(F.col("html"))).alias("x")).select(F.lower("x.word").alias("key")).where(F.col("key").rlike("^[a-z]")).distinct()
    q = table(spark, sf, "words").where(F.size("top_decomp") > 0).select("id", F.lower(F.substring_index(F.get("top_decomp", F.lit(0)), "/", 1)).alias("word"))
    whole = q.join(entries.withColumnRenamed("key", "word"), "word").select("id", F.lit("found").alias("status"), F.col("word").alias("entry"))
    rest = q.join(whole.select("id"), "id", "left_anti")
    short = longest_prefix(rest.select("word").distinct(), entries)
    rest = rest.join(short, "word", "left").select("id", F.when(F.col("key").isNull(), "not_found").otherwise("found_for_shorter").alias("status"), F.col("key").alias("entry"))
    return whole.unionByName(rest)


@R.query("SELECT line_id, len(t) AS n, t[1] AS first, t[-1] AS last FROM (SELECT line_id, list_filter(regexp_extract_all(line, '(?:\"[^\"]*\"|[^,\"])+'), lambda x: x <> '') AS t FROM endings_noun_raw WHERE line IS NOT NULL)")
def x05_quoted_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens between delimiters, of which those inside of quotes don't count; empty ones are left out."""
    t = X.quoted_tokens(F.col("line"), ",")
    return table(spark, sf, "endings_noun_raw").where("line IS NOT NULL").select("line_id", F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"), F.try_element_at(t, F.lit(-1)).alias("last"))
