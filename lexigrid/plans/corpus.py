"""Tokens, frequencies, the index of sentences, dictionary lookup and script conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexigrid.functions import text as X
from lexigrid.operators.lookup import concordance, longest_prefix, word_index
from lexigrid.operators.ranks import numbered
from lexigrid.plans.registry import Registry
from lexigrid.session import table

R = Registry()
_TOKENS = r"SELECT id, unnest(regexp_extract_all(lower(inuktitut), '[\p{L}\p{M}\p{N}_]+')) AS word FROM pairs"


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").select("id", F.explode(X.words(F.col("inuktitut"))).alias("word"))


@R.query(f"SELECT word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM ({_TOKENS}) GROUP BY word ORDER BY n DESC, word LIMIT 1000")
def a01_frequency_list(spark: SparkSession, sf: str) -> DataFrame:
    top = _tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(1000)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "word")))


@R.query(f"SELECT DISTINCT word, id AS pair_id FROM ({_TOKENS})")
def a02_word_index(spark: SparkSession, sf: str) -> DataFrame:
    return word_index(table(spark, sf, "pairs"), "id", "inuktitut").select("word", F.col("id").alias("pair_id"))


@R.query(f"SELECT word, row_number() OVER (ORDER BY first, word) AS word_id FROM (SELECT word, min(id) AS first FROM ({_TOKENS}) GROUP BY word)")
def a03_word_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ids in the order in which words are first seen. Ranges of words are numbered on their own and shifted by the sizes of
    those before, so that no task sees all words.
    """
    first = _tokens(spark, sf).groupBy("word").agg(F.min("id").alias("first")).withColumn("all", F.lit(0))
    return numbered(first, "all", ["first", "word"], "word_id").select("word", "word_id")


@R.query(f"""
WITH f AS (SELECT word, count(*) AS n FROM ({_TOKENS}) GROUP BY word), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM f)
SELECT top, round(CAST(sum(CASE WHEN rank <= top THEN n ELSE 0 END) AS DOUBLE) / sum(n), 8) AS coverage FROM r, (VALUES (10), (100), (1000), (10000)) t(top) GROUP BY top""")
def a33_token_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the tokens that the most frequent types cover. The types are counted by frequency, of which there are few."""
    sizes = _tokens(spark, sf).groupBy("word").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("types"))
    upto = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("types").over(upto), F.lit(0)))
    tops = spark.createDataFrame([(10,), (100,), (1000,), (10000,)], "top int")
    taken = F.greatest(F.lit(0), F.least(F.col("types"), F.col("top") - F.col("before")))
    return sizes.join(F.broadcast(tops), F.lit(True)).groupBy("top").agg(F.round(F.sum(taken * F.col("n")) / F.sum(F.col("types") * F.col("n")), 8).alias("coverage"))


_DICT = "SELECT DISTINCT lower(word) AS word FROM words WHERE word IS NOT NULL AND word <> ''"
_CONC = f"""
WITH q AS ({_DICT}), i AS (SELECT DISTINCT word, id FROM ({_TOKENS})),
hit AS (SELECT q.word, i.id, row_number() OVER (PARTITION BY q.word ORDER BY i.id) AS k FROM q JOIN i ON q.word = i.word)
SELECT DISTINCT h.word, p.inuktitut, p.english, coalesce(nullif(regexp_extract(p.source_file, '[0-9]{{8}}'), ''), p.source_file) AS date FROM hit h JOIN pairs p ON p.id = h.id WHERE k <= 20"""


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words").select(F.lower("word").alias("word")).where("word IS NOT NULL AND word <> ''").distinct()


@R.query(_CONC)
def j04_concordance(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 20 sentences of each dictionary word, the first by id, each text once, with their dates."""
    pairs = table(spark, sf, "pairs")
    hits = concordance(_dictionary(spark, sf), word_index(pairs, "id", "inuktitut"), 20)
    return hits.join(pairs, "id").select("word", "inuktitut", "english", X.date_of_source(F.col("source_file")).alias("date")).distinct()


_FALL = f"""
WITH q AS (SELECT DISTINCT word FROM ({_TOKENS})), d AS ({_DICT})
SELECT q.word, max_by(d.word, len(d.word)) AS key FROM q JOIN d ON starts_with(q.word, d.word) AND len(d.word) >= 3 AND len(d.word) < len(q.word) GROUP BY q.word"""


@R.query(_FALL)
def j03_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return longest_prefix(_tokens(spark, sf).select("word").distinct(), _dictionary(spark, sf).select(F.col("word").alias("key")))


@R.query(f"""
WITH q AS ({_DICT}), i AS (SELECT DISTINCT word FROM ({_TOKENS})), f AS (SELECT q.word, max_by(i.word, len(i.word)) AS shorter FROM q JOIN i ON starts_with(q.word, i.word) AND len(i.word) >= 3 AND len(i.word) < len(q.word) GROUP BY q.word)
SELECT q.word, CASE WHEN i.word IS NOT NULL THEN 'found' WHEN f.shorter IS NOT NULL THEN 'found_for_shorter' ELSE 'not_found' END AS status, coalesce(i.word, f.shorter) AS entry
FROM q LEFT JOIN i ON q.word = i.word LEFT JOIN f ON q.word = f.word""")
def j05_lookup_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of each dictionary word in the corpus: found, found for a shorter word, or not found."""
    q, index = _dictionary(spark, sf), _tokens(spark, sf).select("word").distinct()
    whole = index.select("word", F.col("word").alias("whole"))
    shorter = longest_prefix(q.join(index, "word", "left_anti"), index.select(F.col("word").alias("key")))
    out = q.join(whole, "word", "left").join(shorter, "word", "left")
    status = F.when(F.col("whole").isNotNull(), "found").when(F.col("key").isNotNull(), "found_for_shorter").otherwise("not_found")
    return out.select("word", status.alias("status"), F.coalesce("whole", "key").alias("entry"))


@R.query("SELECT p.id, p.english, w.id AS word_id FROM (SELECT id, english, unnest(regexp_extract_all(lower(inuktitut), '[\\p{L}\\p{M}\\p{N}_]+')) AS t FROM pairs) p JOIN (SELECT lower(word) AS t, min(id) AS id FROM words WHERE word IS NOT NULL GROUP BY 1) w ON p.t = w.t GROUP BY ALL")
def j02_first_entry_any_case(spark: SparkSession, sf: str) -> DataFrame:
    """The first dictionary row of each word whatever its case, for each sentence in which it stands."""
    first = table(spark, sf, "words").where("word IS NOT NULL").groupBy(F.lower("word").alias("t")).agg(F.min("id").alias("word_id"))
    rows = table(spark, sf, "pairs").select("id", "english", F.explode(F.array_distinct(X.words(F.col("inuktitut")))).alias("t"))
    return rows.join(first, "t").select("id", "english", "word_id").distinct()


@R.query("SELECT id, inuktitut, english FROM pairs WHERE length(inuktitut) > 0 AND length(english) > 0")
def flt04_aligned_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").where("length(inuktitut) > 0 AND length(english) > 0").select("id", "inuktitut", "english")


@R.query("SELECT id, CASE WHEN strpos(lower(english), 'the') > 0 THEN CAST(strpos(lower(english), 'the') - 1 AS BIGINT) END AS start, CASE WHEN strpos(lower(english), 'the') > 0 THEN CAST(strpos(lower(english), 'the') + 2 AS BIGINT) END AS \"end\" FROM pairs WHERE english IS NOT NULL")
def x04_highlight(spark: SparkSession, sf: str) -> DataFrame:
    hit = X.highlight(F.col("english"), F.lit("the"))
    return table(spark, sf, "pairs").where("english IS NOT NULL").select("id", hit["start"].cast("long").alias("start"), hit["end"].cast("long").alias("end"))


@R.query(r"SELECT id, CAST(len(list_filter(string_split_regex(english, '\s+'), lambda x: x <> '')) AS BIGINT) AS n FROM pairs WHERE english IS NOT NULL")
def x01_blank_separated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").where("english IS NOT NULL").select("id", F.size(X.blank_separated(F.col("english"))).cast("long").alias("n"))


@R.query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(inuktitut, '[\x{1400}-\x{167F}\x{18B0}-\x{18FF}]+')) AS w FROM pairs) GROUP BY w")
def x03_syllabic_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").select(F.explode(X.syllabic_words(F.col("inuktitut"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@R.query("SELECT id, CASE WHEN regexp_extract(word, '\\p{L}') SIMILAR TO '[A-Za-z]' THEN upper(regexp_extract(word, '\\p{L}')) END AS letter FROM words WHERE word IS NOT NULL")
def x11_first_letter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words").where("word IS NOT NULL").select("id", X.first_letter(F.col("word")).alias("letter"))


@R.query("SELECT source_file, coalesce(nullif(regexp_extract(source_file, '[0-9]{8}'), ''), source_file) AS date, count(*) AS n FROM documents WHERE source_file IS NOT NULL GROUP BY 1, 2")
def x12_source_dates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("source_file IS NOT NULL")
    return docs.groupBy("source_file", X.date_of_source(F.col("source_file")).alias("date")).agg(F.count("*").alias("n"))


_SCRIPT = r"""CASE WHEN l = '' THEN 'none' WHEN s = l THEN 'syllabic' WHEN s = '' THEN 'roman' ELSE 'mixed' END"""


@R.query(rf"""SELECT id, {_SCRIPT} AS script FROM (SELECT id, l, regexp_replace(l, '[^\x{{1400}}-\x{{167F}}\x{{18B0}}-\x{{18FF}}]', '', 'g') AS s FROM (SELECT id, regexp_replace(word, '[^\p{{L}}]|[\x{{02BC}}hH]', '', 'g') AS l FROM words WHERE word IS NOT NULL))""")
def t03_script(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words").where("word IS NOT NULL").select("id", X.script_of(F.col("word")).alias("script"))


@R.query(r"SELECT id, round(CAST(len(regexp_replace(s, '[^\x{1400}-\x{167F}]', '', 'g')) AS DOUBLE) / nullif(len(s), 0), 8) AS ratio, coalesce(CAST(len(regexp_replace(s, '[^\x{1400}-\x{167F}]', '', 'g')) AS DOUBLE) / nullif(len(s), 0) >= 0.7, false) AS syllabic FROM (SELECT id, regexp_replace(inuktitut, '\s', '', 'g') AS s FROM pairs WHERE inuktitut IS NOT NULL)")
def t04_syllabic_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = X.syllabic_ratio(F.col("inuktitut"))
    return table(spark, sf, "pairs").where("inuktitut IS NOT NULL").select("id", F.round(ratio, 8).alias("ratio"), F.coalesce(ratio >= 0.7, F.lit(False)).alias("syllabic"))


@R.query("SELECT case_id, replace(replace(word, 'nng', 'NN'), 'ng', 'N') AS simple, replace(replace(replace(replace(replace(word, 'nng', 'NN'), 'ng', 'N'), 'X', 'nng'), 'NN', 'nng'), 'N', 'ng') AS back FROM analyzer_cases WHERE word IS NOT NULL")
def t07_simplified_spelling(spark: SparkSession, sf: str) -> DataFrame:
    simple = X.simplified(F.col("word"))
    return table(spark, sf, "analyzer_cases").where("word IS NOT NULL").select("case_id", simple.alias("simple"), X.unsimplified(simple).alias("back"))


@R.query("SELECT c AS letter, translate(c, 'ptkq', 'mnNr') AS nasal, translate(c, 'ptkq', 'vlgr') AS voiced, CASE WHEN c SIMILAR TO '[aiu]' THEN 'V' WHEN c SIMILAR TO '[a-zA-Z&]' THEN 'C' ELSE '-1' END AS class, count(*) AS n FROM (SELECT unnest(string_split(lower(word), '')) AS c FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+') GROUP BY c")
def t10_letters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]+$")).select(F.explode(F.split(F.lower("word"), "")).alias("letter"))
    c = F.col("letter")
    return rows.groupBy("letter").agg(F.count("*").alias("n")).select("letter", X.nasal(c).alias("nasal"), X.voiced(c).alias("voiced"), X.letter_class(c).alias("class"), "n")


@R.query("SELECT c1 || c2 AS cluster, c2 AS second, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i])) AS c1, unnest(list_transform(range(1, len(w)), lambda i: w[i+1])) AS c2 FROM (SELECT lower(word) AS w FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+')) WHERE c1 NOT IN ('a', 'i', 'u') AND c2 NOT IN ('a', 'i', 'u') GROUP BY ALL")
def a32_consonant_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]{2,}$")).select(F.lower("word").alias("w"))
    two = rows.select(F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("cluster"))
    return two.where(F.col("cluster").rlike("^[^aiu]{2}$")).groupBy("cluster", F.substring("cluster", 2, 1).alias("second")).agg(F.count("*").alias("n"))


@R.query("SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY lang, source")
def a18_volume(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@R.query("SELECT source, id, md5 FROM (SELECT source, doc_id AS id, md5('1|' || doc_id) AS md5, row_number() OVER (PARTITION BY source ORDER BY md5('1|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 10")
def o11_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Ten documents of each source, drawn by a seeded hash."""
    rows = table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.md5(F.concat(F.lit("1|"), F.col("doc_id").cast("string"))).alias("md5"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("md5", "id"))).where("k <= 10").drop("k")


@R.query("SELECT english, count(*) AS n, min(id) AS first_id FROM pairs WHERE english IS NOT NULL GROUP BY english HAVING count(*) > 1")
def u07_repeated_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pairs").where("english IS NOT NULL").groupBy("english").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
