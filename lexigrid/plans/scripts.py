"""Scripts and dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import script as S
from lexigrid.functions import text as X
from lexigrid.operators import dialect
from lexigrid.plans import corpus
from lexigrid.plans.registry import Registry
from lexigrid.session import table

R = Registry()
#: Each sign with its Roman spelling, written out for the checks.
_SIGNS = """
ᐃ i ᐱ pi ᑎ ti ᑭ ki ᒋ gi ᒥ mi ᓂ ni ᓯ si ᓕ li ᔨ ji ᕕ vi ᕆ ri ᕿ qi ᖏ ngi ᙱ nngi ᖠ &i
ᐅ u ᐳ pu ᑐ tu ᑯ ku ᒍ gu ᒧ mu ᓄ nu ᓱ su ᓗ lu ᔪ ju ᕗ vu ᕈ ru ᖁ qu ᖑ ngu ᙳ nngu ᖢ &u
ᐊ a ᐸ pa ᑕ ta ᑲ ka ᒐ ga ᒪ ma ᓇ na ᓴ sa ᓚ la ᔭ ja ᕙ va ᕋ ra ᖃ qa ᖓ nga ᙵ nnga ᖤ &a
ᐄ ii ᐲ pii ᑏ tii ᑮ kii ᒌ gii ᒦ mii ᓃ nii ᓰ sii ᓖ lii ᔩ jii ᕖ vii ᕇ rii ᖀ qii ᖐ ngii ᙲ nngii ᖡ &ii
ᐆ uu ᐴ puu ᑑ tuu ᑰ kuu ᒎ guu ᒨ muu ᓅ nuu ᓲ suu ᓘ luu ᔫ juu ᕘ vuu ᕉ ruu ᖂ quu ᖒ nguu ᙴ nnguu ᖣ &uu
ᐋ aa ᐹ paa ᑖ taa ᑳ kaa ᒑ gaa ᒫ maa ᓈ naa ᓵ saa ᓛ laa ᔮ jaa ᕚ vaa ᕌ raa ᖄ qaa ᖔ ngaa ᙶ nngaa ᖥ &aa
ᑉ p ᑦ t ᒃ k ᒡ g ᒻ m ᓐ n ᔅ s ᓪ l ᔾ j ᕝ v ᕐ r ᖅ q ᖕ ng ᖖ nng ᖦ & ᕼ h
ᐯ pai ᑌ tai ᑫ kai ᒉ gai ᒣ mai ᓀ nai ᓭ sai ᓓ lai ᔦ jai ᕓ vai ᕃ rai ᙯ qai ᙰ ngai
""".split()
_JOINS = [(f + a, k + b) for f, k, x, y in (("ᕐ", "", "ᑭᑯᑲᑮᑰᑳᑫ", "ᕿᖁᖃᖀᖂᖄᙯ"), ("ᖅ", "ᖅ", "ᑭᑯᑲᑮᑰᑳᑫ", "ᕿᖁᖃᖀᖂᖄᙯ"), ("ᖕ", "", "ᒋᒍᒐᒌᒎᒑᒉ", "ᖏᖑᖓᖐᖒᖔᙰ")) for a, b in zip(x, y, strict=True)]


def _replaced(column: str, pairs: list[tuple[str, str]]) -> str:
    items = ", ".join("{'a': '" + a + "', 'b': '" + b + "'}" for a, b in pairs)
    return f"list_reduce(list_prepend({{'a': {column}, 'b': ''}}, [{items}]), lambda s, x: {{'a': replace(s.a, x.a, x.b), 'b': ''}}).a"


def _roman_sql(column: str) -> str:
    return _replaced(column, [*_JOINS, *zip(_SIGNS[::2], _SIGNS[1::2], strict=True)])


def _syllabic_sql(column: str) -> str:
    spelt = {b: a for a, b in zip(_SIGNS[::2], _SIGNS[1::2], strict=True) if not b.endswith("ai")}
    code = lambda b: b.replace("nng", "X").replace("ng", "N")
    pairs = [("nng", "X"), ("ng", "N"), ("rq", "Q"), ("qq", "Q"), ("b", "p"), ("d", "t"), ("h", "s"), ("H", "ᕼ")]
    pairs += [("Q" + v, "ᖅ" + spelt["k" + v]) for v in ("ii", "uu", "aa", "i", "u", "a")] + [("Q", "ᖅ")]
    own = sorted(((code(b), a) for b, a in spelt.items() if b != "h"), key=lambda x: -len(x[0]))
    return _replaced(column, pairs + own)


_SCRIPT = lambda c: rf"""CASE WHEN regexp_replace({c}, '[^\p{{L}}]|[\x{{02BC}}hH]', '', 'g') = '' THEN 'none' WHEN regexp_matches({c}, '[\x{{1400}}-\x{{167F}}\x{{18B0}}-\x{{18FF}}]') THEN CASE WHEN regexp_matches(regexp_replace({c}, '[\x{{02BC}}hH\x{{1400}}-\x{{167F}}\x{{18B0}}-\x{{18FF}}]', '', 'g'), '\p{{L}}') THEN 'mixed' ELSE 'syllabic' END ELSE 'roman' END"""


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "words").where("word IS NOT NULL").select("id", "word", X.script_of(F.col("word")).alias("script"))


@R.query(f"SELECT id, {_roman_sql('word')} AS roman FROM words WHERE word IS NOT NULL")
def t01_roman_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return _words(spark, sf).select("id", S.roman_column(F.col("word"), True).alias("roman"))


@R.query(f"SELECT case_id, {_syllabic_sql('lower(word)')} AS syllabic FROM analyzer_cases WHERE word IS NOT NULL")
def t02_syllabic_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "analyzer_cases").where("word IS NOT NULL").select("case_id", S.syllabic_column(F.lower("word")).alias("syllabic"))


_RATIO = r"CAST(len(regexp_replace(word, '[^\x{1400}-\x{167F}]', '', 'g')) AS DOUBLE) / nullif(len(regexp_replace(word, '\s', '', 'g')), 0)"


@R.query(f"SELECT id, CASE WHEN {_RATIO} > 0.7 THEN {_roman_sql('word')} ELSE word END AS as_roman, CASE WHEN {_RATIO} < 0.7 THEN {_syllabic_sql('word')} ELSE word END AS as_syllabic FROM words WHERE word IS NOT NULL")
def t04_conversion_at_the_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Converted only where more, or less, than 0.7 of the characters that aren't blank are syllabic; a blank text stays."""
    w, ratio = F.col("word"), X.syllabic_ratio(F.col("word"))
    return _words(spark, sf).select("id", F.when(ratio > 0.7, S.roman_column(w, True)).otherwise(w).alias("as_roman"), F.when(ratio < 0.7, S.syllabic_column(w)).otherwise(w).alias("as_syllabic"))


@R.query(f"SELECT id, script, CASE WHEN script = 'roman' THEN word ELSE {_roman_sql('word')} END AS roman, CASE WHEN script = 'syllabic' THEN word ELSE {_syllabic_sql('word')} END AS syllabic, CASE WHEN script = 'syllabic' THEN {_roman_sql('word')} ELSE {_syllabic_sql('word')} END AS other FROM (SELECT id, word, {_SCRIPT('word')} AS script FROM words WHERE word IS NOT NULL)")
def t05_ensured_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Each word in Roman letters, in syllabics and in the script other than its own."""
    w, s = F.col("word"), F.col("script")
    other = F.when(s == "syllabic", "roman").otherwise("syllabic")
    return _words(spark, sf).select("id", "script", S.in_script(w, F.lit("roman"), s).alias("roman"), S.in_script(w, F.lit("syllabic"), s).alias("syllabic"), S.in_script(w, other, s).alias("other"))


@R.query(f"SELECT id, CASE WHEN script = 'syllabic' THEN word || ' (' || {_roman_sql('word')} || ')' ELSE CASE WHEN script = 'roman' THEN word ELSE {_roman_sql('word')} END || ' (' || {_syllabic_sql('word')} || ')' END AS as_entered FROM (SELECT id, word, {_SCRIPT('word')} AS script FROM words WHERE word IS NOT NULL)")
def t06_both_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """A word in the script that it was entered in, followed by the other one; mixed ones count as Roman."""
    w, s = F.col("word"), F.col("script")
    first = F.when(s == "syllabic", "syllabic").otherwise("roman")
    second = F.when(s == "syllabic", "roman").otherwise("syllabic")
    return _words(spark, sf).select("id", F.concat(S.in_script(w, first, s), F.lit(" ("), S.in_script(w, second, s), F.lit(")")).alias("as_entered"))


@R.query(f"SELECT case_id, regexp_replace(replace(lower({_roman_sql('word')}), 'h', 'H'), '([iua])qk([iua])', '\\1qq\\2', 'g') AS looked_up FROM analyzer_cases WHERE word IS NOT NULL")
def t09_search_input(spark: SparkSession, sf: str) -> DataFrame:
    """Syllabics are converted first, then letters lowered but for H, and qk between vowels written qq."""
    return table(spark, sf, "analyzer_cases").where("word IS NOT NULL").select("case_id", X.search_input(S.roman_column(F.col("word"), True)).alias("looked_up"))


_SIMPLE = "SELECT case_id, replace(replace(lower(word), 'nng', 'NN'), 'ng', 'N') AS w FROM analyzer_cases WHERE word SIMILAR TO '[A-Za-z]+'"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in dialect.pairs())
_STEP = lambda rows: f"SELECT DISTINCT case_id, substr(v, 1, i - 1) || b || substr(v, i + 2) AS v FROM (SELECT case_id, v, unnest(range(1, len(v))) AS i FROM ({rows})) JOIN (VALUES {_PAIRS}) p(a, b) ON substr(v, i, 2) = a"
_ZERO = f"SELECT DISTINCT case_id, w AS v FROM ({_SIMPLE})"


@R.query(f"WITH one AS ({_STEP(_ZERO)}), two AS ({_STEP('SELECT * FROM one')}) SELECT case_id, v AS variant, CAST(min(s) AS INT) AS steps FROM (SELECT *, 0 AS s FROM ({_ZERO}) UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY case_id, v")
def m15_dialect_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """All spellings of the case words within two replacements of equivalent consonant groups."""
    rows = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]+$")).select("case_id", X.simplified(F.lower("word")).alias("w"))
    return dialect.spellings(rows, "case_id", "w")


@R.query(f"SELECT g.a AS written, p.b AS equivalent, count(DISTINCT case_id) AS words FROM (SELECT case_id, substr(w, i, 2) AS a FROM (SELECT case_id, w, unnest(range(1, len(w))) AS i FROM ({_SIMPLE}))) g JOIN (VALUES {_PAIRS}) p(a, b) ON p.a = g.a GROUP BY ALL")
def r14_equivalent_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Consonant groups of the case words with each equivalent and the number of words that have them."""
    rows = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]{2,}$")).select("case_id", X.simplified(F.lower("word")).alias("w"))
    at = rows.where(F.length("w") > 1).select("case_id", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("written"))
    groups = spark.createDataFrame(dialect.pairs(), "written string, equivalent string")
    return at.join(F.broadcast(groups), "written").groupBy("written", "equivalent").agg(F.countDistinct("case_id").alias("words"))


@R.query(f"""
WITH c AS (SELECT DISTINCT cluster[1] AS first, second FROM ({{a32}})),
w AS (SELECT case_id, w, unnest(range(2, len(w))) AS pos FROM ({_SIMPLE}) WHERE len(w) > 2)
SELECT case_id, pos, substr(w, 1, pos - 1) || first || substr(w, pos) AS candidate FROM w JOIN c ON c.second = w[pos]
WHERE regexp_matches(w[pos - 1], '[aiu]') AND regexp_matches(w[pos], '{dialect.CONSONANT}') AND regexp_matches(w[pos + 1], '[aiu]') AND regexp_matches(substr(w, 1, pos - 1), '{dialect.CONSONANT}{dialect.CONSONANT}[aiu]+$')""".replace("{a32}", corpus.R.oracles["a32_consonant_clusters"]))
def r15_restored_consonants(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings with the consonant that the law of double groups may have dropped, from the groups that the words have."""
    rows = table(spark, sf, "analyzer_cases").where(F.col("word").rlike("^[A-Za-z]+$")).select("case_id", X.simplified(F.lower("word")).alias("w"))
    return dialect.restored(rows, "case_id", "w", corpus.a32_consonant_clusters(spark, sf))
