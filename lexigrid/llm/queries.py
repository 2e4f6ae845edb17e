"""The queries of this folder's operators and the SQL to check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.script import long_signs
from lexigrid.llm import analyses, consistent, lookalikes, mixture, splits, terms, tokens, truncated
from lexigrid.llm.consistent import consistent_form
from lexigrid.plans.scripts import _SIGNS, _replaced
from lexigrid.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def _field_texts(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "pairs").select(F.lit("pairs.inuktitut").alias("field"), "id", F.col("inuktitut").alias("text"))
    return pairs.unionByName(table(spark, sf, "words").select(F.lit("words.word").alias("field"), "id", F.col("word").alias("text")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = splits.record_groups(splits.case_keys(table(spark, sf, "analyzer_cases")))
    return groups.where("size > 1").select(F.col("id").alias("case_id"), "group_id")


def _splits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf, "split_targets")
    groups = cut(splits.record_groups(splits.case_keys(table(spark, sf, "analyzer_cases"))))
    return splits.assign_splits(groups, targets), targets


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _splits(spark, sf)[0].withColumnRenamed("id", "case_id")


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_shares(*_splits(spark, sf))


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    texts = consistent_form(_field_texts(spark, sf), ["field", "id"], "text")
    return terms.marked_terms(cut(texts), "consistent")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_terms(spark, sf).where("mark IS NOT NULL").select("term", "mark")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.best_analyses(table(spark, sf, "candidates"))


def p4_words(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.replaced_decomps(table(spark, sf, "candidates"), table(spark, sf, "words"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.look_alike_pairs(_field_texts(spark, sf))


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.look_alike_classes(_field_texts(spark, sf))


def p5_forms(spark: SparkSession, sf: str) -> DataFrame:
    return consistent_form(_field_texts(spark, sf), ["field", "id"], "text")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_short(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a mixture half as large again as all documents: some sources run short, and what they lack goes to others of their domain first."""
    targets = table(spark, sf, "mix_targets").withColumn("domain", F.when(F.col("source").isin("field_notes", "analysis_notes"), "notes").when(F.col("source").isin("lessons", "school_reader", "glossary"), "teaching"))
    documents = table(spark, sf, "documents")
    sizes = tokens.count_tokens(documents.select("doc_id", "text"))
    total = 1.5 * (sizes.agg(F.sum("n_tokens")).first()[0] or 0)
    return mixture.mixture_shares(cut(mixture.mixture(documents, targets, total)), targets)


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixture_shares(cut(p8_mix(spark, sf)), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncated.judged(table(spark, sf, "documents")).where("reason IS NOT NULL").select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncated.truncation_rates(truncated.judged(table(spark, sf, "documents")))


def p1_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Records that got a split, groups in two splits, splits that got records, and whether every share is within a hundredth or one record of its target."""
    targets = table(spark, sf, "split_targets")
    groups = cut(splits.record_groups(splits.case_keys(table(spark, sf, "analyzer_cases"))))
    out = cut(splits.assign_splits(groups, targets))
    divided = out.join(groups, "id").groupBy("group_id").agg(F.countDistinct("split_name").alias("n")).agg(F.sum((F.col("n") > 1).cast("long")).alias("divided"))
    most = groups.agg(F.max("size").alias("largest"), F.count("*").alias("all"))
    shares = splits.split_shares(out, targets).crossJoin(F.broadcast(most))
    close = F.abs(F.col("share") - F.col("target_share")) <= F.greatest(F.lit(0.01), 2 / F.col("all"), F.when(F.col("largest") > 0.5 * F.col("all"), F.col("largest") / F.col("all")).otherwise(0))
    return shares.agg(F.sum("records").alias("records"), F.sum((F.col("records") > 0).cast("long")).alias("splits"), F.min(close).alias("close")).crossJoin(F.broadcast(divided))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that the ids spell."""
    return tokens.decode_texts(p7_ids(spark, sf))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Targets, documents used too often, and whether every share is as close to its target as whole documents allow: within two hundredths, or what the largest document of each of up to four languages makes up.
    """
    targets = table(spark, sf, "mix_targets")
    mixed = cut(p8_mix(spark, sf))
    over = mixed.join(F.broadcast(targets), "source").agg(F.coalesce(F.sum((F.col("copies") > F.col("max_repeats")).cast("long")), F.lit(0)).alias("overused"))
    step = mixed.agg((4 * F.max("n_tokens") / F.sum(F.col("n_tokens") * F.col("copies"))).alias("step"))
    shares = mixture.mixture_shares(mixed, targets)
    # As many rows as targets.
    shares = shares.withColumn("aim", F.col("target_share") / F.sum("target_share").over(Window.partitionBy())).crossJoin(F.broadcast(step))
    return shares.agg(F.count("*").alias("targets"), F.min(F.abs(F.col("share") - F.col("aim")) < F.greatest(F.lit(0.02), F.col("step"))).alias("close")).crossJoin(F.broadcast(over))


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents judged for each source, with those that can't be cut off as they are blank."""
    judged = truncated.judged(table(spark, sf, "documents"))
    blank = table(spark, sf, "documents").select("doc_id", (F.coalesce("text", F.lit("")).rlike(r"^[\s\p{Z}]*$")).alias("blank"))
    rows = judged.join(blank, "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("blank").cast("long")).alias("blank"), F.sum((F.col("blank") & F.col("reason").isNotNull()).cast("long")).alias("blank_and_cut"))


queries: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_shares, p1_invariants, p2_found, p2_terms, p4_found, p4_words, p5_found, p5_classes, p5_forms, p7_ids, p7_decoded, p8_mix, p8_shares, p8_short, p8_invariants, p9_found, p9_rates, p9_documents,
    )
}

_RANKED = """
WITH usable AS (
  SELECT *, row_number() OVER (PARTITION BY word_id, decomp ORDER BY score DESC, native_rank NULLS LAST, cand_id) AS k
  FROM candidates
  WHERE word_id IS NOT NULL AND decomp IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, native_rank NULLS LAST, decomp, cand_id) AS pos
  FROM usable WHERE k = 1
)
"""

_BLANK = r"[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{feff}]"
_KEYS = f"""
WITH RECURSIVE c AS (SELECT case_id AS id, nullif(lower({_replaced(f"regexp_replace(word, '^{_BLANK}+|{_BLANK}+$', '', 'g')", list(zip(_SIGNS[::2], _SIGNS[1::2], strict=True)))}), '') AS w, string_split(coalesce(all_correct_decomps, ''), ';') AS d FROM analyzer_cases),
k AS (SELECT id, 'w ' || w AS key FROM c WHERE w IS NOT NULL UNION SELECT id, 'r ' || r FROM (SELECT id, trim(regexp_extract(unnest(d), '^\\s*\\{{[^:{{}}]*:([^{{}}]*)\\}}', 1)) AS r FROM c) WHERE r <> ''),
reach(id, other) AS (SELECT id, id FROM c UNION SELECT r.id, b.id FROM reach r JOIN k a ON a.id = r.other JOIN k b ON b.key = a.key)
"""

#: What stands for what in the checks of the consistent form: wide characters, Latin look-alikes, look-alikes of signs.
_WIDE = ("".join(chr(0xFF01 + i) for i in range(94)) + "‐‑", "".join(chr(0x21 + i) for i in range(94)) + "--")
_LATIN, _SIGN = consistent._pairs(consistent.LATIN_LOOKALIKES), consistent._pairs(consistent.SIGN_LOOKALIKES)
_q = lambda x: x.replace("'", "''")


def _translated(c: str, table: dict[str, str]) -> str:
    return f"translate({c}, '{_q(''.join(table))}', '{_q(''.join(table.values()))}')"


def _form_sql(c: str) -> str:
    """The consistent form in another way: composed by the database, look-alikes word by word, dots and parts of signs by replacing."""
    dots = [(a + consistent.DOT, b) for a, b in long_signs().items()]
    inside = rf"\p{{L}}\p{{M}}<>‹›{''.join(consistent.ONLY_SIGNS)}"
    signs = rf"[\x{{1401}}-\x{{166c}}\x{{166f}}-\x{{167f}}{''.join(consistent.ONLY_SIGNS)}]"
    alike = "".join(x for x in {**_LATIN, **_SIGN} if 0x370 <= ord(x) < 0x530)
    others = f"[\\x{{370}}-\\x{{52f}}]"
    seen = f"regexp_replace({c}, '[\\p{{Cf}}{_q(consistent.UNSEEN)}]', '', 'g')"
    blanks = f"regexp_replace({seen}, '[\\p{{Zs}}\\t\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')"
    whole = f"nfc_normalize(translate({blanks}, '{_q(_WIDE[0])}', '{_q(_WIDE[1])}'))"
    word = f"CASE WHEN regexp_matches(w, '{signs}') THEN {_translated('w', _SIGN)} WHEN regexp_matches(regexp_replace(w, '[{alike}]', '', 'g'), '{others}') THEN w ELSE {_translated('w', _LATIN)} END"
    words = f"array_to_string(list_transform(regexp_extract_all({whole}, '[{inside}]+|[^{inside}]+'), lambda w: {word}), '')"
    return f"trim(regexp_replace({_replaced(f'nfc_normalize({words})', [*dots, *consistent.JOINED_SIGNS.items()])}, ' +', ' ', 'g'))"


_FORMS = f"""
WITH texts AS (SELECT 'pairs.inuktitut' AS field, id, inuktitut AS text FROM pairs UNION ALL SELECT 'words.word', id, word FROM words),
forms AS (SELECT field, id, text, {_form_sql('text')} AS form FROM texts WHERE text IS NOT NULL)
"""
_TERMS = _FORMS + """, t AS (SELECT field, id, unnest(regexp_extract_all(lower(form), '[\\p{L}\\p{M}\\p{Nd}]+')) AS term FROM forms), n AS (SELECT count(*) AS n FROM forms),
counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT (field, id)) AS records FROM t GROUP BY term),
marked AS (SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.02 * n THEN 'common' END AS mark FROM counts, n)
"""

#: The other queries have no SQL: they are tested against brute force, by invariants or on cases made by hand.
oracles: dict[str, str] = {
    "p1_found": _KEYS + "SELECT id AS case_id, min(other) AS group_id FROM reach GROUP BY id HAVING count(*) > 1",
    "p1_invariants": "SELECT (SELECT count(*) FROM analyzer_cases) AS records, (SELECT count(*) FROM split_targets) AS splits, true AS close, CAST(0 AS BIGINT) AS divided",
    "p2_terms": _TERMS + "SELECT * FROM marked",
    "p2_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_forms": _FORMS + "SELECT field, id, form AS consistent FROM forms",
    "p5_found": _FORMS + "SELECT a.field, a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.field = b.field AND a.form = b.form AND a.id < b.id AND a.text <> b.text WHERE a.text <> '' AND b.text <> ''",
    "p5_classes": _FORMS + """, s AS (SELECT field, form, text, count(*) AS n, min(id) AS least FROM forms WHERE text <> '' GROUP BY ALL), c AS (SELECT field, form, sum(n) AS a, min(least) AS class_id FROM s GROUP BY ALL HAVING count(*) > 1)
      SELECT f.field, f.id, c.class_id, CAST(c.a - s.n AS BIGINT) AS partners FROM forms f JOIN c ON c.field = f.field AND c.form = f.form JOIN s ON s.field = f.field AND s.form = f.form AND s.text = f.text""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_invariants": "SELECT (SELECT count(*) FROM mix_targets) AS targets, true AS close, CAST(0 AS BIGINT) AS overused",
    "p9_documents": r"SELECT coalesce(source, '') AS source, count(*) AS documents, count_if(regexp_matches(coalesce(text, ''), '^[\s\p{Z}]*$')) AS blank, CAST(0 AS BIGINT) AS blank_and_cut FROM documents GROUP BY 1",
    "p4_found": _RANKED + "SELECT word_id, cand_id FROM ranked WHERE pos <= 3",
    "p4_words": _RANKED
    + r"""
, new AS (SELECT word_id, list(decomp ORDER BY pos) AS decomps FROM ranked WHERE pos <= 3 GROUP BY word_id)
SELECT w.id, coalesce(n.decomps, w.decomps) AS decomps,
       CASE WHEN n.decomps IS NULL THEN w.top_decomp ELSE regexp_extract_all(n.decomps[1], '\{[^:{}]*:([^{}]*)\}', 1) END AS top_decomp
FROM words w LEFT JOIN new n ON w.id = n.word_id
""",
}
