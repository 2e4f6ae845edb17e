"""Queries of the general operators: packed fields and rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.multivalue import packed_values
from lexigrid.operators.recover import NOUN_ENDING_FIELDS, noun_endings, typed_endings
from lexigrid.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_values(spark, sf)


def _endings(spark: SparkSession, sf: str) -> DataFrame:
    return noun_endings(table(spark, sf, "endings_noun_raw"), table(spark, sf, "ending_actions"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _endings(spark, sf).where("reason IS NOT NULL").select("line_id", "reason")


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    return _endings(spark, sf).where("reason IS NULL").select("line_id", *(f"`{n}`" for n in NOUN_ENDING_FIELDS))


def p6_typed(spark: SparkSession, sf: str) -> DataFrame:
    """The good lines as typed records: number of persons, forms and conditions of each."""
    rows = typed_endings(_endings(spark, sf).where("reason IS NULL"))
    return rows.select("line_id", "perPoss", "`V-form`", F.size("V-action1").cast("long").alias("actions"), F.expr("transform(condPrec, c -> concat(IF(c.negated, 'not ', ''), c.attr, '=', c.val))").alias("conditions"), "sources")


queries = {f.__name__: f for f in (p3_found, p6_found, p6_records, p6_typed)}


def _values(table_name: str, field: str, delimiters: str) -> str:
    d = delimiters
    pattern = rf"""(?s)"(?:[^"]|"")*"|“[^”]*”|«[^»]*»|''.*?''(?:[\s{d}]|$)|[^\s{d}]+"""
    return f"""
SELECT '{table_name}' AS table_name, row_id, '{field}' AS field, row_number() OVER (PARTITION BY row_id ORDER BY k) AS pos, val FROM (
  SELECT row_id, k, CASE WHEN v[1] = '"' THEN replace(v[2:-2], '""', '"') WHEN v[1] IN ('“', '«') THEN v[2:-2] WHEN v[1] = '''' THEN regexp_replace(v, '(?s)^''(.*)''[^'']*$', '\\1') ELSE v END AS val
  FROM (SELECT row_id, unnest(x) AS v, unnest(range(len(x))) AS k FROM (SELECT row_id, regexp_extract_all({field}, '{pattern}') AS x FROM {table_name}))
) WHERE val <> ''"""


_FIELDS = r"""
WITH parsed AS (
  SELECT line_id, line,
         regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS well,
         list_transform(regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1),
                        lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, E' \t\r\n')) AS f
  FROM endings_noun_raw
), judged AS (
  SELECT line_id, f, CASE
    WHEN line IS NULL THEN 'columns'
    WHEN NOT well THEN 'quoting'
    WHEN len(f) <> 20 THEN 'columns'
    WHEN NOT regexp_full_match(f[7], '(?:-|[aiuptkgmnsljvrq]+)(?: (?:-|[aiuptkgmnsljvrq]+))*') THEN 'v-form'
    WHEN len(string_split(f[8], ' ')) <> len(string_split(f[7], ' '))
      OR NOT list_has_all((SELECT list(code) FROM ending_actions), string_split(f[8], ' ')) THEN 'v-action1'
    WHEN f[19] <> '' AND NOT regexp_full_match(f[19], '!?[a-z0-9]+:[a-z0-9]+(?:,!?[a-z0-9]+:[a-z0-9]+)*') THEN 'condprec'
  END AS reason
  FROM parsed
)
"""

oracles = {
    "p3_found": " UNION ALL ".join(_values(*x) for x in (("locations", "variant", ",;|/"), ("undecomposable_composite_words", "combination", ",;|+{}"), ("roots_schneider", "source", ",;|/&+"), ("roots_schneider", "cf", ",;|"))),
    "p6_found": _FIELDS + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_records": _FIELDS + "SELECT line_id, " + ", ".join(f'f[{i}] AS "{n}"' for i, n in enumerate(NOUN_ENDING_FIELDS, 1)) + " FROM judged WHERE reason IS NULL",
    "p6_typed": _FIELDS
    + """SELECT line_id, TRY_CAST(f[5] AS INT) AS "perPoss", string_split(f[7], ' ') AS "V-form", CAST(len(string_split(f[8], ' ')) AS BIGINT) AS actions,
  CASE WHEN f[19] <> '' THEN list_transform(string_split(f[19], ','), lambda c: CASE WHEN c[1] = '!' THEN 'not ' ELSE '' END || replace(ltrim(c, '!'), ':', '=')) END AS conditions,
  CASE WHEN f[20] <> '' THEN list_transform(string_split(f[20], ','), lambda x: trim(x)) END AS sources
  FROM judged WHERE reason IS NULL""",
}
