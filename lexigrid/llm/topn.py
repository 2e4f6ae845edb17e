"""The N best rows of each group by bisecting the groups' cutoffs, all at once.

The order is a sequence of integer codes, smaller first. Each pass counts, for each group, the rows in the cells between
CELLS - 1 equidistant midpoints (six bisections at once), keeps the rows before the cell that holds the N-th and goes on
with that cell alone. When all rows of a group's cell have one code, the next code decides.

No group is ever gathered in one task: counts are made before the shuffle, and groups with more than a
thousandth of all rows, of which there are less than a thousand, get their bounds by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.session import cut

CELLS = 64
#: A group with more than this part of all rows is hot; there are less than 1/HOT such groups.
HOT = 1 / 1000
#: Bytes of a text in one code.
CHUNK = 7


def double_code(x: Column, descending: bool = False) -> Column:
    """One code, sign by magnitude of the bits, in the order of a double that isn't null or not-a-number; -0.0 equals 0.0."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    # log2 may round across a power of two.
    e = guess + F.when(size < F.pow(F.lit(2.0), guess), -1).when(size >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0)
    m = F.when(e > 1022, size / 2 / F.pow(F.lit(2.0), e - 1)).otherwise(size / F.pow(F.lit(2.0), e))
    usual = F.shiftleft((e + 1023).cast("long"), 52) + ((m - 1) * float(2**52)).cast("long")
    # Below the least usual double the steps are equal.
    bits = F.when(x == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, (size * 2.0**537 * 2.0**537).cast("long")).otherwise(usual)
    return F.when((x < 0) != F.lit(descending), -bits).otherwise(bits)


def long_codes(x: Column, descending: bool = False) -> list[Column]:
    """Two codes in the order of a long; null comes last."""
    high, low = F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    if descending:
        high, low = -high, -low
    return [F.coalesce(high, F.lit(2**40)).cast("long"), F.coalesce(low, F.lit(0)).cast("long")]


def int_code(x: Column, descending: bool = False) -> Column:
    """The code of an int, or of a long between -2^40 and 2^40; null comes last."""
    return F.coalesce(-x.cast("long") if descending else x.cast("long"), F.lit(2**41))


def text_code(x: Column, k: int) -> Column:
    """The k-th code of a text, ascending by code point. The length of the piece makes an end come before any character."""
    piece = F.substring(F.encode(x, "UTF-8"), CHUNK * k + 1, CHUNK)
    number = F.coalesce(F.conv(F.rpad(F.hex(piece), 2 * CHUNK, "0"), 16, 10).cast("long"), F.lit(0))
    return F.shiftleft(number, 3) + F.coalesce(F.length(piece), F.lit(0))


def top_n(rows: DataFrame, group: str, n: int, codes: list[Column], text: str, identifier: str, then: list[Column] | None = None) -> DataFrame:
    """(group, identifier) of the n first rows of each group, or of all rows of a group that has fewer.

    The order is codes, then text by code point, then the codes then. identifier is a column that the result returns; rows
    that agree in all of that are taken in the order of identifier (a long, unique). Rows with a null group take no part;
    codes and text must not be null. An empty table gives an empty result.
    """
    named = [c.alias(f"__c{i}") for i, c in enumerate(codes)]
    last = [c.alias(f"__t{i}") for i, c in enumerate([*(then or []), *long_codes(F.col(identifier))])]
    base = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("__g"), F.col(identifier).alias("__id"), F.col(text).alias("__text"), *named, *last)
    base = cut(base)
    texts = base.select("__id", "__text")
    sizes = cut(base.groupBy("__g").agg(F.count("*").alias("__n")))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    small = base.join(sizes.where(F.col("__n") <= n).select("__g"), "__g", "left_semi")
    large = sizes.where(F.col("__n") > n).withColumn("__hot", F.col("__n") > total * HOT)
    hot_groups = F.broadcast(large.where("__hot").select("__g"))
    out = [small.select("__g", "__id")]
    for hot in (True, False):
        live = base.join(hot_groups, "__g", "left_semi") if hot else base.join(large.where("NOT __hot").select("__g"), "__g", "left_semi")
        out += _bisect(live.drop("__text").withColumn("__need", F.lit(n).cast("long")), texts, len(codes), len(last), hot)
    return reduce(DataFrame.unionByName, out).select(F.col("__g").alias(group), F.col("__id").alias(identifier))


def _bisect(live: DataFrame, texts: DataFrame, n_codes: int, n_last: int, hot: bool) -> list[DataFrame]:
    """The winners, in parts, of groups with more rows than needed. Texts join the rows only when all codes before are equal."""
    won: list[DataFrame] = []
    live = cut(live)
    if live.isEmpty():
        return won
    level, longest = 0, None
    while True:
        if level >= n_codes and longest is None:
            # Texts of the rows still undecided, by far the fewest, bound the number of text codes.
            live = cut(live.join(texts, "__id"))
            longest = live.agg(F.max(F.octet_length("__text"))).first()[0] or 0
        n_texts = 0 if longest is None else longest // CHUNK + 1
        if level < n_codes:
            code = F.col(f"__c{level}")
        elif level < n_codes + n_texts:
            code = text_code(F.col("__text"), level - n_codes)
        elif level < n_codes + n_texts + n_last:
            code = F.col(f"__t{level - n_codes - n_texts}")
        else:
            raise ValueError("the identifier isn't unique within its group")
        held: list[DataFrame] = []
        while True:
            seen = cut(_pass(live, code, hot))
            counts = {r["__state"]: r["n"] for r in seen.groupBy("__state").agg(F.count("*").alias("n")).collect()}
            keep = [c for c in seen.columns if c not in ("__state",)]
            if counts.get("won"):
                won.append(seen.where("__state = 'won'").select("__g", "__id"))
            if counts.get("tied"):
                held.append(seen.where("__state = 'tied'").select(keep))
            if not counts.get("open"):
                break
            live = seen.where("__state = 'open'").select(keep)
        if not held:
            return won
        live = reduce(DataFrame.unionByName, held)
        level += 1
        # A code that has decided is no more carried along.
        live = live.drop(f"__c{level - 1}")


def _pass(live: DataFrame, code: Column, hot: bool) -> DataFrame:
    """The rows of live that aren't out, with __need anew and __state: won, tied (all rows left have one code) or open."""
    small = F.broadcast if hot else (lambda x: x)
    live = live.withColumn("__code", code)
    bounds = live.groupBy("__g").agg(F.min("__code").alias("__lo"), F.max("__code").alias("__hi"))
    # The width of a cell; codes may lie further apart than a long can say.
    bounds = bounds.withColumn("__step", F.expr(f"__hi DIV {CELLS} - __lo DIV {CELLS} + 1"))
    celled = live.join(small(bounds), "__g").withColumn("__cell", F.expr("__code DIV __step - __lo DIV __step")).drop("__step")
    counts = celled.groupBy("__g", "__cell").agg(F.count("*").alias("__in"), F.first("__need").alias("__want"))
    counts = counts.withColumn("__upto", F.sum("__in").over(Window.partitionBy("__g").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)))
    at = counts.where("__upto >= __want AND __upto - __in < __want")
    at = at.select("__g", F.col("__cell").alias("__at"), F.expr("__want - (__upto - __in)").alias("__left"), F.expr("__upto = __want").alias("__whole"))
    # A cell with one code in it needs the next code; its bounds show in the next pass.
    state = F.expr("CASE WHEN __cell < __at OR __whole THEN 'won' WHEN __lo = __hi THEN 'tied' ELSE 'open' END")
    out = celled.join(small(at), "__g").where("__cell <= __at").withColumn("__state", state)
    return out.withColumn("__need", F.col("__left")).drop("__code", "__lo", "__hi", "__cell", "__at", "__left", "__whole")
