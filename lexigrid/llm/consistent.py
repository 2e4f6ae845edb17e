"""One consistent form for texts that look the same but differ in their characters.

Every text is exploded to positioned code points. A broadcast join with the decomposition and look-alike
tables replaces them, combining marks are put in the order of their classes, base and marks are composed
again and the texts are put together in the order of the positions.

The tables follow from the Unicode data and from the short lists below; their size doesn't depend on the
data (about 20,000 rows at most), so that the broadcast is bounded.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.script import long_signs

#: Characters that look like a Latin letter, each with that letter.
LATIN_LOOKALIKES = """
а a  е e  о o  р p  с c  у y  х x  і i  ј j  ѕ s  ԛ q  ԝ w  һ h  ԁ d  ӏ l  ѵ v
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  Х X  І I  Ј J  Ѕ S  Ԛ Q  Ԝ W  Ѵ V
α a  ι i  κ k  ν v  ο o  ρ p  υ u  ϳ j
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϳ J
ɡ g  ɑ a  ı i  ȷ j  ᴠ v  ᴜ u
"""
#: Characters that look like a syllabic sign, each with that sign. Those that are ASCII, and the capital
#: letters of Greek, count as signs only inside of a word that has a sign or one of the others.
SIGN_LOOKALIKES = """
Λ ᐱ  ∧ ᐱ  ⋀ ᐱ  V ᐯ  > ᐳ  < ᐸ  › ᐳ  ‹ ᐸ  ∩ ᑎ  ⋂ ᑎ  ∪ ᑌ  ⋃ ᑌ  U ᑌ  ⊃ ᑐ  ⊂ ᑕ
P ᑭ  d ᑯ  b ᑲ  q ᑫ  Γ ᒥ  L ᒪ  J ᒧ
△ ᐃ  ∆ ᐃ  Δ ᐃ  ▷ ᐅ  ▹ ᐅ  ◁ ᐊ  ◃ ᐊ  ▽ ᐁ  ∇ ᐁ
"""
#: Look-alikes of a sign that are no part of a Latin word.
ONLY_SIGNS = "Λ∧⋀∩⋂∪⋃⊃⊂Γ△∆Δ▷▹◁◃▽∇"
#: Punctuation that looks the same.
SAME_MARKS = {"‐": "-", "‑": "-"}
#: Signs that are written as one character, though they look like two.
JOINED_SIGNS = {"ᕐᒃ": "ᖅ", "ᕐᑭ": "ᕿ", "ᕐᑮ": "ᖀ", "ᕐᑯ": "ᖁ", "ᕐᑰ": "ᖂ", "ᕐᑲ": "ᖃ", "ᕐᑳ": "ᖄ", "ᖕᒋ": "ᖏ", "ᖕᒌ": "ᖐ", "ᖕᒍ": "ᖑ", "ᖕᒎ": "ᖒ", "ᖕᒐ": "ᖓ", "ᖕᒑ": "ᖔ"}
#: The combining dot that makes a vowel long; a sign with it has a character of its own.
DOT = "\u0307"
#: Kinds of compatibility decomposition that don't change what a reader sees but for the width.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")
#: Characters besides those of the category Zs that end a line or stand for a blank.
BREAKS = "\t\n\v\f\r\x85\u2028\u2029"
#: Unseen characters besides those of the category Cf.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))


def _pairs(text: str) -> dict[str, str]:
    parts = text.split()
    return dict(zip(parts[::2], parts[1::2], strict=True))


def _decomposed(ch: str) -> str:
    kind, *codes = unicodedata.decomposition(ch).split() or [""]
    if not kind or kind[0] == "<" and kind not in SAME_LOOK:
        return ch
    parts = codes if kind[0] == "<" else [kind, *codes]
    out = "".join(_decomposed(chr(int(x, 16))) for x in parts)
    # A spacing accent is no blank with an accent.
    return ch if out[:1] == " " and len(out) > 1 else out


@lru_cache(maxsize=1)
def code_point_rows() -> list[tuple]:
    """(ch, own, latin, sign, kind) for each code point that isn't its own form or says something of its word: what it turns
    into inside of a word of another script, of Latin letters and of syllabic signs. kind is s for signs, x for letters
    of Greek and Cyrillic that look like no other, b for blanks.
    """
    latin, sign, long = _pairs(LATIN_LOOKALIKES), _pairs(SIGN_LOOKALIKES), long_signs()
    short_of = {b: a + DOT for a, b in long.items()}
    rows = []
    for code in range(1, 0x30000):
        ch = chr(code)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co") or 0xAC00 <= code < 0xD7A4:
            continue
        if cat == "Zs" or ch in BREAKS:
            rows.append((ch, " ", " ", " ", "b"))
        elif cat == "Cf" or ch in UNSEEN:
            rows.append((ch, "", "", "", ""))
        else:
            base = [SAME_MARKS.get(x, x) for x in _decomposed(ch)]
            own = "".join(short_of.get(x, x) for x in base)
            plain = "".join(latin.get(x, short_of.get(x, x)) for x in base)
            signs = "".join(short_of.get(y, y) for x in base for y in [sign.get(x, x)])
            kind = ""
            if 0x1400 <= code <= 0x167F and cat == "Lo" or ch in ONLY_SIGNS:
                kind = "s"
            elif cat[0] == "L" and 0x370 <= code < 0x530 and base[0] not in latin and base[0] not in sign:
                kind = "x"
            if {own, plain, signs} != {ch} or kind:
                rows.append((ch, own, plain, signs, kind))
    return rows


@lru_cache(maxsize=1)
def composed_pairs() -> dict[str, str]:
    """Base and mark -> the one character for both."""
    out = {}
    for code in range(0xC0, 0x30000):
        ch = chr(code)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            out["".join(chr(int(x, 16)) for x in d.split())] = ch
    out.update({a + DOT: b for a, b in long_signs().items()})
    return out


@lru_cache(maxsize=1)
def mark_classes() -> list[tuple[str, int]]:
    return [(chr(c), k) for c in range(0x300, 0x1F000) if (k := unicodedata.combining(chr(c)))]


#: Texts out of these characters alone, with single blanks inside, are in their consistent form already: printable ASCII,
#: composed Latin letters, and the syllabic signs. No sign stands beside a character of another kind that a word goes on with, so that no word
#: has both; parts of one sign don't follow each other.
_OTHERS = r"A-Za-z<>\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
_CLEAN = rf"^(?!\s)(?!.*\s$)(?!.*\s\s)(?!.*[\x{{1550}}\x{{1595}}][\x{{146d}}-\x{{1473}}\x{{148b}}-\x{{1491}}\x{{1483}}])(?!.*[\x{{1401}}-\x{{167f}}][{_OTHERS}])(?!.*[{_OTHERS}][\x{{1401}}-\x{{167f}}])[\x20-\x7e{_OTHERS}\x{{1401}}-\x{{167f}}]*$"


def is_consistent(col: Column) -> Column:
    """True where a look at the characters shows that the text is its own consistent form."""
    return col.rlike(_CLEAN)


def _compose(marks: Column, start: Column) -> Column:
    """start with the ordered marks composed into it, by the rule of Unicode: a mark joins the base unless one of the same
    class stands between.
    """
    table = composed_pairs()
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    zero = F.struct(start.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, m: Column) -> Column:
        both = F.when(acc["last"] < m["ccc"], F.try_element_at(pairs, F.concat(acc["base"], m["ch"])))
        return F.when(both.isNotNull(), F.struct(both.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["base"].alias("base"), F.concat(acc["rest"], m["ch"]).alias("rest"), m["ccc"].alias("last"))
        )

    return F.aggregate(marks, zero, step, lambda x: F.concat(x["base"], x["rest"]))


def consistent_form(rows: DataFrame, keys: list[str], text: str, out: str = "consistent") -> DataFrame:
    """(keys, out) of each row of rows whose text isn't null. The keys together are unique and not null.

    A text of blanks and unseen characters alone turns into an empty one. Blanks at the ends go, every other run of blanks
    becomes one ordinary blank. Letter case, accents, vowel length and punctuation stay. A word that has a syllabic sign
    is taken as syllabic, so that its Latin look-alikes turn into signs; in a word with a Greek or Cyrillic letter that
    looks like no other nothing is taken for a look-alike; in all other words look-alikes turn into Latin letters. Signs
    with a dot, and the parts of one sign, become one character. Jamo of Hangul aren't composed. Other columns of rows are
    left out, so that no name can clash; an empty table gives an empty one.

    Rows whose characters show that they are in this form already aren't exploded, as nothing would change: a test compares
    both ways on random mixes of the characters that pass. The rest is shuffled once, by key.
    """
    spark = rows.sparkSession
    k = [f"__k{i}" for i in range(len(keys))]
    rows = rows.select(*[F.col(a).alias(b) for a, b in zip(keys, k, strict=True)], F.col(text).alias("__text")).where("__text IS NOT NULL")
    clean = is_consistent(F.col("__text"))
    both = rows.where(clean).select(*k, F.col("__text").alias(out)).unionByName(_through_code_points(spark, rows.where(~clean), k, out))
    return both.select(*[F.col(b).alias(a) for a, b in zip(keys, k, strict=True)], out)


def _through_code_points(spark: SparkSession, rows: DataFrame, k: list[str], out: str) -> DataFrame:
    table = spark.createDataFrame(code_point_rows(), "ch string, own string, latin string, sign string, kind string")
    order = spark.createDataFrame(mark_classes(), "mark string, ccc int")
    # The blank at the end goes again below; with it, every text has a row.
    points = rows.select(*k, F.posexplode(F.regexp_extract_all(F.concat("__text", F.lit(" ")), F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    points = points.join(F.broadcast(table), "ch", "left").withColumn("kind", F.coalesce("kind", F.lit("")))
    # A word goes on with letters, marks, unseen characters and look-alikes.
    inside = F.col("ch").rlike(r"^[\p{L}\p{M}<>\x{2039}\x{203a}]$") | (F.col("kind") == "s") | (F.col("own") == "")
    points = points.withColumn("inside", inside).withColumn("word", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(Window.partitionBy(*k).orderBy("pos")))
    of_word = Window.partitionBy(*k, "word")
    has = lambda kind: F.max(F.col("inside") & (F.col("kind") == kind)).over(of_word)
    points = points.withColumn("has_x", has("x")).withColumn("has_s", has("s"))
    new = F.when(~F.col("inside") | F.col("has_x") & ~F.col("has_s"), F.col("own")).when(F.col("has_s"), F.col("sign")).otherwise(F.col("latin"))
    points = points.select(*k, "pos", F.coalesce(new, F.col("ch")).alias("new"))
    parts = points.select(*k, "pos", F.posexplode(F.regexp_extract_all("new", F.lit("(?s)."), F.lit(0))).alias("sub", "ch"))
    parts = parts.join(F.broadcast(order), F.col("ch") == F.col("mark"), "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    # Each base with the marks that follow; marks before any base belong to an empty one.
    base_no = F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(Window.partitionBy(*k).orderBy("pos", "sub"))
    groups = parts.withColumn("base_no", base_no).groupBy(*k, "base_no").agg(
        F.coalesce(F.max(F.when(F.col("ccc") == 0, F.col("ch"))), F.lit("")).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("ccc") > 0, F.struct("ccc", "pos", "sub", "ch")))).alias("marks"),
    )
    groups = groups.withColumn("char", F.when(F.size("marks") == 0, F.col("base")).otherwise(_compose(F.col("marks"), F.col("base"))))
    form = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base_no", "char"))), lambda x: x["char"]), "")
    whole = groups.groupBy(*k).agg(form.alias("__form"))
    form = F.col("__form")
    for a, b in JOINED_SIGNS.items():
        form = F.replace(form, F.lit(a), F.lit(b))
    return whole.select(*k, F.trim(F.regexp_replace(form, " +", " ")).alias(out))
