"""Texts whose end was cut off, by a field's limit or in transfer.

Two self-joins by prefix carry the search. The first sorts the whole texts: one that is a strict prefix of another is also one of its
neighbour's in that order, which shows how the text goes on; it is cut if it goes on inside of a word or of a clause. The second
hashes prefixes of words: the last word of a text, after the word before it, is looked up among the prefixes of all words after that
word in the corpus. One that stands there as the beginning of longer words, and hardly ever whole, is cut inside of its last word.

Most cut texts have no longer copy, and many end with a whole word. So the corpus also says how often a word, a word after another and a place in
a clause that begins alike close a clause inside of texts; at which lengths the texts of a source pile up; in which sources texts end with a mark;
and by which letters words end. All thresholds are shares or ratios smoothed by a few pseudo-counts, so that nothing switches with the size of
the corpus. Counts take each text once, however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.consistent import LATIN_LOOKALIKES, _pairs
from lexigrid.session import cut

#: Letters with accents, without.
PLAIN = dict(zip("éèêëàâäîïôöûùüçÉÈÊÀÂÎÔÛÇ", "eeeeaaaiioouuucEEEAAIOUC", strict=True))
MARK, CLOSER = r".!?…", r"”\x22»)\]}’'"
EMOJI = r"\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}"
#: What an end must close to be a formula: this part of its source's texts, and of its own occurrences with those of longer words.
FORMULA, FORMULA_PART = 0.004, 0.1
#: A last word is a fragment if it stands whole in less than this part of its own occurrences and those of longer words.
WHOLE = 0.06
#: An end whose smoothed share of closings is smaller doesn't close a clause; one with at least COMPLETE surely may.
CLOSING, COMPLETE = 0.025, 0.4
#: Pseudo-counts of the wider context in a smoothed share.
PRIOR = 4
#: A limit is a length with so many times the texts of the lengths within NEAR, these plus NATURAL; lengths up to LIMIT_FROM are none.
LIMIT_TIMES, NEAR, NATURAL, LIMIT_FROM = 6, 20, 0.7, 40
#: Of a source's ends without a mark this part must be able to close a clause, else its texts need a mark.
OPTIONAL = 0.4
#: Smoothed part of a piece's occurrences at a word's end from which on it may end a word that is found nowhere else.
ENDING = 0.08
#: Lengths of the pieces.
PIECES = (2, 3, 4, 5)
#: Places in a clause that are told apart.
PLACES = 12
#: Rows of one end that one task joins, roughly.
BLOCK = 4096
#: What is known of an end.
END = ["before2", "before", "word", "first", "place"]
#: Blanks at the ends of a text.
BLANKS = " \t\n\v\f\r\x85                 　"

AROUND = ".!?…;:,”\"»)]}’'“«(["
#: Where a clause ends: at a line's end, before a slash or an emoji, after a mark.
_CLAUSES = rf"\n| / | (?=[{EMOJI}])|(?<=[{MARK};:,][”\x22»)\]’]{{0,2}}) "


def folded(text: Column) -> Column:
    """text without the differences in characters that don't matter here, and without blanks at its ends."""
    out = F.regexp_replace(text, r"[\p{Cf}\x{300}-\x{36f}]", "")
    out = F.regexp_replace(out, r"[\p{Zs}\t\r]", " ")
    wide = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    pairs = {**wide, **_pairs(LATIN_LOOKALIKES), **PLAIN}
    return F.trim(F.regexp_replace(F.translate(out, "".join(pairs), "".join(pairs.values())), "  +", " "), F.lit(BLANKS))


def _masked(f: Column) -> Column:
    """f in lower case with digits counted by their places alone; a number counts as one digit."""
    return F.regexp_replace(F.translate(F.lower(f), "123456789", "0" * 9), r"(?<![^ \n(])0+(?![^ \n.,;:!?…)])", "0")


def _bare(word: Column) -> Column:
    """A word without the marks and brackets around it; marks alone stay."""
    out = F.trim(word, F.lit(AROUND))
    return F.when(out == "", word).otherwise(out)


def _clauses(g: Column) -> Column:
    """The clauses of a masked text; numbers of a list's items are left out."""
    return F.filter(F.split(F.regexp_replace(g, r"(?m)^0[.)] ", ""), _CLAUSES), lambda x: x != "")


def _words(docs: DataFrame) -> DataFrame:
    """(first, place, before2, before, word, closed, last) of every word: first is the first word of its clause and place its number there, before
    and before2 are the words before it (^ where there is none), closed whether it ends a clause inside of the text, last whether it ends the text.
    """
    rows = docs.select(_clauses(F.col("g")).alias("c")).select(F.posexplode("c").alias("i", "clause"), F.size("c").alias("n"))
    rows = rows.select((F.col("i") == F.col("n") - 1).alias("final"), F.filter(F.split("clause", " +"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    rows = rows.select("final", F.transform("w", _bare).alias("w"))
    each = F.expr("transform(w, (x, i) -> named_struct('word', x, 'before', IF(i = 0, '^', w[i - 1]), 'before2', IF(i < 2, '^', w[i - 2])))")
    rows = rows.select("final", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first"), F.posexplode(each).alias("place", "t"))
    ends = F.col("place") == F.col("n") - 1
    return rows.select("first", F.least("place", F.lit(PLACES)).alias("place"), "t.before2", "t.before", "t.word", (ends & ~F.col("final")).alias("closed"), (ends & F.col("final")).alias("last"))


def _piled(docs: DataFrame) -> DataFrame:
    """(source, whole, unit, length) of the lengths, in characters or bytes of the stored text, at which the texts of a source pile up. Ends that may
    be complete (whole) and others are counted apart, so that complete texts that happen to have the length stay so.
    """
    sizes = F.array(F.struct(F.lit("char").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("byte").alias("unit"), F.col("bytes").alias("length")))
    counts = docs.select("source", "whole", "h", F.explode(sizes).alias("s")).groupBy("source", "whole", "s.unit", "s.length").agg(F.countDistinct("h").alias("n"))
    near = Window.partitionBy("source", "whole", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    others = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    return counts.withColumn("others", others).where((F.col("length") > LIMIT_FROM) & (F.col("n") >= LIMIT_TIMES * (F.col("others") + NATURAL))).select("source", "whole", "unit", "length")


def longer_copies(texts: DataFrame) -> DataFrame:
    """(f, rest): of every text f (distinct, not empty) that is a strict prefix of another, how its next longer one goes on.

    The texts are range-partitioned and sorted; all that begin with one text follow right after it, so that each looks at
    its neighbour alone. The first text of each range is handed to the range before: one row a partition.
    """
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(texts.select("f").repartitionByRange(n, "f").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("f").alias("head"))
    # As many rows as partitions.
    heads = heads.select(F.lead("part").over(Window.orderBy("part")).alias("next"), F.lead("head").over(Window.orderBy("part")).alias("next_head"), "part")
    following = F.lead("f").over(Window.partitionBy("part").orderBy("f"))
    rows = ranged.withColumn("following", following).join(F.broadcast(heads), "part").withColumn("following", F.coalesce("following", "next_head"))
    return rows.where(F.expr("startswith(following, f) AND length(following) > length(f)")).select("f", F.expr("substring(following, length(f) + 1)").alias("rest"))


def _prefix_counts(types: DataFrame, keys: list[str], asked: DataFrame) -> DataFrame:
    """(keys, word, longer) for the asked (keys, word) that are strict prefixes of words in types (keys, word, n): how often such words occur.

    Every word gives the hashes of its prefixes, which are added up before the shuffle; contexts with very many words are spread by their prefixes.
    """
    hashes = types.select(F.explode(F.expr(f"transform(sequence(1, length(word) - 1), k -> xxhash64({''.join(k + ', ' for k in keys)} substring(word, 1, k)))")).alias("p"), "n")
    sums = hashes.groupBy("p").agg(F.sum("n").alias("longer"))
    return asked.select(*keys, "word").distinct().withColumn("p", F.xxhash64(*keys, "word")).join(sums, "p").drop("p")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason) of every document; reason is null for a text that isn't cut off.

    Null, empty and blank texts aren't cut off. Repeated texts are judged alike. Other columns are ignored; a null source is
    a source of its own. The reasons: copy (a longer copy goes on inside of a clause), open (a bracket or quote of the last line isn't closed),
    joint (it ends with a comma or the like), bytes (its last character is broken), number, limit, no-mark (all other
    texts of the source end with one), prefix, place, never-closes, shape, line.
    """
    stored = F.col("text")
    # Written, as several passes read it.
    base = cut(documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.length(stored).alias("chars"), F.octet_length(stored).alias("bytes"), folded(stored).alias("f")).withColumns({"h": F.xxhash64("f"), "g": _masked(F.col("f"))}))
    docs = base.where("f <> ''")
    texts = docs.groupBy("f").agg(F.first("g").alias("g"))
    said = cut(_words(texts))
    sums = [F.sum((~F.col("last")).cast("long")).alias("total"), F.sum(F.col("closed").cast("long")).alias("closing"), F.sum(F.col("last").cast("long")).alias("lasts"), F.count("*").alias("n")]
    again = lambda rows, *keys: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", "closing", "lasts", "n")])
    three = cut(said.groupBy("before2", "before", "word").agg(*sums))
    two = cut(again(three, "before", "word"))
    one = cut(again(two, "word"))
    after = again(two, "before")
    places = said.groupBy("first", "place").agg(*sums)

    # The ends of the texts.
    line = F.substring_index("f", "\n", -1)
    end = F.substring("f", -1, 1)
    opened = F.lit(False)
    for a, b in ("()", "“”", "«»", "{}", "[]"):
        opened = opened | (F.locate(a, F.reverse(line)) > 0) & ((F.locate(b, F.reverse(line)) == 0) | (F.locate(a, F.reverse(line)) < F.locate(b, F.reverse(line))))
    item = F.col("f").rlike(r"\n\p{Nd}{1,3}[.)]$")
    # The last clause is in the last line.
    last_clause = F.element_at(_clauses(F.substring_index("g", "\n", -1)), -1)
    ends = docs.select(
        "doc_id", "source", "chars", "bytes", "h", "f",
        F.when(opened, "open").when(end == "�", "bytes").when(end.rlike("[,;:–/—-]"), "joint").when(item, "number").alias("reason"),
        F.col("f").rlike(rf"(?:[{MARK}][{CLOSER}]*|[{EMOJI}])$").alias("marked"),
        end.rlike(rf"[{CLOSER}]").alias("closer"),
        F.transform(F.filter(F.split(last_clause, " +"), lambda x: x != ""), _bare).alias("w"),
    )
    ends = ends.where(F.size("w") > 0).withColumns({"word": F.element_at("w", -1), "before": F.coalesce(F.try_element_at("w", F.lit(-2)), F.lit("^")), "before2": F.coalesce(F.try_element_at("w", F.lit(-3)), F.lit("^")), "first": F.get("w", F.lit(0)), "place": F.least(F.size("w") - 1, F.lit(PLACES))}).drop("w")
    goes_on = longer_copies(texts).select(F.xxhash64("f").alias("h"), F.regexp_extract("rest", rf"^(?:[\p{{L}}\p{{M}}\p{{N}}]| (?![/{EMOJI}]))", 0).alias("goes_on")).where("goes_on <> ''")
    ends = ends.join(goes_on, "h", "left").withColumn("goes_on", F.when((F.col("goes_on") == " ") | end.rlike(r"[\p{L}\p{M}\p{N}]"), F.col("goes_on")))
    ends = cut(ends)
    asked = cut(ends.where("reason IS NULL AND NOT marked").select(*END).distinct())
    pairs, words = asked.select("before", "word").distinct(), asked.select("word").distinct()

    of = lambda rows, i: rows.withColumnsRenamed({c: f"{c}{i}" for c in ("total", "closing", "lasts", "n")})
    known = asked.join(of(three, 3), ["before2", "before", "word"], "left").join(of(two, 2), ["before", "word"], "left").join(of(one, 1), ["word"], "left")
    known = known.join(of(after, "a"), ["before"], "left").join(of(places, "p"), ["first", "place"], "left")
    contexts = pairs.select("before").distinct()
    known = known.join(_prefix_counts(two.join(contexts, "before", "left_semi").where("length(word) > 1"), ["before"], pairs).withColumnRenamed("longer", "longer2"), ["before", "word"], "left")
    known = known.join(_prefix_counts(one.where("length(word) > 1"), [], words).withColumnRenamed("longer", "longer1"), ["word"], "left")

    # Pieces of words that are found whole nowhere else.
    rare = known.where("coalesce(total1, 0) = 0 AND coalesce(longer1, 0) = 0").select("word").distinct()
    pieces = rare.select("word", F.explode(F.expr(f"transform(filter(array({', '.join(map(str, PIECES))}), k -> k <= length(word)), k -> substring(word, length(word) - k + 1, k))")).alias("piece"))
    types = one.where(F.col("total") > 0).where(F.col("word").rlike(r"^(?:[A-Za-z]{2,}|[\x{1401}-\x{167f}]{2,})$")).select("word")
    in_types = types.select(F.explode(F.expr(f"flatten(transform(filter(array({', '.join(map(str, PIECES))}), k -> k <= length(word)), k -> transform(sequence(1, length(word) - k + 1), i -> named_struct('piece', substring(word, i, k), 'ends', i + k - 1 = length(word)))))")).alias("s")).select("s.*")
    in_types = in_types.groupBy("piece").agg(F.count("*").alias("n"), F.sum(F.col("ends").cast("long")).alias("ends"))
    shapes = pieces.join(in_types, "piece").groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.length("piece").alias("k"), F.col("n"), F.col("ends")))).alias("s"))
    # Longer pieces are smoothed by the shorter ones.
    may_end = F.aggregate("s", F.lit(0.5), lambda a, s: (s["ends"] + 2 * a) / (s["n"] + 2))
    known = cut(known.join(shapes.select("word", may_end.alias("may_end")), ["word"], "left"))

    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    smooth = lambda a, b, prior, p: (a + prior * p) / (b + prior)
    stands = smooth(n("total2"), n("total2") + n("longer2"), 1, smooth(n("total1"), n("total1") + n("longer1"), 1, F.lit(0.5)))
    after_any = smooth(n("closinga"), n("totala"), PRIOR, F.lit(0.2))
    alone = smooth(n("closing1"), n("total1"), PRIOR, after_any)
    closes = smooth(n("closing3"), n("total3"), PRIOR, smooth(n("closing2"), n("total2"), PRIOR, alone))
    at_place = smooth(n("closingp"), n("totalp"), PRIOR, F.lit(0.2))
    unseen = (n("total1") == 0) & (n("longer1") == 0)
    says = (
        F.when(stands < WHOLE, "prefix")
        .when(at_place < CLOSING / 4, "place")
        .when(closes < CLOSING, "never-closes")
        .when(unseen & (F.col("may_end") <= ENDING), "shape")
    )
    part = lambda i, prior, p: smooth(n(f"lasts{i}"), n(f"lasts{i}") + n(f"total{i}") + n(f"longer{i}"), prior, p)
    known = known.select(*END, (part(2, PRIOR, part(1, PRIOR, F.lit(0.0))) >= FORMULA_PART).alias("formula"), says.alias("says"), (says.isNull() & ~unseen & (closes >= COMPLETE)).alias("sure"))
    open_ends = ends.where("reason IS NULL AND NOT marked").drop("reason", "marked", "f")
    # One end may close a third of all texts: the rows are joined by distinct texts' ends, and its copies over salts by need.
    hot = open_ends.groupBy(*END).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    known = known.join(hot, END).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    most = F.broadcast(hot.where("salts > 1"))
    open_ends = open_ends.join(most, END, "left").withColumn("salt", F.expr("pmod(xxhash64(doc_id), coalesce(salts, 1))").cast("int")).drop("salts")
    open_ends = open_ends.join(known.drop("salts"), [*END, "salt"], "left")
    of_source = docs.groupBy("source").agg(F.countDistinct("h").alias("texts"))
    closing_here = open_ends.groupBy("source", "word").agg(F.countDistinct("h").alias("here"))
    formulas = closing_here.join(of_source, "source").where(F.col("here") / (F.col("texts") + 50) >= FORMULA).select("source", "word", F.lit(True).alias("frequent"))
    # At most 1 / FORMULA rows for each source.
    open_ends = open_ends.join(F.broadcast(formulas), ["source", "word"], "left").withColumn("formula", F.coalesce(F.col("formula") & F.col("frequent"), F.lit(False)))
    open_ends = cut(open_ends.select("doc_id", "source", "chars", "bytes", "h", "closer", "formula", F.when(F.col("goes_on").isNotNull() & ((F.col("goes_on") != " ") | ~F.col("sure")), "copy").otherwise(F.col("says")).alias("says"), (F.col("formula") | F.col("sure")).alias("whole")))
    limits = _piled(open_ends.where("NOT closer"))
    at = lambda unit, size: F.broadcast(limits.where(F.col("unit") == unit).select("source", "whole", F.col("length").alias(size), F.lit(True).alias(f"limit_{unit}")))
    # Few rows: a handful of lengths for each source.
    open_ends = open_ends.join(at("char", "chars"), ["source", "whole", "chars"], "left").join(at("byte", "bytes"), ["source", "whole", "bytes"], "left")
    open_ends = open_ends.withColumn("at_limit", F.coalesce("limit_char", F.lit(False)) | F.coalesce("limit_byte", F.lit(False)))
    free = open_ends.where("NOT formula AND NOT at_limit AND NOT closer").select("source", "h", "says").distinct().groupBy("source").agg((F.avg(F.col("says").isNull().cast("int")) < OPTIONAL).alias("needs_mark"))
    reason = (
        F.when(F.col("formula"), None)
        .when(F.col("closer"), F.when(F.col("says").isin("place", "never-closes"), F.col("says")))
        .when(F.col("says") == "copy", "copy")
        .when(F.col("at_limit"), "limit")
        .when(F.coalesce("needs_mark", F.lit(False)), "no-mark")
        .otherwise(F.col("says"))
    )
    late = open_ends.join(F.broadcast(free), "source", "left").select("doc_id", "source", reason.alias("reason"))
    clear = ends.where("reason IS NOT NULL OR marked").select("doc_id", "source", "reason")
    blank = base.join(ends.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", F.lit(None).cast("string").alias("reason"))
    return late.unionByName(clear).unionByName(blank)


def truncation_rates(judgements: DataFrame) -> DataFrame:
    """(source, documents, truncated, share) for each source; the share is of all its documents."""
    out = judgements.groupBy("source").agg(F.count("*").alias("documents"), F.count("reason").alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("documents"))
