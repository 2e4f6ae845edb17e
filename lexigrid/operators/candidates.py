"""Features of scored analyses, their statistics, and cell edges for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions import decomp as D
from lexigrid.operators.ranks import numbered

#: The features of a candidate in the order in which a model lists them.
FEATURES = """
n_morphemes n_nonroot n_deriv n_ending n_consec_dup_id wordlen_per_morph root_canon_len mean_canon_len min_canon_len n_thin_canon n_vv n_nn n_vn n_nv
cat_switches type_violations ends_with_ending ends_with_bare_deriv edit_dist edit_dist_norm concat_len_minus_word first_canon_is_prefix rank_current_sort
n_candidates edit_dist_rank_in_word n_morphemes_rank_in_word root_canon_len_rank_in_word type_violations_rank_in_word weight freq_sum freq_mean
freq_min freq_root n_zero_freq
""".split()


def codes(ids: Column) -> Column:
    """A letter for each id: a, b, c and d for the suffixes vv, nn, vn and nv, e for endings, x for others."""
    v = lambda i, at: F.substring(i, at, 1) == "v"
    deriv = lambda i: F.when(v(i, -2), F.when(v(i, -1), "a").otherwise("c")).when(v(i, -1), "d").otherwise("b")
    return F.array_join(F.transform(ids, lambda i: F.when(i.rlike(D.DERIV.replace("$", r"\z")), deriv(i)).when(i.rlike(D.ENDINGS), "e").otherwise("x")), "")


#: Pairs of neighbours, of which the first is a root's category or a suffix, where the second gives another category than the first, or asks for another.
SWITCH, CLASH = "[nbc](?=[ad])|[vad](?=[bc])", "[nbc](?=[ac])|[vad](?=[bd])"


def own_features(rows: DataFrame) -> DataFrame:
    """rows (cand_id, word_id, word, decomp, native_rank, weight) with the features that need no other row, canonical forms (canon) and ids. An analysis
    without parts is left out; distances are in code points. A root that is neither n nor v counts as n.
    """
    rows = rows.withColumn("canon", D.part_column(F.col("decomp"), 2)).withColumn("ids", D.part_column(F.col("decomp"), 3)).where(F.size("ids") > 0)
    rows = rows.withColumn("codes", codes(F.col("ids"))).withColumn("concat", F.array_join("canon", "")).withColumn("lens", F.transform("canon", F.length))
    root, after = F.get("ids", F.lit(0)), F.substring("codes", 2, 2**31 - 1)
    walk = F.concat(F.when(root.rlike(r"^[0-9]+[nv]\z"), F.substring(root, -1, 1)).otherwise("n"), F.translate(after, "ex", ""))
    rows = rows.withColumn("walk", walk).withColumn("edit_dist", F.levenshtein("concat", "word"))
    n = F.size("ids")
    of = lambda letters, c=F.col("codes"): F.length(c) - F.length(F.translate(c, letters, ""))
    last, size = F.substring("codes", -1, 1), F.length("word")
    twice = F.expr("size(filter(sequence(1, size(ids)), i -> i < size(ids) AND ids[i] = ids[i - 1]))")
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    columns = {
        "n_morphemes": n, "n_nonroot": n - 1, "n_deriv": of("abcd", after), "n_ending": of("e"), "n_consec_dup_id": twice,
        "wordlen_per_morph": size / n, "root_canon_len": F.get("lens", F.lit(0)), "mean_canon_len": F.length("concat") / n, "min_canon_len": F.array_min("lens"),
        "n_thin_canon": F.size(F.filter("lens", lambda x: x <= 1)), "n_vv": of("a"), "n_nn": of("b"), "n_vn": of("c"), "n_nv": of("d"),
        "cat_switches": F.regexp_count("walk", F.lit(SWITCH)), "type_violations": F.regexp_count("walk", F.lit(CLASH)), "ends_with_ending": one(last == "e"), "ends_with_bare_deriv": one(last.isin(*"abcd")),
        "edit_dist_norm": F.col("edit_dist") / F.greatest(size, F.lit(1)), "concat_len_minus_word": F.length("concat") - size,
        "first_canon_is_prefix": one(F.startswith("word", F.get("canon", F.lit(0)))),
    }
    return rows.withColumns(columns).drop("walk", "concat", "lens", "codes")


#: Words with more candidates than this, and more than a thousandth of all, are numbered apart from the others.
LARGE_WORD = 10_000


def places(rows: DataFrame) -> DataFrame:
    """(cand_id, n_candidates, places) of rows of own_features, a table, in their word, from 0; ties keep the native order. A word may hold a third of all rows."""
    orders = {
        "rank_current_sort": ["weight", -F.col("root_canon_len"), "n_nonroot"],
        "edit_dist_rank_in_word": ["edit_dist"], "n_morphemes_rank_in_word": ["n_morphemes"], "root_canon_len_rank_in_word": [-F.col("root_canon_len")], "type_violations_rank_in_word": ["type_violations"],
    }
    narrow = rows.where("word_id IS NOT NULL").select("word_id", "cand_id", "native_rank", "weight", "root_canon_len", "n_nonroot", "edit_dist", "n_morphemes", "type_violations")
    sizes = narrow.groupBy("word_id").agg(F.count("*").alias("n_candidates"))
    # Fewer than a thousand.
    large = sizes.where(F.col("n_candidates") > max(LARGE_WORD, rows.count() // 1000)).collect()
    ids = [r["word_id"] for r in large]
    own = Window.partitionBy("word_id")
    numbers = {name: (F.row_number().over(own.orderBy(*order, "native_rank", "cand_id")) - 1).cast("long") for name, order in orders.items()}
    ranks = narrow.where(~F.col("word_id").isin(ids)).select("cand_id", *(c.alias(n) for n, c in numbers.items()), F.count("*").over(own).alias("n_candidates"))
    if large:
        # All orders at once: a row for each, with its keys as numbers.
        keys = lambda order: [F.lit(0.0) if c is None else (F.col(c) if isinstance(c, str) else c).cast("double") for c in (*order, None, None)[:3]]
        each = F.array(*(F.struct(F.lit(n).alias("name"), *(k.alias(f"k{i}") for i, k in enumerate(keys(o)))) for n, o in orders.items()))
        of_large = narrow.where(F.col("word_id").isin(ids)).select("word_id", "cand_id", "native_rank", F.explode(each).alias("x")).select("word_id", "cand_id", "native_rank", "x.*")
        ranked = numbered(of_large.withColumn("list", F.concat_ws(" ", "word_id", "name")), "list", ["k0", "k1", "k2", "native_rank", "cand_id"])
        ranked = ranked.groupBy("word_id", "cand_id").agg(*((F.max(F.when(F.col("name") == n, F.col("pos"))) - 1).alias(n) for n in orders))
        counts = rows.sparkSession.createDataFrame([(r["word_id"], r["n_candidates"]) for r in large], "word_id long, n_candidates long")
        ranks = ranks.unionByName(ranked.join(F.broadcast(counts), "word_id").drop("word_id"))
    return ranks


def frequencies(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """(cand_id, sums) over the frequencies of the morphemes of rows of own_features in prior (key, n), both tables; an unknown one counts 0. Frequent morphemes, most of the parts, are
    looked up where they stand and summed before the shuffle.
    """
    # Those with more than a thousandth of all, fewer than a thousand.
    total = prior.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = prior.where(F.col("n") > total // 1000)
    names = [r["key"] for r in frequent.select("key").collect()]
    keys = rows.select("cand_id", F.zip_with("canon", "ids", lambda a, b: F.concat(a, F.lit("/"), b)).alias("k"))
    known = keys.select("cand_id", F.posexplode("k").alias("pos", "key")).join(F.broadcast(frequent), "key")
    rare = keys.select("cand_id", F.explode(F.filter(F.transform("k", lambda k, i: F.struct(k.alias("key"), i.alias("pos"))), lambda x: ~x["key"].isin(names))).alias("x")).select("cand_id", "x.*")
    rest = rare.join(prior, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return known.unionByName(rest).groupBy("cand_id").agg(
        F.sum("n").alias("freq_sum"), (F.sum("n") / F.count("*")).alias("freq_mean"), F.min("n").alias("freq_min"), F.max(F.when(F.col("pos") == 0, F.col("n"))).alias("freq_root"), F.sum((F.col("n") == 0).cast("long")).alias("n_zero_freq"),
    )


def statistics(parses: DataFrame) -> DataFrame:
    """(kind, a, b, n) over parses (decomp): how often each morpheme (unigram), pair of ids side by side (bigram), id before another one (before), id of
    a root (root) and pair of letters in a root (letters) occurs. b is null where there is none. Parses to be left out, such as a fold's, are to be filtered before.
    """
    rows = parses.select(D.keys(F.col("decomp")).alias("k"), D.part_column(F.col("decomp"), 3).alias("i"), F.get(D.part_column(F.col("decomp"), 2), F.lit(0)).alias("root")).where(F.size("k") > 0)
    item = "named_struct('kind', '{}', 'a', {}, 'b', {})"
    none = "CAST(NULL AS STRING)"
    lists = [
        f"transform(k, x -> {item.format('unigram', 'x', none)})",
        f"transform(filter(sequence(1, size(i)), j -> j < size(i)), j -> {item.format('bigram', 'i[j - 1]', 'i[j]')})",
        f"transform(filter(sequence(1, size(i)), j -> j < size(i)), j -> {item.format('before', 'i[j - 1]', none)})",
        f"array({item.format('root', 'i[0]', none)})",
        f"transform(filter(sequence(1, greatest(length(root), 1)), j -> j < length(root)), j -> {item.format('letters', 'substring(root, j, 2)', none)})",
    ]
    return rows.select(F.explode(F.expr(f"concat({', '.join(lists)})")).alias("s")).groupBy("s.kind", "s.a", "s.b").agg(F.count("*").alias("n"))


def with_identity(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """(cand_id, bigram_min, bigram_mean, bigram_nzero, bigram_root_first, root_id_freq, root_charbi) of rows (cand_id, decomp), from statistics: shares
    of the transitions between ids (1 without any), the frequency of the root's id and the mean frequency of its pairs of letters.
    """
    of = lambda kind: stats.where(F.col("kind") == kind)
    ids = rows.select("cand_id", D.part_column(F.col("decomp"), 3).alias("i"), F.get(D.part_column(F.col("decomp"), 2), F.lit(0)).alias("root")).where(F.size("i") > 0)
    steps = ids.where(F.size("i") > 1).select("cand_id", F.posexplode(F.expr("transform(sequence(1, size(i) - 1), j -> named_struct('a', i[j - 1], 'b', i[j]))")).alias("pos", "x")).select("cand_id", "pos", "x.a", "x.b")
    steps = steps.join(of("bigram").select("a", "b", "n"), ["a", "b"], "left").join(of("before").select("a", F.col("n").alias("all")), "a", "left")
    share = F.coalesce(F.col("n") / F.col("all"), F.lit(0.0))
    steps = steps.groupBy("cand_id").agg(F.min(share).alias("bigram_min"), F.avg(share).alias("bigram_mean"), F.sum((share == 0).cast("long")).alias("bigram_nzero"), F.max(F.when(F.col("pos") == 0, share)).alias("bigram_root_first"))
    letters = ids.where(F.length("root") > 1).select("cand_id", F.explode(F.expr("transform(sequence(1, length(root) - 1), j -> substring(root, j, 2))")).alias("a")).join(of("letters").select("a", "n"), "a", "left")
    letters = letters.groupBy("cand_id").agg(F.avg(F.coalesce("n", F.lit(0))).alias("root_charbi"))
    out = ids.select("cand_id", F.get("i", F.lit(0)).alias("a")).join(of("root").select("a", F.col("n").alias("root_id_freq")), "a", "left").join(steps, "cand_id", "left").join(letters, "cand_id", "left")
    fill = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select("cand_id", fill("bigram_min", 1.0), fill("bigram_mean", 1.0), fill("bigram_nzero", 0), fill("bigram_root_first", 1.0), fill("root_id_freq", 0), fill("root_charbi", 0.0))


def quantile_edges(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(edge) of a numeric column: its distinct values if there are at most bins, else the values at the places n q / bins (from 0) of the sorted
    rows, q from 1 to bins - 1. Found from the counts of the distinct values, so that no task sorts all rows. Nulls are left out.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if distinct <= bins:
        return counts.select(F.col("v").alias("edge"))
    upto = numbered_sums(counts)
    places = rows.sparkSession.createDataFrame([(total * q // bins,) for q in range(1, bins)], "place bigint")
    # As many places as bins.
    return F.broadcast(places).join(upto, (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))).select(F.col("v").alias("edge"))


def numbered_sums(counts: DataFrame) -> DataFrame:
    """counts (v, n) with before: the sum of n over smaller v. Ranges of v are summed on their own and shifted by those before."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = numbered(counts.withColumn("all", F.lit(0)), "all", ["v"], "place").withColumn("block", F.expr(f"place DIV {4096}"))
    sums = ranged.groupBy("block").agg(F.sum("n").alias("s"))
    # As many blocks as there are thousands of distinct values.
    sums = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("shift"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("place")) - F.col("n")
    return ranged.withColumn("inside", inside).join(F.broadcast(sums), "block").repartition(parts).select("v", "n", (F.col("shift") + F.col("inside")).alias("before"))


def bin_of(value: Column, edges: list[float]) -> Column:
    """How many of the sorted edges are at most value, as a binary search finds it."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value))
