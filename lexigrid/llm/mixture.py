"""Mixing sources to target weights.

Hierarchical budgeting over a tree of domains, languages and sources: weights go down from the root; what a part of the tree can't take,
as its texts may be repeated only so often, goes to its siblings, and only what they can't take either goes to those of its parent.
Each leaf then takes whole epochs of its texts and, of one more, a prefix by tokens in an order drawn by seed.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.tokens import TOKENIZERS, count_tokens
from lexigrid.session import cut

#: Spellings of the languages; a parameter. Any other spelling is one language of its own.
LANGUAGES = {"en": "en", "eng": "en", "fr": "fr", "fra": "fr", "fre": "fr", "iu": "iu", "iku": "iu", "iu-latn": "iu-latn"}
#: Cells of the drawn order in each leaf.
CELLS = 4096

Leaf = tuple[str, str, str]


def fill(amount: float, wants: dict, caps: dict) -> dict:
    """amount dealt to the keys in proportion to wants, none above its cap; what one can't take goes to the others. A key
    with no want gets something only when all others are full.
    """
    got = {k: 0.0 for k in caps}
    for wanted in (wants, {k: caps[k] for k in caps if not wants.get(k)}):
        open_keys = {k for k in caps if wanted.get(k, 0) > 0 and caps[k] > got[k]}
        while amount > 1e-9 and open_keys:
            whole = sum(wanted[k] for k in open_keys)
            full = {k for k in open_keys if got[k] + amount * wanted[k] / whole >= caps[k]}
            if not full:
                for k in open_keys:
                    got[k] += amount * wanted[k] / whole
                return got
            for k in full:
                amount -= caps[k] - got[k]
                got[k] = caps[k]
            open_keys -= full
    return got


def budgets(weights: dict[Leaf, float], caps: dict[Leaf, float], total: float) -> dict[Leaf, float]:
    """Tokens for each leaf: total at the root, dealt level by level; a node can take what its leaves can."""

    def down(leaves: list[Leaf], amount: float, level: int) -> dict[Leaf, float]:
        if level == 3:
            return {leaves[0]: amount}
        parts = defaultdict(list)
        for x in leaves:
            parts[x[level]].append(x)
        dealt = fill(amount, {k: sum(weights[x] for x in v) for k, v in parts.items()}, {k: sum(caps[x] for x in v) for k, v in parts.items()})
        return {leaf: b for k, v in parts.items() for leaf, b in down(v, dealt[k], level + 1).items()}

    return down(sorted(caps), min(total, sum(caps.values())), 0) if caps else {}


def _language(lang: Column, languages: dict[str, str]) -> Column:
    spelt = F.lower(F.trim(lang))
    known = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv]) if languages else None
    return F.coalesce(F.try_element_at(known, spelt) if languages else spelt, F.lit("other"))


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mixture: each source of targets (source, target_share,
    max_repeats, a short list) has its share of the tokens, and copies is at most its max_repeats.

    A column domain of targets, if there is one, puts the sources in domains; without it, or where it is null, a source is a domain of its own.
    total is the number of tokens to reach; without it, the largest for which every source reaches its share. A larger
    one leaves sources short, and what they lack goes to their siblings in the tree. Documents without tokens, or of a
    source that is null or no target, take no part; of rows of targets with a null, zero or negative share or max_repeats
    the source gets nothing. Shares are met to half a document a leaf. doc_id is unique; repeated texts are documents of
    their own.
    """
    domain = F.coalesce("domain", "source") if "domain" in targets.columns else F.col("source")
    rows = targets.select("source", "target_share", "max_repeats", domain.alias("domain"))
    aims = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in rows.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()}
    # One row for each source, as many as aims.
    docs = documents.select("doc_id", "source", "lang", "text").join(F.broadcast(rows.where(F.col("source").isin(*aims) if aims else F.lit(False)).groupBy("source").agg(F.min("domain").alias("domain"))), "source")
    docs = docs.select(F.struct("doc_id", "domain", _language(F.col("lang"), languages).alias("language"), "source").alias("key"), "text")
    sizes = count_tokens(docs, key="key", vocabulary=vocabulary, folder=folder)
    sizes = cut(sizes.select("key.*", "n_tokens").where("n_tokens > 0"))
    # As many rows as targets have sources, times six languages.
    have = {(r["domain"], r["language"], r["source"]): int(r["n"]) for r in sizes.groupBy("domain", "language", "source").agg(F.sum("n_tokens").alias("n")).collect()}
    of_source: dict[str, int] = defaultdict(int)
    for leaf, n in have.items():
        of_source[leaf[2]] += n
    caps = {leaf: float(n * aims[leaf[2]][1]) for leaf, n in have.items()}
    weights = {leaf: aims[leaf[2]][0] * n / of_source[leaf[2]] for leaf, n in have.items()}
    if total is None:
        shares = sum(aims[s][0] for s in of_source) or 1.0
        total = min((of_source[s] * aims[s][1] * shares / aims[s][0] for s in of_source), default=0.0)
    plan = [(*leaf, int(b / have[leaf] + 1e-12), b - int(b / have[leaf] + 1e-12) * have[leaf]) for leaf, b in budgets(weights, caps, total).items()]
    leaves = sizes.sparkSession.createDataFrame(plan, "domain string, language string, source string, epochs int, rest double")
    key = ["domain", "language", "source"]
    # The order of one epoch more; another seed or number of epochs gives another order.
    rows = sizes.join(F.broadcast(leaves), key).withColumn("draw", F.xxhash64("doc_id", F.lit(seed), "epochs")).withColumn("cell", F.expr(f"pmod(shiftright(draw, 16), {CELLS})"))
    cells = rows.groupBy(*key, "cell").agg(F.sum("n_tokens").alias("in_cell"))
    cells = cells.withColumn("before", F.sum("in_cell").over(Window.partitionBy(*key).orderBy("cell")) - F.col("in_cell"))
    cells = cells.join(F.broadcast(leaves), key).select(*key, "cell", "before", F.when(F.col("before") + F.col("in_cell") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("cut").alias("side"))
    # A fixed number of cells for each leaf.
    rows = rows.join(F.broadcast(cells), [*key, "cell"])
    whole = rows.where("side <> 'cut'").select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(F.col("side") == "in", 1).otherwise(0)).alias("copies"))
    within = F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("draw", "doc_id")) - F.col("n_tokens")
    part = rows.where("side = 'cut'").withColumn("middle", F.col("before") + within + F.col("n_tokens") / 2)
    part = part.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(F.col("middle") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return whole.unionByName(part).where("copies > 0")


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share, most_copies) for each target: the share really reached."""
    of = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    of = of.crossJoin(of.agg(F.sum("tokens").alias("all_tokens")))
    out = targets.select("source", "target_share").join(of, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", zero("documents"), zero("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("share"), zero("most_copies"))
