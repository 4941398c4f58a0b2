"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (domain, language, source) by weights. Each node takes at
most what its leaves can give (their tokens times ``max_epochs``); what it can't take goes to
its siblings by their weights, and only what all siblings can't take goes back up. A leaf's
budget is met by whole seeded epochs and a token prefix of the next: documents in the order
of a hash of seed, epoch and id, until the tokens are used up.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, table

#: Leaves beyond which budgets are worked out node by node in tasks instead of on the driver.
DRIVER_LEAVES = 100_000


def fill(budget: int, caps: list[int], weights: list[Fraction]) -> list[int]:
    """Splits ``budget`` by weights under caps; what a full one can't take goes to the
    others by their weights, and to those of weight 0, evenly, after all others are full. Whole
    numbers, by largest remainder and then by place."""
    out = [0] * len(caps)
    left = min(budget, sum(caps))
    for tier in (True, False):
        open_ = [i for i in range(len(caps)) if (weights[i] > 0) == tier and caps[i] > 0]
        while left and open_:
            w = [weights[i] if tier else Fraction(1) for i in open_]
            whole = sum(w)
            full = [i for i, x in zip(open_, w) if left * x / whole >= caps[i] - out[i]]
            if full:
                taken = sum(caps[i] - out[i] for i in full)
                for i in full:
                    out[i] = caps[i]
                left -= taken
                open_ = [i for i in open_ if i not in set(full)]
                continue
            shares = [left * x / whole for x in w]
            given = [int(s) for s in shares]
            for k in sorted(range(len(open_)), key=lambda k: (given[k] - shares[k], k))[: left - sum(given)]:
                given[k] += 1
            for i, g in zip(open_, given):
                out[i] += g
            left = 0
    return out


def allocate(leaves: dict[tuple, int], budget: int, weights: dict[tuple, float], max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf path. ``leaves`` has the tokens of each; ``weights`` has weights
    of nodes by path (1 where a node has none), compared among siblings."""

    def capacity(prefix: tuple) -> int:
        return sums[prefix]

    sums: dict[tuple, int] = {}
    children: dict[tuple, set] = {}
    for path, tokens in leaves.items():
        for d in range(len(path) + 1):
            sums[path[:d]] = sums.get(path[:d], 0) + tokens * max_epochs
            if d:
                children.setdefault(path[: d - 1], set()).add(path[:d])
    out: dict[tuple, int] = {}
    stack = [((), min(budget, sums.get((), 0)))]
    while stack:
        node, amount = stack.pop()
        if node in leaves:
            out[node] = amount
            continue
        below = sorted(children.get(node, ()))
        parts = fill(amount, [capacity(c) for c in below], [Fraction(weights.get(c, 1.0)).limit_denominator(10**9) for c in below])
        stack += list(zip(below, parts))
    return out


def shares(parents: list[str], name: str, weights: dict[tuple, float]):
    """Splits the amount of one node among its children, given as rows with (path, capacity, amount)."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(name, ignore_index=True)
        above = tuple(rows.iloc[0][p] for p in parents)
        own = [Fraction(weights.get((*above, c), 1.0)).limit_denominator(10**9) for c in rows[name]]
        return rows.assign(amount=fill(int(rows["amount"].iloc[0]), [int(c) for c in rows["capacity"]], own))

    return run


def allocated(leaves: DataFrame, names: list[str], budget: int, weights: dict[tuple, float], max_epochs: int) -> DataFrame:
    """:func:`allocate` level by level in tasks: (names, n, target_tokens) from (names, n) for any
    number of leaves. A task holds the children of one node."""
    amounts = leaves.groupBy().agg(F.least(F.lit(budget), F.coalesce(F.sum("n"), F.lit(0)) * max_epochs).cast("long").alias("amount"))
    for d in range(1, len(names) + 1):
        nodes = leaves.groupBy(*names[:d]).agg((F.sum("n") * max_epochs).cast("long").alias("capacity"))
        rows = nodes.join(amounts, names[: d - 1]) if d > 1 else nodes.join(F.broadcast(amounts))  # one row
        schema = ", ".join(f"`{n}` string" for n in names[:d]) + ", capacity long, amount long"
        rows = rows.select(*names[:d], "capacity", "amount").groupBy(*names[: d - 1]).applyInPandas(shares(names[: d - 1], names[d - 1], weights), schema)
        amounts = stored(rows.select(*names[:d], "amount"), "amounts")
    return leaves.join(amounts, names).withColumnRenamed("amount", "target_tokens")


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    path: dict[str, Column],
    weights: dict[tuple, float],
    budget: int | None = None,
    share: float = 0.5,
    max_epochs: int = 2,
    seed: int = 3,
    driver_leaves: int = DRIVER_LEAVES,
) -> DataFrame:
    """Documents and how often they are used.

    (doc_id, text_key, the path's columns, n_tokens, target_tokens of the leaf, full_epochs,
    prefix_tokens, used_tokens): a document's tokens are used ``full_epochs`` times and then
    the first ``prefix_tokens`` of them once more; rows with no use are left out. The budget
    is in tokens, or ``share`` of all there are. A leaf's used tokens equal its target.

    Null path values are nodes named "". Texts without words have no tokens and are never
    used; a very long text is one document. Rows of one id are told apart by text_key (a hash
    of the text); rows that agree in both follow each other in the order, each of them used.
    Budgets are worked out on the driver for up to ``driver_leaves`` leaves and in tasks beyond
    that, alike. Extra columns are left out; no rows: none.
    """
    spark = docs.sparkSession
    names = list(path)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in path.items()], token_count(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    rows = stored(rows, "tokens")  # a few numbers per document, read several times below
    leaves = stored(rows.groupBy(*names).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("n_docs")), "leaves")
    size = leaves.agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    budget = round(size["n"] * share) if budget is None else budget
    if size["leaves"] <= driver_leaves:
        found = {tuple(r[n] for n in names): (r["n"], r["n_docs"]) for r in leaves.collect()}  # driver_leaves at most
        targets = allocate({leaf: n for leaf, (n, _) in found.items()}, budget, weights, max_epochs)
        schema = ", ".join(f"`{n}` string" for n in names) + ", n long, n_docs long, target_tokens long"
        planned = stored(spark.createDataFrame([(*leaf, *found[leaf], t) for leaf, t in sorted(targets.items())], schema), "targets")
    else:
        planned = stored(allocated(leaves, names, budget, weights, max_epochs), "targets")
    # Cells of a leaf's seeded order: only the one in which the prefix ends is sorted. There are
    # about four times the square root of its documents, so neither they nor a cell grow large.
    bits = F.least(F.greatest(F.ceil(F.log2("n_docs") / 2) + 2, F.lit(4)), F.lit(30)).cast("int")
    leaf_plan = planned.where("n > 0").select(*names, "target_tokens", F.expr("target_tokens div n").alias("full_epochs"), (F.col("target_tokens") % F.col("n")).alias("rest"), bits.alias("bits"))
    # Every leaf's next epoch has an order of its own. The plan is a stored table: Spark
    # broadcasts it if its file is small, and otherwise joins by the leaf, skewed ones split.
    ordered = rows.join(leaf_plan, names).withColumn("place", F.xxhash64(F.lit(seed), "full_epochs", *names, "doc_id", "text_key"))
    celled = ordered.withColumn("cell", F.expr("shiftrightunsigned(place, 64 - bits)"))
    # Where the prefix ends: sums by cell first, then exact sums within one cell of each leaf.
    before = Window.partitionBy(*names).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.where("rest > 0").groupBy(*names, "cell", "rest").agg(F.sum("n_tokens").alias("in_cell")).withColumn("ahead", F.coalesce(F.sum("in_cell").over(before), F.lit(0)))
    ends = stored(cells.where("ahead < rest AND ahead + in_cell >= rest").select(*names, F.col("cell").alias("end_cell"), "ahead"), "ends")
    marked = celled.join(ends, names, "left")  # a row a leaf
    inside = Window.partitionBy(*names).orderBy("place", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.where("cell = end_cell").withColumn("done", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    zero = F.lit(0).cast("long")
    last = last.withColumn("prefix_tokens", F.greatest(zero, F.least(F.col("n_tokens"), F.col("rest") - F.col("done"))))
    others = marked.where("end_cell IS NULL OR cell <> end_cell").withColumn("prefix_tokens", F.when(F.col("cell") < F.col("end_cell"), F.col("n_tokens")).otherwise(zero))
    keep = ["doc_id", "text_key", *names, "n_tokens", "target_tokens", "full_epochs", "prefix_tokens"]
    both = others.select(*keep).unionByName(last.select(*keep))
    return both.withColumn("used_tokens", F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")).where("used_tokens > 0")


#: Of the domains in document_path() and their languages; sources weigh alike.
WEIGHTS: dict[tuple, float] = {
    ("a",): 0.4,
    ("b",): 0.3,
    ("c",): 0.2,
    ("other",): 0.1,
    **{(d, lang): w for d in ("a", "b", "c", "other") for lang, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))},
}


def document_path() -> dict[str, Column]:
    number = F.regexp_extract("source", r"(\d+)$", 1)
    digit = F.when(number != "", F.substring(number, -1, 1).cast("int"))
    domain = F.when(digit <= 3, "a").when(digit <= 6, "b").when(digit <= 8, "c").otherwise("other")
    return {"domain": domain, "language": F.col("lang"), "leaf": F.col("source")}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(table(spark, sf_dir, "documents"), document_path(), WEIGHTS)
    return rows.select("doc_id", "domain", "language", F.col("leaf").alias("source"), "n_tokens", "target_tokens", "full_epochs", "prefix_tokens", "used_tokens")
