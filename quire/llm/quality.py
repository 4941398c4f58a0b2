"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Each rule compares one statistic of a text with a cutoff. Labelled good documents choose
the cutoffs: within a stratum, a cutoff that rejects k of n of them is admissible if the
exact binomial tail P(Bin(n, limit / rules) <= k) is at most ``delta`` / (strata x rules).
That corrects for testing over strata and rules (Bonferroni); within a rule the cutoffs are
tested from lenient to strict up to the first that fails (a fixed sequence, and k only
grows along it), which needs no correction. The strictest admissible cutoff of each rule is
used, so with confidence 1 - ``delta`` the rules together reject at most ``limit`` of the
good documents of every stratum. A stratum without enough labels gets no cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table

#: Rule: (statistic, candidate cutoffs from lenient to strict). Larger values are worse.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01]),
    "dup_lines": ("n_dup_lines / greatest(n_word_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "long_words": ("word_chars / greatest(n_words, 1)", [20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5]),
    "short_words": ("-word_chars / greatest(n_words, 1)", [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0]),
}
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8


def text_stats(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_word_lines and n_repeat_words.

    Whole texts; a null text has no words. Words that stand in an eight-word window found
    at least twice in the text, its first place included, count as repeated. Windows are
    compared by 64-bit hashes of their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    base = docs.select(*carry, words.alias("w"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("l"))
    counted = base.select(
        *carry,
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_word_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        ).alias("h"),
    )
    # Only texts with a window twice need its places: few, and sorted within their row.
    twice = F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.arrays_zip("h", F.sequence(F.lit(1), F.size("h")).alias("i"))))
    placed = counted.withColumn("s", twice).drop("h")
    starts = F.filter("s", lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)))
    places = F.array_sort(F.transform(starts, lambda x: x["i"]))
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x + WINDOW - a["end"])).cast("long").alias("n"), (x + WINDOW).cast("int").alias("end")),
        lambda a: a["n"],
    )
    spread = placed.withColumn("p", F.when(F.col("s").isNotNull(), places)).drop("s")
    return spread.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series at x + 10: exact to about 1e-14."""
    z = x + 10
    series = (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    for i in range(10):
        series = series - F.log(x + i)
    return series


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(Bin(n, p) <= k), exactly: the terms from k down, until they no longer count.

    Past the mode the tail is reported as 0 (a probability of about a half or more)."""
    k, n = k.cast("double"), n.cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p) + 60)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: F.log(a["s"]),
    )
    return F.when(k >= n * p, F.lit(0.0)).otherwise(first + total)


def statistics(stats: DataFrame, rules: dict) -> DataFrame:
    return stats.withColumns({f"rule_{name}": F.expr(sql) for name, (sql, _) in rules.items()})


def choose_cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "stratum", rules: dict = RULES, limit: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected): the strictest admissible cutoffs.

    ``stats`` has doc_id, the stratum and what the rules read; ``labels`` has doc_id and
    quality. The holdout are the good labelled documents (quality 1; null labels and ids
    don't count, a document labelled twice counts once, as good only if all its labels
    say so) that pass the base rules. An id counts once in a stratum, however many rows have
    it, at its largest value of each rule: rows of one id are no independent trials. All
    labelled documents are used, none is sampled.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = statistics(stats.where(~base_failed()), rules).join(good, "doc_id", "left_semi")
    held = held.groupBy(stratum, "doc_id").agg(*[F.max(f"rule_{name}").alias(f"rule_{name}") for name in rules])
    tests = [F.sum((F.col(f"rule_{name}") > c).cast("long")).alias(f"{name}_{i}") for name, (_, cuts) in rules.items() for i, c in enumerate(cuts)]
    counts = held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n_good"), *tests)
    flat = [F.struct(F.lit(name).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{name}_{i}").alias("n_rejected")) for name, (_, cuts) in rules.items() for i, c in enumerate(cuts)]
    # Strata are counted before the rows are spread out.
    rows = counts.withColumn("n_strata", F.count(F.lit(1)).over(_all())).select(stratum, "n_good", "n_strata", F.inline(F.array(*flat)))
    safe = log_binomial_tail(F.col("n_rejected"), F.col("n_good"), limit / len(rules)) <= F.log(F.lit(delta) / (F.col("n_strata") * len(rules)))
    return rows.where(safe).groupBy(stratum, "rule").agg(F.min(F.struct("cutoff", "n_good", "n_rejected")).alias("c")).select(stratum, "rule", "c.*")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # one row per stratum


def apply_rules(stats: DataFrame, cutoffs: DataFrame, stratum: str = "stratum", rules: dict = RULES) -> DataFrame:
    """Adds ``failed_rules`` array<string> and ``kept``."""
    wide = cutoffs.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}") for name in rules])
    # One row per stratum; Spark broadcasts it only below its own size limit.
    wide = wide.withColumnRenamed(stratum, "cut_for")  # made from stats too: its column needs a name of its own
    joined = statistics(stats, rules).join(wide, F.col(stratum).eqNullSafe(F.col("cut_for")), "left").drop("cut_for")
    failed = F.filter(F.array(*[F.when(F.col(f"rule_{name}") > F.col(f"cut_{name}"), F.lit(name)) for name in rules]), lambda x: x.isNotNull())
    drop = [f"{kind}_{name}" for name in rules for kind in ("rule", "cut")]
    return joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*drop)


def judge(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, the statistics, base_failed, failed_rules, kept.

    The stratum is ``lang`` unless given; null is a stratum of its own. Null and empty texts
    have no words and fail the base rules; very long ones are read whole. Repeated rows are
    judged alike. No labels: only the base rules judge. No rows: no rows. Extra columns are left out.
    """
    stratum = F.col("lang") if stratum is None else stratum
    rules = options.get("rules", RULES)
    stats = stored(text_stats(docs.select("doc_id", "text", F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum")), "doc_id", "stratum"), "stats")
    return apply_rules(stats, choose_cutoffs(stats, labels.select("doc_id", "quality"), **options), rules=rules)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _op8_sql(limit: float = 0.05, delta: float = 0.05) -> str:
    """The same in DuckDB, the binomial tail term by term."""
    n_rules = len(RULES)
    tests = ", ".join(f"('{name}', {float(c)!r}::DOUBLE)" for name, (_, cuts) in RULES.items() for c in cuts)
    values = ", ".join(f"({sql})::DOUBLE AS rule_{name}" for name, (sql, _) in RULES.items())
    pick = "CASE rule " + " ".join(f"WHEN '{name}' THEN rule_{name}" for name in RULES) + " END"
    p = limit / n_rules
    failed = " || ".join(f"CASE WHEN rule_{name} > cut_{name} THEN ',{name}' ELSE '' END" for name in RULES)
    cuts = ", ".join(f"max(cutoff) FILTER (rule = '{name}') AS cut_{name}" for name in RULES)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs
), windows AS (
  SELECT id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM split, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i) WHERE len(w) >= {WINDOW}
), twice AS (
  SELECT id, i FROM windows WINDOW x AS (PARTITION BY id, s) QUALIFY count(*) OVER x > 1
), repeated AS (
  SELECT id, count(DISTINCT j) AS n FROM twice, LATERAL (SELECT unnest(range(i, i + {WINDOW})) AS j) GROUP BY id
), stats AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_word_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN repeated r USING (id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM stats
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), held AS (
  SELECT stratum, doc_id, {", ".join(f"max(rule_{name}) AS rule_{name}" for name in RULES)} FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum, doc_id
), tests(rule, cutoff) AS (VALUES {tests}
), counts AS (
  SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER ({pick} > cutoff) AS k FROM held, tests GROUP BY ALL
), tails AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}::DOUBLE) + (n - i) * ln(1 - {p!r}::DOUBLE)))) AS tail FROM counts
), strata AS (SELECT count(DISTINCT stratum) AS n FROM held
), chosen AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM tails WHERE tail <= {delta!r}::DOUBLE / ((SELECT n FROM strata) * {n_rules}) GROUP BY stratum, rule
), wide AS (SELECT stratum, {cuts} FROM chosen GROUP BY stratum
), verdicts AS (SELECT j.*, substr({failed}, 2) AS failed_rules FROM judged j LEFT JOIN wide USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM verdicts
"""


OP8_SQL = _op8_sql()
