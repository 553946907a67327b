"""Quality rules whose cutoffs are chosen with a controlled risk of rejecting good documents.

Per rule the cutoffs form a chain from lenient to strict. On labelled documents, the
false rejections (documents labelled good that a cutoff would reject) are counted per
stratum; the exact binomial test of "the rate is above alpha" rejects at level
delta / (strata x rules) (Bonferroni across chains, fixed-sequence testing within one:
a chain is walked from its lenient end and stops at the first cutoff that is not
certified). Every chosen cutoff thus has, jointly with probability 1 - delta, a false
rejection rate of at most alpha = risk / rules, and all rules together at most risk.
Everything is DataFrame operations: features are row-local, the counts one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swelter.llm.common import cols, hidden, let, scratch, words_of, written

SYMBOLS, CAPITALS = r"[#*$%&|<>]", r"[A-Z\x{C0}-\x{D6}\x{D8}-\x{DE}]+"

#: rule: (statistic of the features, cutoffs from lenient to strict); a document is
#: rejected when its statistic is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (1.0, 0.6, 0.45, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
    "capitals": ("n_capitals / greatest(word_chars, 1)", (0.99, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5)),
    "long_words": ("word_chars / greatest(n_words, 1)", (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0)),
}
COUNTS = ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words", "n_symbols", "n_capitals")
RISK, DELTA = 0.02, 0.05


def repeat_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more (row-local, no shuffle).

    One lookahead pattern over the words joined by blanks gives every window's text.
    Windows that are all distinct (a hash set tells) end there; others are sorted with
    their places, equal neighbours are repeats, and overlapping places are merged by
    the gaps between them. words must be bound by let().
    """
    # tried at words' beginnings only: the last two words, however long, cost one look each
    windows = F.regexp_extract_all(F.array_join(words, " "), F.lit(r"(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++"), F.lit(1))

    def covered(texts: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(texts.alias("t"), F.sequence(F.lit(0), F.size(texts) - 1).alias("p")))
        return let(pairs, lambda s: let(places(s), merged))

    def places(s: Column) -> Column:
        # neighbours before and behind, null at the ends
        around = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.struct(a["p"].alias("p"), (a["t"] == b["t"]).alias("next")))
        return let(around, lambda a: F.sort_array(F.filter(F.transform(a, lambda x, k: F.when(x["next"] | F.coalesce(F.get(a, k - 1)["next"], F.lit(False)), x["p"])), lambda p: p.isNotNull())))

    def merged(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def counted(texts: Column) -> Column:
        return F.when(F.size(F.array_distinct(texts)) == F.size(texts), F.lit(0)).otherwise(covered(texts))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more column, the struct `_q` of the COUNTS that the rules use.

    Row-local. Null and blank texts have 0 for every count. Lines are those with a word;
    a duplicate line is one equal to an earlier line.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    # one struct of all counts: fields taken from it later don't compute it anew
    of = lambda w, x: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(w).alias("n_repeat_words"),
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        count(SYMBOLS).alias("n_symbols"),
        count(CAPITALS).alias("n_capitals"),
    )
    return docs.withColumn("_q", let(words_of(t), lambda w: let(lines, lambda x: of(w, x))))


def statistics() -> Column:
    """Array of (rule, value), one for each rule, from `_q`."""

    def value(formula: str) -> Column:
        for n in COUNTS:
            formula = formula.replace(n, f"_q.{n}")
        return F.expr(formula).cast("double")

    return F.array(*[F.struct(F.lit(rule).alias("rule"), value(formula).alias("value")) for rule, (formula, _) in RULES.items()])


def certified(n: Column, k: Column, alpha: float, level: Column) -> Column:
    """P(Binomial(n, alpha) <= k) <= level: the exact test that the rate is below alpha."""
    log_odds = math.log(alpha / (1 - alpha))
    start = F.struct((n * math.log1p(-alpha)).alias("log_p"), F.exp(n * math.log1p(-alpha)).alias("cdf"))

    def step(acc: Column, j: Column) -> Column:
        log_p = acc["log_p"] + F.log((n - j + 1) / j) + log_odds
        return F.struct(log_p.alias("log_p"), (acc["cdf"] + F.exp(log_p)).alias("cdf"))

    # more false rejections than the mean can't be certified, so the sum stays short
    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda acc: acc["cdf"])
    return F.when((n == 0) | (k > n * alpha), F.lit(False)).otherwise(tail <= level)


def thresholds(featured: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row (stratum, rule, cutoff, n, k) per stratum and rule with a certified cutoff.

    featured: documents with `_q`; labels: (key, label 0/1). Null labels and labels of
    other values take no part; of a document labelled twice each row counts. Strata are
    the values of the column, null among them. No labels: no rows, so nothing is rejected.
    """
    alpha = risk / len(RULES)
    good = labels.where(F.col(label) == 1).select(F.col(key).alias("_key"))
    marked = featured.select(F.col(key).alias("_key"), F.col(stratum).alias("stratum"), statistics().alias("_s")).join(good, "_key").select("stratum", F.explode("_s").alias("s"))
    cuts = F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*[F.array(*map(F.lit, c)) for _, c in RULES.values()]))
    # how many cutoffs of the chain reject the document: those below its value
    hits = F.size(F.filter(F.element_at(cuts, F.col("s.rule")), lambda c: c >= F.col("s.value")))
    counts = marked.groupBy("stratum", F.col("s.rule").alias("rule"), hits.alias("spared")).agg(F.count("*").alias("n"))
    rows = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("spared", "n")).alias("by"))
    n_chains = rows.select(F.count("*").alias("m"))
    size = F.size(F.element_at(cuts, F.col("rule")))
    tested = (
        rows.withColumn("m", n_chains.scalar())
        .withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
        # cutoff i is rejected by documents that spare no more than the i cutoffs before it
        .withColumn("k", F.aggregate(F.filter("by", lambda b: b["spared"] <= F.col("i")), F.lit(0).cast("long"), lambda acc, b: acc + b["n"]))
        .withColumn("ok", certified(F.col("n"), F.col("k"), alpha, F.lit(delta) / F.col("m")))
    )
    chain = tested.groupBy("stratum", "rule", "n").agg(F.array_sort(F.collect_list(F.struct("i", "ok", "k"))).alias("c"))
    first_bad = F.coalesce(F.get(F.filter("c", lambda x: ~x["ok"]), F.lit(0))["i"], F.size("c"))
    return chain.withColumn("last", first_bad - 1).where("last >= 0").select(
        "stratum", "rule", F.get(F.element_at(cuts, F.col("rule")), F.col("last")).alias("cutoff"), "n", F.get("c", F.col("last"))["k"].alias("k")
    )


def apply_cutoffs(featured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """featured with `_rules` (the certified rules that reject) and `_base_failed`.

    cutoffs has at most rules x certified strata rows, and a stratum needs hundreds of
    labels to be certified; it reaches the rows as one map out of a scalar subquery, not
    by a join, so rows never move. Strata without a cutoff are judged by the base alone.
    """
    pairs = F.collect_list(F.struct(F.concat_ws("\x00", _name(F.col("stratum")), "rule"), "cutoff"))
    table = cutoffs.agg(F.map_from_entries(pairs).alias("m"))
    out = featured.withColumn("_m", table.scalar())
    above = F.filter(statistics(), lambda s: s["value"] > F.element_at(F.col("_m"), F.concat_ws("\x00", _name(F.col(stratum)), s["rule"])))
    return out.withColumn("_rules", F.transform(above, lambda s: s["rule"])).withColumn("_base_failed", base_failed()).drop("_m")


def _name(stratum: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v:"), stratum.cast("string")), F.lit("null"))


def base_failed() -> Column:
    return (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that neither the base nor a certified rule rejects, columns unchanged.

    The counts are made once and written beside the rows; the calibration reads the
    narrow columns of that table, the verdict all of it. Texts are never shuffled.
    Repeated rows are judged alike; null doc_id rows take no part in the calibration.
    Columns of any name stay as they are.
    """
    safe, back = hidden(docs, ("_q", "_m", "_rules", "_base_failed"))
    counted = written(features(safe), "counted")
    with scratch(docs.sparkSession):
        cutoffs = written(thresholds(counted.select("doc_id", stratum, "_q"), labels, stratum, risk, delta), "cutoffs", keep=True)
    out = apply_cutoffs(counted, cutoffs, stratum)
    return out.where((F.size("_rules") == 0) & ~F.col("_base_failed")).select(*cols(safe.columns)).withColumnsRenamed(back)
