"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash of its id (60 bits of MD5). A source's target decides
how often all its documents are taken (whole rounds) and how many words of one more
round: those of the documents below a threshold on the hash. The threshold is found
without sorting: words are summed by source and hash bucket, the running sum shows the
bucket that holds the budget, and only the documents of that boundary bucket are summed
again, by finer buckets, until the boundary is a single hash. Where the document there is
too long for what is left of the budget, the next pass goes on behind it, among those
that are not; PASSES of them bring the sum near, however long single documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from swelter.llm.common import cols, free, scratch, words_of, written

#: Hash bits, and bits told apart at each level: a million buckets, then the hashes themselves of the
#: boundary bucket's documents, a millionth of a source's.
HASH_BITS, LEVELS = 60, (20, 60)
PASSES = 3
CAP = 3
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def hash_of(key: Column, text: Column) -> Column:
    """Of the id; rows without one go by their text, so that they don't all go together."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), text), F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with `target`: weighted shares of all words, capped.

    Sources in code point order, null last, weigh as weights, repeating. All words are
    shared by weight; what a source's cap (cap x its size) cuts off is shared again among
    the others until none is above. Closed form: ordered by cap / weight, the capped
    sources are a prefix, and the rest share what remains. One row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    chosen = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(chosen, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("most", cap * F.col("source_size"))
    level = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, rest = level.rowsBetween(W.unboundedPreceding, -1), level.rowsBetween(0, W.unboundedFollowing)
    water = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    # right at the first source that its share doesn't fill; later ones give lower levels
    at = ranked.withColumn("water", water).withColumn("fits", F.col("water") * F.col("w") <= F.col("most"))
    lowest = at.withColumn("level", F.max(F.when(F.col("fits"), F.col("water"))).over(everything))
    share = F.col("level") * F.col("w")
    return lowest.select("source", "source_size", F.coalesce(F.least(share, F.col("most").cast("double")), F.col("most").cast("double")).alias("target"))


def _boundary(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, at, base, size): the hash of each source at which its running sum passes the budget.

    rows: (source, size, h); budgets: (source, budget). base is the sum below the hash,
    size what it adds. Sources whose sum stays within the budget have no row.
    """
    at = budgets.select("source", "budget", F.lit(0).cast("long").alias("base"))
    for bits in LEVELS:
        prefix = F.shiftright("h", HASH_BITS - bits)
        sums = rows.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("size"))
        running = sums.withColumn("upto", F.sum("size").over(W.partitionBy("source").orderBy("prefix")))
        # one row per source, so a lookup that the optimizer broadcasts when it knows it to be small
        hit = running.join(at.select(F.col("source").alias("_s"), F.col("base").alias("_base"), "budget"), F.col("source").eqNullSafe(F.col("_s")))
        hit = hit.where((F.col("upto") - F.col("size") + F.col("_base") <= F.col("budget")) & (F.col("upto") + F.col("_base") > F.col("budget")))
        at = hit.select("source", "prefix", (F.col("upto") - F.col("size") + F.col("_base")).alias("base"), "size", "budget")
        if bits < HASH_BITS:
            at = written(at, "boundary")
            own = at.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
            rows = written(rows.join(own, F.col("source").eqNullSafe(F.col("_s")) & (prefix == F.col("_p"))).drop("_s", "_p"), "boundary-rows")
    return at.select("source", F.col("prefix").alias("at"), "base", "size")


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, source_size, target, rounds, taken): what one more round takes.

    sized: (source, size, h); plan: (source, source_size, target). taken is an array of at
    most PASSES (first, end, longest): a document is taken if its hash is in [first, end)
    of one of them and its size no more than longest. In the last pass the document at the
    threshold is taken if that brings the sum nearer.
    """
    # whole rounds and the rest; a source that has no words takes nothing
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    todo = plan.withColumn("rounds", rounds)
    state = todo.select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("first"), F.lit((1 << 62)).cast("long").alias("longest"))
    made = []
    for k in range(PASSES):
        named = state.select(F.col("source").alias("_s"), "first", "longest")
        rows = sized.join(named, F.col("source").eqNullSafe(F.col("_s"))).where((F.col("h") >= F.col("first")) & (F.col("size") <= F.col("longest"))).select("source", "size", "h")
        found = _boundary(rows, state).select(F.col("source").alias("_s"), "at", "base", F.col("size").alias("more"))
        state = written(state.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "pass")
        left = F.col("budget") - F.col("base")
        nearer = (left > F.col("more") - left).cast("long") if k == PASSES - 1 else F.lit(0)
        end = F.coalesce(F.col("at") + nearer, F.lit(1 << HASH_BITS))
        made.append(state.select("source", F.struct("first", end.cast("long").alias("end"), "longest").alias("cut")))
        state = state.where(F.col("at").isNotNull()).select("source", left.alias("budget"), (F.col("at") + 1).alias("first"), F.floor(left).cast("long").alias("longest"))
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    taken = every.groupBy(F.col("source").alias("_s")).agg(F.collect_list("cut").alias("taken"))
    return todo.join(taken, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs with `_size`, `_source_size`, `_target` and `_copies` (times the mix takes the row).

    Columns of docs with these four names are replaced, others stay whatever they are
    called. Null texts have size 0; they are taken like others and add nothing. Repeated
    ids have equal hashes and are taken alike if equally long; rows without an id go by
    their text. An empty table gives none. Rows don't move: the cuts, one row per source,
    come by a join that is a broadcast while the optimizer measures them as small.
    """
    spark, results = docs.sparkSession, ("_size", "_source_size", "_target", "_copies")
    with scratch(spark):
        sized = written(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), hash_of(F.col(key), F.col(text)).alias("h")), "sized")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = written(targets(sizes, weights, cap), "targets")
        cut = written(cuts(sized, plan), "cuts", keep=True)
    kept = [c for c in docs.columns if c.lower() not in results]
    name = {c: free(docs.columns, f"_mix_{c}") for c in ("source", "source_size", "target", "rounds", "taken", "size", "h")}
    out = docs.withColumns({name["size"]: n_words(F.col(text)), name["h"]: hash_of(F.col(key), F.col(text))})
    out = out.join(cut.withColumnsRenamed({c: name[c] for c in cut.columns}), F.col(source).eqNullSafe(F.col(name["source"])), "left")
    h, size = F.col(name["h"]), F.col(name["size"])
    more = F.exists(name["taken"], lambda c: (h >= c["first"]) & (h < c["end"]) & (size <= c["longest"]))
    return out.select(*cols(kept), size.alias("_size"), F.col(name["source_size"]).alias("_source_size"), F.col(name["target"]).alias("_target"), (F.col(name["rounds"]) + more.cast("long")).alias("_copies"))
