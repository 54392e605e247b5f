"""Mixing sources to target weights by hash thresholds.

Every document has a hash; a source's budget is met by a threshold under which its documents are taken once
more than the others. The threshold is found by histograms: sizes are summed by source and by the leading bits
of the hash, the bucket in which the budget ends is refined by the next bits, and so on until that bucket holds
one hash. Nothing is sorted but the buckets of a source, and thresholds are nested: a larger budget takes all
that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalspark.llm.shared import free_names, written

#: Weights of the sources in turn, what they share of all sizes, how often a document may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
HASH_BITS, STEP = 60, 10
WORD = r"[^\x20\x09-\x0D]+"


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """id, source, size in words, and the hash of the id (of the text where that is null)."""
    key = F.coalesce(F.col(id_column).cast("string"), F.col(text), F.lit(""))
    return df.select(F.col(id_column).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), hash_of(key).alias("h"))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """``totals`` (source, source_size) with ``target``: the sources in the order of their names, null last, get
    the weights in turn and share ``share`` times all sizes by weight; a target stops at ``most`` times its
    source's size and what it can't use goes to the others by weight. The level at which that ends is found
    over the sources sorted by size for each weight. A table of one row per source stands in one task here."""
    every = Window.partitionBy()
    listed = totals.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    listed = listed.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[(F.col("k") - 1) % len(weights)])
    listed = listed.withColumn("full", most * F.col("source_size").cast("double")).withColumn("at", F.col("full") / F.col("w"))
    before = Window.orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    listed = listed.withColumn("level", left / weight)
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "k", "level"))).over(every)["level"]
    return listed.withColumn("found", F.coalesce(level, F.lit(float("inf")))).select("source", "source_size", F.least("full", F.col("found") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (source, target, source_size) with ``base``, how often every document of the source is taken,
    and ``under``, the hash below which it is taken once more."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = wanted.withColumn("base", base).withColumn("left", F.col("target") - F.col("base") * F.col("source_size"))
    state = wanted.where("left > 0").select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("left"))
    rows, found = sized, []
    for shift in range(HASH_BITS - STEP, -1, -STEP):
        bucket = F.shiftright("h", shift)
        if shift < HASH_BITS - STEP:
            rows = sized.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP) == F.col("prefix"))).select("source", "size", "h")
        counted = rows.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        running = counted.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("b")))
        ends = running.join(state, F.col("source").eqNullSafe(F.col("s"))).where("upto - size < left and left <= upto")
        step = written(ends.select("s", F.col("b").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("size"))).alias("left"), "size", "low", "high"), "thresholds")
        found.append(step.where("low = high" if shift else "true").select("s", F.when(F.col("size") - F.col("left") < F.col("left"), F.col("low") + 1).otherwise(F.col("low")).alias("under")))
        state = step.where("low < high").select("s", "prefix", "left")
        if state.isEmpty():
            break
    ended = found[0]
    for more in found[1:]:
        ended = ended.union(more)
    under = F.when(F.col("left") <= 0, F.lit(0)).otherwise(F.coalesce("under", F.lit(1 << HASH_BITS)))
    return wanted.join(ended, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "base", under.cast("long").alias("under"))


def cuts(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target and thresholds of every source (column ``s``)."""
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    wanted = written(targets(totals, weights, share, most), "targets")
    return written(thresholds(sized, wanted), "cuts").withColumnRenamed("source", "s")


def mix(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """One row per input row: the id, ``size``, ``source_size`` and ``target`` of its source, and ``taken``, the
    words that the mix takes of it: its size times how often it is taken, ``most`` times at most. What a source
    gives is as near its target as whole documents allow.

    A null text has size 0; a null source is a source, the last one; rows with equal ids (or, with null ids,
    equal texts) share a hash and so are taken alike; an empty table gives an empty result; other columns are
    not read. The text is read once; a hot source is summed in every task before the shuffle, and its rows are
    not gathered. The thresholds, a row for each source, are joined as Spark chooses from the size of their file: sent to
    all tasks while they are small, and by source beyond that.
    """
    sized = written(sizes(df, id_column, source, text), "sizes")
    cut = cuts(sized, weights, share, most)
    both = sized.join(cut, F.col("source").eqNullSafe(F.col("s")))
    taken = F.col("size") * (F.col("base") + (F.col("h") < F.col("under")).cast("long"))
    return both.select(F.col("id").alias(id_column), "size", "source_size", "target", taken.cast("long").alias("taken"))


def with_shares(df: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = REPEATS) -> DataFrame:
    """The rows of ``df`` with all their columns and those of :func:`mix`; own columns of these names are
    replaced. Nulls, repeats and empty tables as there. The thresholds come from a first pass over the texts; these are
    not shuffled while the thresholds are small enough to be sent to all tasks (some hundred thousand sources)."""
    cut = cuts(written(sizes(df, id_column, source, text), "sizes"), weights, share, most)
    own = df.drop("size", "source_size", "target", "taken")
    key = F.coalesce(F.col(id_column).cast("string"), F.col(text), F.lit(""))
    size, h, s, total, target, base, under = free_names(df, "own_size", "own_hash", "cut_source", "cut_size", "cut_target", "cut_base", "cut_under")
    side = cut.select(F.col("s").alias(s), F.col("source_size").alias(total), F.col("target").alias(target), F.col("base").alias(base), F.col("under").alias(under))
    measured = own.withColumns({size: word_count(F.col(text)), h: hash_of(key)})
    both = measured.join(side, F.col(source).cast("string").eqNullSafe(F.col(s)))
    times = F.col(base) + (F.col(h) < F.col(under)).cast("long")
    return both.select(*[F.col(f"`{c}`") for c in own.columns], F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(target).alias("target"), (F.col(size) * times).cast("long").alias("taken"))
