"""Reports on tables: counts, frequencies, histograms, box plots, slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.io import settled


def null_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows"), reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns]).alias("n_nulls")).select(F.lit(name).alias("name"), "n_rows", "n_nulls") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def label_frequency(labels: DataFrame, top: int = 20) -> DataFrame:
    return labels.groupBy("article_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "article_id").limit(top)


def label_summary(labels: DataFrame) -> DataFrame:
    """One row: labels in use, and those with one example."""
    return labels.groupBy("article_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_labels"), F.count_if(F.col("n") == 1).alias("n_single"))


def labels_per_query(labels: DataFrame) -> DataFrame:
    """(n_labels, n_queries): how many queries have how many labels."""
    return labels.groupBy("query_id").agg(F.count("*").alias("n_labels")).groupBy("n_labels").agg(F.count("*").alias("n_queries"))


def discrete_histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n, density): a bin for each whole number that occurs."""
    total = df.agg(F.count(column))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / total.scalar())


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, n_words, log_chars): log_chars is log10(n_chars + 1); null texts have null lengths."""
    words = F.size(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != ""))
    n = F.length(text)
    return df.select(key, n.cast("long").alias("n_chars"), F.when(F.col(text).isNotNull(), words).cast("long").alias("n_words"), F.log10(n + 1).alias("log_chars"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n, density) of equal bins between the extremes; the last one is closed."""
    b = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.count(column).alias("total"))
    with_b = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")).withColumn("b", b.select(F.struct("lo", "hi", "total")).scalar())
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    place = F.least(F.floor((F.col("x") - F.col("b.lo")) / F.greatest(width, F.lit(1e-300))), F.lit(bins - 1)).cast("long")
    return with_b.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("w"), F.first("b.total").alias("t")).select("bin", "n", (F.col("n") / (F.col("t") * F.greatest("w", F.lit(1e-300)))).alias("density"))


def quantiles(df: DataFrame, group: str | None, column: str, shares: tuple[float, ...], bins: int = 1024) -> DataFrame:
    """(group, share, quantile): exact quantiles, interpolated between neighbouring ranks; without group one set.

    Ranks are found by narrowing ranges: the values of a rank's range are counted in `bins` equal
    bins, with each bin's extremes, and the bin with the rank is its next range, until that holds
    one value. A task keeps at most `bins` counts for each group and rank, however many values
    differ. Each round reads the table once, with all ranks of all groups. Nulls and NaN have no
    part, the others are finite; a group without values has no row.
    """
    g = F.lit(0) if group is None else F.col(group)
    values = df.select(g.alias("g"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = values.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    places = n.select("g", "n", "low", "high", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    places = settled(places.select("g", "n", "low", "high", "share", "at"))
    ranks = places.select("g", "low", "high", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    ranges = settled(ranks.withColumn("below", F.lit(0).cast("long")))
    while not ranges.where("low < high").isEmpty():
        open_ranges = ranges.where("low < high").withColumnRenamed("g", "rg")
        inside = values.join(F.broadcast(open_ranges), F.col("g").eqNullSafe(F.col("rg")) & F.col("x").between(F.col("low"), F.col("high")))
        place = F.least(F.floor((F.col("x") / bins - F.col("low") / bins) / (F.col("high") / bins - F.col("low") / bins) * bins), F.lit(bins - 1))
        counted = inside.groupBy("g", "rank", "below", place.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("bin"))
        found = counted.withColumn("upto", F.col("below") + upto).withColumn("below", F.col("upto") - F.col("c")).where("below <= rank and rank < upto")
        ranges = settled(found.select("g", "low", "high", "rank", "below").union(ranges.where("low = high").select("g", "low", "high", "rank", "below")))
    value = lambda name: ranges.select(F.col("g").alias("vg"), F.col("rank").alias(f"{name}_rank"), F.col("low").alias(name))
    both = places.join(F.broadcast(value("first")), F.col("g").eqNullSafe(F.col("vg")) & (F.floor("at") == F.col("first_rank"))).drop("vg")
    both = both.join(F.broadcast(value("next")), F.col("g").eqNullSafe(F.col("vg")) & (F.ceil("at") == F.col("next_rank")))
    return both.select(F.col("g").alias(group or "g"), "share", (F.col("first") + (F.col("next") - F.col("first")) * (F.col("at") - F.col("first_rank"))).alias("quantile"))


def boxplot(df: DataFrame, group: str, column: str) -> DataFrame:
    q = quantiles(df, group, column, (0.25, 0.5, 0.75)).groupBy(group).agg(*[F.max(F.when(F.col("share") == p, F.col("quantile"))).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, group).where((F.col(column) >= F.col("q1") - reach) & (F.col(column) <= F.col("q3") + reach))
    return inside.groupBy(group, "q1", "median", "q3").agg(F.min(column).alias("low"), F.max(column).alias("high"))


def quantile_slices(df: DataFrame, by: str, value: str, q: int = 4) -> DataFrame:
    """Mean of `value` in quantile bins of `by`: (lo, hi], the first closed; equal edges are merged."""
    edges = quantiles(df, None, by, tuple(i / q for i in range(q + 1))).agg(F.array_sort(F.collect_set("quantile")).alias("e"))
    rows = df.withColumn("e", edges.scalar())
    place = F.greatest(F.size(F.filter("e", lambda x: x < F.col(by))), F.lit(1)).cast("long")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def worst(df: DataFrame, k: int = 12) -> DataFrame:
    return df.orderBy("ap", F.desc("n_relevant"), "query_id").limit(k)
