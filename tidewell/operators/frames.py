"""Everyday table operators for analysts: top rows, fills, ratios, rolling values, intervals, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text, values
from tidewell.operators import skew


def ratio(top: Column, bottom: Column, default: float = 0.0) -> Column:
    """Division that gives ``default`` when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(default))


def exact_sum(c, places: int = 2) -> Column:
    """Sum in decimal, so the result does not depend on the order of the rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(f"decimal(18,{places})")).cast("double")


def top_n(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(column), F.asc(tie)).limit(n)


def fill_with_median(df: DataFrame, column: str) -> DataFrame:
    middle = skew.quantile(df, column, 0.5)
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(middle).cast("double")))


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Population z-score; nothing is an outlier when all values are equal."""
    mean = df.select(F.avg(column)).scalar()
    spread = df.select(F.stddev_pop(column)).scalar()
    z = F.when(spread == 0, F.lit(0.0)).otherwise((F.col(column) - mean) / F.nullif(spread, F.lit(0.0)))
    return df.withColumn("z", z).withColumn("is_outlier", F.abs(F.col("z")) > threshold)


def group_total(df: DataFrame, group: str, value: str, name: str = "total") -> DataFrame:
    return df.groupBy(group).agg(exact_sum(value).alias(name)).orderBy(F.desc(name), group)


def group_mean(df: DataFrame, group: str, value: str, name: str = "mean") -> DataFrame:
    return df.groupBy(group).agg(
        F.round(exact_sum(value) / F.count(value), 6).alias(name), F.count(F.lit(1)).alias("n")
    )


def rate_by_group(df: DataFrame, group: str, flag: Column) -> DataFrame:
    hits = F.count_if(flag)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.round(ratio(hits, F.count(F.lit(1))), 6).alias("rate")
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, spread and exact quartiles in one row, with the gap between mean and median."""
    n = df.select(F.count(column)).first()[0]
    q25, q50, q75 = skew.quantiles(df, column, [0.25, 0.5, 0.75], n)
    row = df.agg(
        F.count(column).alias("n"),
        F.round(exact_sum(column) / F.count(column), 6).alias("mean"),
        F.round(F.stddev_samp(column), 4).alias("std"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
    )
    fixed = {"q25": q25, "median": q50, "q75": q75}
    for name, v in fixed.items():
        row = row.withColumn(name, F.round(F.lit(v).cast("double"), 6))
    return row.withColumn("mean_minus_median", F.round(F.col("mean") - F.col("median"), 4))


def t_statistic(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """Two-sample t statistic under equal variances."""
    v = F.col(value)
    side = {"a": F.when(F.col(group) == a, v), "b": F.when(F.col(group) == b, v)}
    s = df.where(F.col(group).isin(a, b)).agg(
        *[f(side[k]).alias(f"{n}_{k}") for k in side for n, f in
          (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    free = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / free
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return s.select("n_a", "n_b", free.alias("df"), F.round(t, 6).alias("t"))


def precision_recall(df: DataFrame, truth: str, guess: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(guess) == 1
    c = df.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")
    )
    return c.select(
        "tp", "fp", "fn",
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
    )


def accuracy_against_baseline(df: DataFrame, truth: str, guess: str) -> DataFrame:
    n = F.count(F.lit(1))
    ones = F.count_if(F.col(truth) == 1)
    return df.agg(
        n.alias("n"),
        F.round(ratio(F.count_if(F.col(truth) == F.col(guess)), n), 6).alias("accuracy"),
        F.round(ratio(F.greatest(ones, n - ones), n), 6).alias("baseline"),
    )


def word_count(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(text.letter_words(F.col(column))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def anagram_groups(words: DataFrame, column: str) -> DataFrame:
    """Each distinct word with the sorted letters it shares and the size of its group, as rows."""
    letters = F.array_join(F.array_sort(F.split(F.col(column), "")), "")
    keyed = words.select(F.col(column).alias("word")).distinct().select("word", letters.alias("letters"))
    sizes = keyed.groupBy("letters").agg(F.count(F.lit(1)).alias("group_size"))
    sizes = sizes.withColumn("_n", F.col("group_size"))
    return skew.lookup_join(keyed, sizes, ["letters"], "_n")


def unique_in_order(df: DataFrame, column: str, position: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(position).alias("first_position"))


def clean_ages(df: DataFrame, column: str) -> DataFrame:
    age = values.parse_number(F.col(column))
    return df.withColumn(column, F.when(age.between(1, 120), age))


def rolling_mean(
    df: DataFrame, keys: list[str], position: str, tie: str, value: str, window: int,
    part_rows: int = skew.PART_ROWS,
) -> DataFrame:
    """Mean of the last ``window`` values per key; null until that many rows exist or when one of them is missing.

    A hot key is cut into consecutive pieces; each piece also gets the ``window - 1`` rows before it.
    """
    order = [F.col(position), F.col(tie)]
    rows = skew.with_lookback(df, keys, position, tie, window - 1, part_rows)
    frame = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(-(window - 1), 0)
    full = F.count(value).over(frame) == window
    out = rows.withColumn("rolling_mean", F.when(full, F.avg(value).over(frame)))
    return out.where(~F.col("_extra")).drop("_extra", "_part")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, part_rows: int = skew.PART_ROWS) -> DataFrame:
    """Join touching or overlapping intervals of each key.  ``start`` and ``end`` are numbers.

    Intervals that start together are one from the outset, so a key has one row per start and can be cut anywhere.
    """
    starts = df.groupBy(key, start).agg(F.max(end).alias(end), F.count(F.lit(1)).alias("_same"))
    rows, was_split = skew.split_hot(starts, [key], start, part_rows)
    before = Window.partitionBy(key, "_part").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    if was_split:
        rows = skew.with_carried(rows, [key], skew.carried(rows, [key], max_end=F.max(end)))
        reach = F.greatest(reach, F.col("_before_max_end"))
    rows = rows.withColumn("_reach", reach)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    rows = rows.withColumn("_open", F.when(opens, F.col(start)))
    upto = Window.partitionBy(key, "_part").orderBy(start).rowsBetween(Window.unboundedPreceding, 0)
    group = F.max("_open").over(upto)
    if was_split:
        again = rows.select(key, "_part", start, end, "_same", "_open")
        rows = skew.with_carried(again, [key], skew.carried(again, [key], max_open=F.max("_open")))
        group = F.coalesce(group, F.col("_before_max_open"))
    return (
        rows.withColumn("_group", group)
        .groupBy(key, F.col("_group").alias(start))
        .agg(F.max(end).alias(end), F.sum("_same").alias("parts"))
    )


def two_sum(df: DataFrame, key: str, position: str, value: str, target: float) -> DataFrame:
    """First pair found when each key's values are read in order: smallest later position, nearest earlier partner.

    Values that can pair up share a class, so aggregates per class find the answer and no pairs are built.
    """
    v, other = F.col(value), F.lit(target) - F.col(value)
    low, high = F.least(v, other), F.greatest(v, other)
    typed = df.select(key, position, value, low.alias("_low"), (v == low).alias("_is_low"), (low == high).alias("_twin"))
    classes = typed.groupBy(key, "_low", "_twin").agg(
        F.min(F.when(F.col("_is_low"), F.col(position))).alias("_a"),
        F.min(F.when(~F.col("_is_low"), F.col(position))).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    # a class of equal halves needs its second position; the others need both sides
    halves = skew.lookup_join(
        typed.where("_twin").select(key, "_low", position), classes.where("_twin").select(key, "_low", "_a", "_n"),
        [key, "_low"], "_n")
    seconds = halves.where(F.col(position) > F.col("_a")).groupBy(key).agg(F.min(position).alias("j"))
    firsts = classes.where(~F.col("_twin") & F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        key, F.greatest("_a", "_b").alias("j")
    )
    best = firsts.unionByName(seconds).groupBy(key).agg(F.min("j").alias("j"))
    at_j = df.select(key, F.col(position).alias("j"), F.col(value).alias("_vj")).join(best, [key, "j"], "left_semi")
    return (
        skew.spread_join(df, at_j, key)
        .where((F.col(value) == F.lit(target) - F.col("_vj")) & (F.col(position) < F.col("j")))
        .groupBy(key, "j")
        .agg(F.max(position).alias("i"))
    )


def draw_key(c: Column, seed: str) -> Column:
    """A stable pseudo-random 60-bit number per row id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stratified_sample(df: DataFrame, stratum: str, wanted: dict[str, int], row_id: str, seed: str) -> DataFrame:
    """Draw a fixed number of rows per stratum; the same seed draws the same rows."""
    sizes = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    order = Window.partitionBy(stratum).orderBy(draw_key(F.col(row_id), seed), row_id)
    most = max(wanted.values())
    ranked = df.where(F.col(stratum).isin(*wanted)).withColumn("draw", F.row_number().over(order))
    ranked = ranked.where(F.col("draw") <= most)
    return ranked.where(F.col("draw") <= F.try_element_at(sizes, F.col(stratum)))


def train_test_split(df: DataFrame, row_id: str, test_ratio: float, seed: str) -> DataFrame:
    """Mark exactly round(n * ratio) rows as test rows.

    The cut is the exact k-th smallest draw key, so rows are marked in one pass without a global sort.
    """
    n = df.count()
    k = round(n * test_ratio)
    keyed = df.withColumn("_draw", draw_key(F.col(row_id), seed))
    if k == 0:
        return keyed.drop("_draw").withColumn("is_test", F.lit(False))
    cut = skew.order_statistics(keyed, "_draw", [k - 1])[0]
    below = keyed.where(F.col("_draw") < cut).count()
    ties = [r[0] for r in keyed.where(F.col("_draw") == cut).orderBy(row_id).select(row_id).limit(k - below).collect()]
    test = (F.col("_draw") < cut) | ((F.col("_draw") == cut) & F.col(row_id).isin(ties))
    return keyed.withColumn("is_test", test).drop("_draw")
