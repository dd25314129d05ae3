"""Building blocks that keep their shape when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise

HEAVY_KEYS = 1000
PART_ROWS = 1_000_000


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], weight: str | None = None) -> DataFrame:
    """Left join to a table with one row per key, safe when few keys hold most of the left rows.

    ``weight`` names a column of ``right`` with the number of left rows per key.  The ``HEAVY_KEYS`` heaviest keys are
    broadcast (that many rows at most), so their left rows never meet in one task; any other key holds less than
    1/HEAVY_KEYS of the rows and takes the ordinary join.  Left rows that the broadcast side already served get a
    salted key there, so they spread instead of meeting under one null.
    """
    if weight is None:
        return left.join(right, on, "left")
    values = [c for c in right.columns if c not in on and c != weight]
    heavy = right.orderBy(F.desc(weight), *on).limit(HEAVY_KEYS)
    heavy = heavy.select(*[F.col(c).alias(f"_h_{c}") for c in on + values], F.lit(True).alias("_served"))
    light = right.select(*[F.col(c).alias(f"_l_{c}") for c in on + values], F.lit(0).alias("_salt_r"))
    first = left.join(F.broadcast(heavy), [left[c].eqNullSafe(F.col(f"_h_{c}")) for c in on], "left")
    salt = F.when(F.col("_served"), F.lit(1) + F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(4096)))
    first = first.withColumn("_salt_l", F.coalesce(salt, F.lit(0)).cast("int"))
    both = first.join(
        light, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in on] + [F.col("_salt_l") == F.col("_salt_r")], "left"
    )
    out = [F.when(F.col("_served"), F.col(f"_h_{c}")).otherwise(F.col(f"_l_{c}")).alias(c) for c in values]
    return both.select(*[F.col(c) for c in left.columns], *out)


def equal_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by equal columns in which a null key equals a null key; the columns ``on`` are those of the left side."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [left[c].eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def spread_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join to a table unique by ``on``.

    Spark splits a key that holds very many left rows when it sees the shuffle; rows without a key match nothing and
    would all meet in one place, so they are spread by a second, salted key.
    """
    salt = F.when(F.col(on).isNull(), 1 + F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(4096))).otherwise(0)
    keyed = left.withColumn("_salt", salt.cast("int"))
    return keyed.join(right.withColumn("_salt", F.lit(0)), [on, "_salt"], "left").drop("_salt")


BROADCAST_KEYS = 1 << 20


def only_wanted(rows: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """The rows whose key is wanted, picked where they are read, so that wide rows nobody asks for are not shuffled.

    Distinct keys are broadcast, BROADCAST_KEYS at most; if more are wanted, all rows go on.  ``wanted`` is read twice.
    """
    keys = wanted.select(on).distinct()
    return rows if keys.count() > BROADCAST_KEYS else rows.join(F.broadcast(keys), on, "left_semi")


def split_hot(
    df: DataFrame, keys: list[str], position: str, part_rows: int = PART_ROWS, tie: str | None = None
) -> tuple[DataFrame, bool]:
    """Add ``_part``: consecutive pieces, by ``position`` and ``tie``, of every key with more than ``part_rows`` rows.

    Rows of hot keys are dealt out by ranges of (key, position, tie), which Spark draws from a sample of them, and are written
    out with the number of their range, so a lost executor cannot change a row's piece.  Many rows on one position
    are cut by their ties.  Keys of normal size stay whole in piece 0.  Returns the frame and whether any key was split.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows)
    hot = materialise(hot, "hot-keys")
    if hot.isEmpty():
        return df.withColumn("_part", F.lit(0)), False
    pieces = hot.agg(F.sum(F.ceil(F.col("_n") * 1.5 / part_rows))).first()[0]
    marked = lookup_join(df, hot.withColumn("_hot", F.lit(True)), keys, "_n")
    ranges = marked.where("_hot").drop("_hot").repartitionByRange(int(pieces), *keys, position, *([tie] if tie else []))
    cut = materialise(ranges.withColumn("_part", F.spark_partition_id() + 1), "hot-pieces")
    return cut.unionByName(marked.where("_hot is null").drop("_hot").withColumn("_part", F.lit(0))), True


def with_lookback(
    df: DataFrame, keys: list[str], position: str, tie: str, rows_back: int, part_rows: int = PART_ROWS
) -> DataFrame:
    """Cut hot keys into pieces (``_part``) and give each piece the ``rows_back`` rows before it, marked ``_extra``.

    A window over ``keys`` and ``_part`` that looks back at most ``rows_back`` rows is then exact for every other row.
    """
    rows, was_split = split_hot(df, keys, position, part_rows, tie)
    rows = rows.withColumn("_extra", F.lit(False))
    if not was_split or rows_back < 1:
        return rows
    ends = Window.partitionBy(*keys, "_part").orderBy(F.desc(position), F.desc(tie))
    tails = rows.withColumn("_r", F.row_number().over(ends)).where(F.col("_r") <= rows_back).drop("_r")
    # the last rows of all earlier pieces, seen from the first row of each piece
    order = [F.col(position), F.col(tie)]
    seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows_back, -1)
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    packed = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    lead = (
        tails.withColumn("_lead", F.collect_list(packed).over(seen))
        .withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") == 1)
        .select(*keys, "_part", F.explode("_lead").alias("_l"))
        .select(*keys, "_l.*", "_part", F.lit(True).alias("_extra"))
    )
    return rows.unionByName(lead)


def carried(df: DataFrame, keys: list[str], **parts: Column) -> DataFrame:
    """For each piece of a split key: aggregates over all of the key's earlier pieces.

    ``parts`` maps a name to an aggregate whose partial results combine under ``max`` (``max_*``) or ``sum``
    (``sum_*``).  The window runs over one row per piece, so even the hottest key brings a few thousand rows.
    """
    per_part = df.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in parts.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    out = [
        (F.max(n) if n.startswith("max_") else F.coalesce(F.sum(n), F.lit(0))).over(before).alias(f"_before_{n}")
        for n in parts
    ]
    return per_part.select(*keys, "_part", *out)


def with_carried(df: DataFrame, keys: list[str], carry: DataFrame) -> DataFrame:
    return equal_join(df, carry, [*keys, "_part"], "left")


def sessions(df: DataFrame, keys: list[str], position: str, tie: str, quiet: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Add ``_session``, the position at which the row's stretch without a gap of more than ``quiet`` began.

    Hot keys are cut into pieces; every piece sees the last row before it and the last stretch that began before it.
    """
    rows = with_lookback(df, keys, position, tie, 1, part_rows)
    if "_part" not in rows.columns:
        rows = rows.withColumn("_part", F.lit(0))
    order = Window.partitionBy(*keys, "_part").orderBy(position, tie)
    gap = F.col(position) - F.lag(position).over(order)
    rows = rows.withColumn("_open", F.when(gap.isNull() | (gap > quiet), F.col(position))).where(~F.col("_extra"))
    rows = materialise(rows.drop("_extra"), "stretches")
    rows = with_carried(rows, keys, carried(rows, keys, max_open=F.max("_open")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    began = F.coalesce(F.max("_open").over(upto), F.col("_before_max_open"))
    return rows.withColumn("_session", began).drop("_open", "_before_max_open", "_part")


def order_statistics(df: DataFrame, column: str, ranks: list[int], small: int = 20_000) -> list:
    """Exact values at 0-based ``ranks`` of a numeric column, nulls left out, without a global sort.

    All ranks share the passes.  A pass asks for approximate quantiles around each rank (values that occur) and counts the
    rows below, at and above them exactly; the part that holds the rank goes on.  A part of ``small`` rows or fewer is
    decided by its value counts, and a value that fills the rank itself ends the search, so ties and
    infinities cost nothing.  NaN counts as the largest value.  The driver sees counts only.
    """
    base = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    v = F.col("v")
    floats = dict(base.dtypes)["v"] in ("double", "float")
    nan = F.count_if(F.isnan("v")) if floats else F.lit(0)
    n, n_nan = base.agg(F.count("v"), nan).first()
    numbers = base.where(~F.isnan("v")) if floats else base
    found = {r: float("nan") if n - n_nan <= r < n else None for r in set(ranks)}
    # a part: rank inside it, its rows, and conditions that bound it
    parts = {r: (r, n - n_nan, F.lit(True)) for r in found if r < n - n_nan}
    while parts:
        few = {r: p for r, p in parts.items() if p[1] <= small}
        if few:
            inside = [p[2] for p in few.values()]
            marks = F.array(*[F.when(c, F.lit(r)) for r, c in zip(few, inside, strict=True)])
            counts = numbers.where(F.array_max(marks).isNotNull()).groupBy("v", marks.alias("m")).count().collect()
            for r, (left, _, _) in few.items():
                for value, k in sorted((row["v"], row["count"]) for row in counts if r in row["m"]):
                    if left < k:
                        found[r] = value
                        break
                    left -= k
        parts = {r: p for r, p in parts.items() if p[1] > small}
        if not parts:
            break
        around = numbers.agg(*[
            F.percentile_approx(F.when(c, v), [max(0.0, left / rows - 2e-4), left / rows, min(1.0, left / rows + 2e-4)], 10_000)
            for left, rows, c in parts.values()]).first()
        tests = []
        for (_, _, c), (low, mid, high) in zip(parts.values(), around, strict=True):
            low, mid, high = F.lit(low), F.lit(mid), F.lit(high)
            tests += [c & (v < low), c & (v >= low) & (v < mid), c & (v == mid), c & (v > mid) & (v <= high), c & (v > high)]
        counted = numbers.agg(*[F.count_if(t) for t in tests]).first()
        after = {}
        for i, (r, (left, _, _)) in enumerate(parts.items()):
            for test, rows in zip(tests[5 * i:5 * i + 5], counted[5 * i:5 * i + 5], strict=True):
                if left < rows:
                    after[r] = (left, rows, test)
                    break
                left -= rows
            if test is tests[5 * i + 2]:
                found[r] = around[i][1]
                del after[r]
        parts = after
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, column: str, probabilities: list[float], total: int | None = None) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours, all from the same passes."""
    n = total if total is not None else df.select(F.count(column)).first()[0]
    if n == 0:
        return [None] * len(probabilities)
    at = [p * (n - 1) for p in probabilities]
    pairs = [(int(a), min(int(a) + 1, n - 1)) for a in at]
    ranks = sorted({r for pair in pairs for r in pair})
    value = dict(zip(ranks, order_statistics(df, column, ranks), strict=True))
    out = []
    for a, (low, high) in zip(at, pairs, strict=True):
        x, y = float(value[low]), float(value[high])
        out.append(x if x == y or a == low else x + (y - x) * (a - low))
    return out


def quantile(df: DataFrame, column: str, probability: float, total: int | None = None) -> float | None:
    return quantiles(df, column, [probability], total)[0]
