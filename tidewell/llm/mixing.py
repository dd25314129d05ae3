"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the mixture times the size of the mixture, divided by its
documents.  A document's number of copies is the Poisson variate of that mean whose uniform number is a hash of seed and id:
the cumulative distribution of each source is inverted by counting its steps up to that number.  Documents are exploded by their copies
and dealt out by a hash of seed, id and copy, then sorted by it inside each partition: a global shuffle without a sort of
everything, the same on every run.

Target shares come from a table (source, share) or, without one, are proportional to documents ** ``temperature``.  One row per
source is joined to the documents; Spark broadcasts it only when its written size is small and splits hot sources otherwise.

Defined results: a null source is a source of its own; a source without a target share has none of the mixture; a null id is
hashed as the empty text; null texts are replicated like others; repeated rows have equal copies; a column of the input that is
called like the result column stays, and the result is called ``copy_2`` (or the next free number); an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise

TEMPERATURE = 0.5
SEED = 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(_text(*parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _text(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")


def rates(docs: DataFrame, source: str = "source", shares: DataFrame | None = None, temperature: float = TEMPERATURE,
          epochs: float = 1.0) -> DataFrame:
    """One row per source: ``source``, ``documents``, ``share`` and ``rate``."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    if shares is None:
        sizes = sizes.withColumn("share", F.pow(F.col("documents").cast("double"), F.lit(temperature)))
    else:
        wanted = shares.select(F.col("source").alias("_s"), "share")
        sizes = sizes.join(wanted, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"share": 0.0})
    sizes = materialise(sizes, "sources")
    sums = sizes.agg(F.sum("documents").alias("all"), F.sum("share").alias("total"))
    return sizes.crossJoin(F.broadcast(sums)).select(  # sums is one row
        "source", "documents", (F.col("share") / F.col("total")).alias("share"),
        (F.col("share") / F.col("total") * F.col("all") * F.lit(epochs) / F.col("documents")).alias("rate"))


def poisson_steps(table: DataFrame) -> DataFrame:
    """Add ``steps``: the cumulative distribution of a Poisson variable of mean ``rate``, from 0 on to beyond 12 deviations."""
    each = table.where("rate > 0").withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_k = F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(F.lit(0.0))
    each = each.withColumn("log_fact", F.sum(log_k).over(upto))
    each = each.withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_fact")))
    each = each.withColumn("cdf", F.sum("p").over(upto))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("k", "cdf"))), lambda s: s["cdf"])
    return each.groupBy("source", "rate").agg(steps.alias("steps"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED, copy: str = "copy", **more) -> DataFrame:
    """The mixture: all columns of ``docs`` and ``copy`` (1, 2, ...), in shuffled order."""
    steps = materialise(poisson_steps(rates(docs, source, **more)), "steps")
    steps = steps.select(F.col("source").alias("of"), "steps")
    # the row travels as one value, so no column of it can meet one of the names here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.col(source).alias("source"))
    rows = rows.withColumn("u", uniform(F.lit(seed), F.col("key"))).join(steps, F.col("source").eqNullSafe(F.col("of")))
    count = F.size(F.filter("steps", lambda c: c <= F.col("u")))
    rows = rows.select("row", "key", count.alias("n")).where("n > 0")
    rows = rows.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    rows = rows.select("row", "copy", F.md5(_text(F.lit(seed), F.lit("order"), F.col("key"), F.col("copy"))).alias("at"))
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in [copy, *(f"{copy}_{i}" for i in range(2, 3 + len(taken)))] if n.lower() not in taken)
    return rows.repartition("at").sortWithinPartitions("at").select("row.*", F.col("copy").alias(name))


def oracle() -> str:
    return f"""
        with sizes as (select source, count(*) as documents, pow(count(*), {TEMPERATURE}) as share from documents group by source),
        rates as (
            select source, share / (select sum(share) from sizes) * (select sum(documents) from sizes) / documents as rate
            from sizes),
        k as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) as k from rates),
        p as (
            select source, k, exp(k * ln(rate) - rate - sum(case when k > 0 then ln(k) else 0 end) over (
                partition by source order by k)) as p
            from k),
        cdf as (select source, sum(p) over (partition by source order by k) as cdf from p),
        u as (
            select *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / pow(2, 52) as u
            from documents),
        counts as (
            select u.doc_id, u.text, u.lang, u.source, u.n_chars,
                (select count(*) from cdf where cdf.source is not distinct from u.source and cdf.cdf <= u.u) as n
            from u)
        select doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::int as copy from counts where n > 0"""
