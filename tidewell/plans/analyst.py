"""Registered analyst queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import frames
from tidewell.plans import views
from tidewell.plans.registry import documents, query, table


@query("top_n", "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_n(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return frames.top_n(df, "o_totalprice", 10, "o_orderkey")


@query("revenue_by_group", """
    select o_orderpriority, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue
    from orders group by 1""")
def revenue_by_group(spark, sf):
    return frames.group_total(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "revenue")


@query("mean_by_group", """
    select event_type, round(cast(sum(cast(value as decimal(18,2))) as double) / count(value), 6) as mean,
           count(*) as n from events group by 1""")
def mean_by_group(spark, sf):
    return frames.group_mean(table(spark, sf, "events"), "event_type", "value")


@query("rate_by_group", """
    select o_orderpriority, count(*) as n, count_if(o_orderstatus = 'F')::bigint as hits,
           round(count_if(o_orderstatus = 'F') / cast(count(*) as double), 6) as rate from orders group by 1""")
def rate_by_group(spark, sf):
    return frames.rate_by_group(table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("describe_numeric", """
    with s as (select count(o_totalprice) as n,
        round(cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(o_totalprice), 6) as mean,
        round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as low, max(o_totalprice) as high,
        round(quantile_cont(o_totalprice, 0.25), 6) as q25, round(quantile_cont(o_totalprice, 0.5), 6) as median,
        round(quantile_cont(o_totalprice, 0.75), 6) as q75 from orders)
    select *, round(mean - median, 4) as mean_minus_median from s""")
def describe_numeric(spark, sf):
    return frames.describe(table(spark, sf, "orders"), "o_totalprice")


@query("t_statistic", """
    with s as (select count(*) filter (o_orderpriority = '1-URGENT') as n_a,
                      count(*) filter (o_orderpriority = '5-LOW') as n_b,
                      avg(o_totalprice) filter (o_orderpriority = '1-URGENT') as ma,
                      avg(o_totalprice) filter (o_orderpriority = '5-LOW') as mb,
                      var_samp(o_totalprice) filter (o_orderpriority = '1-URGENT') as va,
                      var_samp(o_totalprice) filter (o_orderpriority = '5-LOW') as vb from orders)
    select n_a, n_b, n_a + n_b - 2 as df,
           round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0::double / n_a + 1.0::double / n_b)), 6) as t
    from s""")
def t_statistic(spark, sf):
    return frames.t_statistic(table(spark, sf, "orders"), "o_orderpriority", "1-URGENT", "5-LOW", "o_totalprice")


@query("precision_recall", """
    with c as (select count_if(quality = 1 and toxic = 1)::bigint as tp, count_if(quality <> 1 and toxic = 1)::bigint as fp,
                      count_if(quality = 1 and toxic <> 1)::bigint as fn from labels)
    select tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0)::double, 6), 0) as precision,
           coalesce(round(tp / nullif(tp + fn, 0)::double, 6), 0) as recall from c""")
def precision_recall(spark, sf):
    return frames.precision_recall(table(spark, sf, "labels"), "quality", "toxic")


@query("accuracy_vs_baseline", """
    select count(*) as n, round(count_if(quality = toxic) / count(*)::double, 6) as accuracy,
           round(greatest(count_if(quality = 1), count_if(quality <> 1)) / count(*)::double, 6) as baseline
    from labels""")
def accuracy_vs_baseline(spark, sf):
    return frames.accuracy_against_baseline(table(spark, sf, "labels"), "quality", "toxic")


@query("fill_median", f"""
    with s as ({views.SERIES}), m as (select median(value) as mid from s)
    select event_id, round(coalesce(value, (select mid from m)), 6) as value from s""")
def fill_median(spark, sf):
    s = views.series(spark, sf).select("event_id", "value")
    return frames.fill_with_median(s, "value").select("event_id", F.round("value", 6).alias("value"))


@query("zscore_outliers", """
    with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as d from orders)
    select o_orderkey, round((o_totalprice - (select m from s)) / (select d from s), 6) as z,
           abs((o_totalprice - (select m from s)) / (select d from s)) > 1.5 as is_outlier from orders""")
def zscore_outliers(spark, sf):
    out = frames.zscore_outliers(table(spark, sf, "orders"), "o_totalprice", 1.5)
    return out.select("o_orderkey", F.round("z", 6).alias("z"), "is_outlier")


@query("word_count", """
    select word, count(*) as n
    from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by 1""")
def word_count(spark, sf):
    return frames.word_count(documents(spark, sf), "text")


@query("anagram_groups", """
    with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents),
         k as (select word, array_to_string(list_sort(string_split(word, '')), '') as letters from w)
    select word, letters, count(*) over (partition by letters) as group_size from k""")
def anagram_groups(spark, sf):
    words = documents(spark, sf).select(F.explode(text.letter_words(F.col("text"))).alias("word"))
    return frames.anagram_groups(words, "word")


@query("clean_ages", f"""
    select row_id, case when try_cast(age as double) between 1 and 120 then try_cast(age as double) end as age
    from ({views.DIRTY_CUSTOMER})""")
def clean_ages(spark, sf):
    return frames.clean_ages(views.dirty_customer(spark, sf).select("row_id", "age"), "age")


@query("unique_in_order", """
    select l_partkey, min(l_orderkey * 10 + l_linenumber) as first_position from lineitem group by 1""")
def unique_in_order(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    return frames.unique_in_order(items, "l_partkey", "position")


@query("rolling_mean", f"""
    with s as ({views.SERIES})
    select event_id, user_id,
           case when count(value) over w = 3 then round(avg(value) over w, 6) end as rolling_mean
    from s window w as (partition by user_id order by at_us, event_id rows between 2 preceding and current row)""")
def rolling_mean(spark, sf):
    out = frames.rolling_mean(views.series(spark, sf), ["user_id"], "at_us", "event_id", "value", 3)
    return out.select("event_id", "user_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("merge_intervals", f"""
    with i as ({views.INTERVALS}),
         f as (select *, max(day_to) over (partition by customer order by day_from, day_to
                   rows between unbounded preceding and 1 preceding) as reach from i),
         g as (select *, sum(case when reach is null or day_from > reach then 1 else 0 end)
                   over (partition by customer order by day_from, day_to
                         rows between unbounded preceding and current row) as grp from f)
    select customer, min(day_from) as day_from, max(day_to) as day_to, count(*) as parts from g group by customer, grp""")
def merge_intervals(spark, sf):
    return frames.merge_intervals(views.intervals(spark, sf), "customer", "day_from", "day_to")


_POS = "l_linenumber * 1000000000000000000 + l_partkey * 100000000 + l_suppkey"


@query("two_sum_pairs", f"""
    with l as (select l_orderkey, cast({_POS} as bigint) as pos, l_quantity as v from lineitem),
         p as (select b.l_orderkey, b.pos as j, max(a.pos) as i from l a join l b
               on a.l_orderkey = b.l_orderkey and a.pos < b.pos and a.v + b.v = 51 group by 1, 2)
    select l_orderkey, i, j from p
    where (l_orderkey, j) in (select l_orderkey, min(j) from p group by 1)""")
def two_sum_pairs(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"cast({_POS} as bigint) as pos", "l_quantity as v")
    return frames.two_sum(items, "l_orderkey", "pos", "v", 51.0)


@query("stratified_sample", f"""
    with c as ({views.CHALLENGE}),
         r as (select challenge_id, difficulty, row_number() over (partition by difficulty
               order by cast('0x' || substr(sha256('s1:' || challenge_id), 1, 15) as bigint), challenge_id) as draw from c)
    select challenge_id, difficulty, cast(draw as integer) as draw from r
    where draw <= case difficulty when 'easy' then 2 when 'medium' then 2 else 1 end""")
def stratified_sample(spark, sf):
    out = frames.stratified_sample(
        views.challenge(spark, sf), "difficulty", {"easy": 2, "medium": 2, "hard": 1}, "challenge_id", "s1")
    return out.select("challenge_id", "difficulty", "draw")


@query("train_test_split", """
    with r as (select doc_id, row_number() over (order by cast('0x' || substr(sha256('7:' || doc_id), 1, 15) as bigint),
                      doc_id) as r, count(*) over () as n from documents)
    select doc_id, r <= round_even(n * 0.2::double, 0) as is_test from r""")
def train_test_split(spark, sf):
    return frames.train_test_split(documents(spark, sf).select("doc_id"), "doc_id", 0.2, "7")


@query("filter_map_sort", f"""
    select row_id, full_name from ({views.DIRTY_CUSTOMER})
    where try_cast(age as integer) >= 18 order by full_name, row_id""")
def filter_map_sort(spark, sf):
    people = views.dirty_customer(spark, sf)
    return (people.where(F.col("age").try_cast("int") >= 18).select("row_id", "full_name")
            .orderBy("full_name", "row_id"))


@query("flatten_arrays", """
    select doc_id, cast(len(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')))) as integer) as items
    from documents""")
def flatten_arrays(spark, sf):
    nested = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, " ", -1))
    return documents(spark, sf).select("doc_id", F.size(F.flatten(nested)).alias("items"))


@query("palindromes", r"""
    with w as (select distinct unnest(regexp_extract_all(text, '[\p{L}\p{N}''-]+')) as word from documents)
    select word from w where reverse(lower(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')))
                           = lower(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g'))""")
def palindromes(spark, sf):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0))).alias("word")
    words = documents(spark, sf).select(found).distinct()
    return words.where(text.is_palindrome(F.col("word")))


@query("sql_revenue_by_nation", """
    select n_name, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue
    from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
    where o_orderdate >= timestamp '1995-01-01' group by n_name having count(*) >= 10""")
def sql_revenue_by_nation(spark, sf):
    return spark.sql(
        """
        SELECT n_name, count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue
        FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
        WHERE o_orderdate >= timestamp_ntz '1995-01-01'
        GROUP BY n_name HAVING count(*) >= 10 ORDER BY revenue DESC
        """,
        orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"), nation=table(spark, sf, "nation"),
    )
