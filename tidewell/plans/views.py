"""Inputs derived from the driver tables, as Spark frames and as the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.registry import documents, narrow, table

# Expressions that read the same in Spark SQL and DuckDB: one text serves both engines.
_DIRTY = {
    "row_id": "k * 2 + copy",
    "id": "cast(k * 2 + copy as string)",
    "full_name": "case when copy = 1 then upper(c_name) when k % 5 = 0 then '  ' || lower(c_name) || ' ' "
                 "when k % 5 = 1 then upper(c_name) when k % 5 = 2 then 'N/A' else c_name end",
    "email": "case k % 7 when 0 then 'User' || cast(k as string) || '@Example.COM' "
             "when 1 then 'user' || cast(k as string) || '@' when 2 then 'unknown@unknown.com' when 3 then '-' "
             "else 'user' || cast(k as string) || '@example.com' end",
    "phone": "case k % 6 when 0 then '082 ' || lpad(cast(k % 10000000 as string), 7, '0') when 1 then '0000000000' "
             "when 2 then '+27 73 ' || lpad(cast(k % 10000000 as string), 7, '0') "
             "when 3 then '2771' || lpad(cast(k % 10000000 as string), 7, '0') when 4 then '12345' "
             "else '+44 20 7946 ' || lpad(cast(k % 10000 as string), 4, '0') end",
    "signup_date": "case when k % 11 = 0 then '31/02/2024' when k % 4 = 0 then cast(1 + k % 28 as string) || '/' || "
                   "cast(1 + k % 12 as string) || '/2024' when k % 4 = 1 then '2024/' || cast(1 + k % 12 as string) "
                   "|| '/' || cast(1 + k % 28 as string) when k % 4 = 2 then 'April ' || cast(1 + k % 28 as string) "
                   "|| ' 2024' else '2024-03-15' end",
    "monthly_spend": "case when k % 13 = 0 then 'abc' when k % 4 = 0 then 'R' || "
                     "cast(cast(c_acctbal as decimal(12,2)) as string) "
                     "else cast(cast(c_acctbal as decimal(12,2)) as string) end",
    "age": "cast(k % 130 - 1 as string)",
    "gender": "case k % 5 when 0 then 'M' when 1 then 'female' when 2 then 'F' when 3 then 'Male' else '-' end",
    "province": "case k % 6 when 0 then 'GP' when 1 then 'western cape' when 2 then 'KwaZulu Natal' "
                "when 3 then 'North-West' when 4 then 'GAUTENG' else 'Free  State' end",
    "segment": "case k % 3 when 0 then lower(c_mktsegment) when 1 then c_mktsegment "
               "else ' ' || upper(c_mktsegment) end",
}


def _as_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in columns.items())


# Every fiftieth customer was entered twice, the second time in upper case and under a new id.
_COPIES_DUCK = (
    "select *, c_custkey as k, unnest(case when c_custkey % 50 = 0 then [0, 1] else [0] end)::bigint as copy from customer"
)
DIRTY_CUSTOMER = f"select {_as_sql(_DIRTY)} from (select *, c_custkey as k, 0::bigint as copy from customer)"
DIRTY_RECORDS = f"select {_as_sql(_DIRTY)} from ({_COPIES_DUCK})"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return narrow(table(spark, sf, "customer").selectExpr("c_custkey as k", "c_name", "c_acctbal", "c_mktsegment"))


def dirty_customer(spark: SparkSession, sf: str) -> DataFrame:
    base = _customers(spark, sf).withColumn("copy", F.lit(0).cast("bigint"))
    return base.selectExpr(*[f"{e} as {n}" for n, e in _DIRTY.items()])


def dirty_records(spark: SparkSession, sf: str) -> DataFrame:
    base = _customers(spark, sf).withColumn("copy", F.expr("explode(case when k % 50 = 0 then array(0L, 1L) else array(0L) end)"))
    return base.selectExpr(*[f"{e} as {n}" for n, e in _DIRTY.items()])


_MESSAGE = (
    "text || case (conv_id + turn) % 9 when 0 then ' I want a refund' "
    "when 1 then ' my name is Sam Mokoena, customer' || cast(conv_id as string) || '@example.com' "
    "when 2 then ' Help!!!' "
    "when 3 then ' This is Lerato customer' || cast(conv_id as string) || '@example.com please escalate' "
    "else '' end"
)
_MESSAGES = {
    "conv_id": "conv_id",
    "turn": "turn",
    "company_id": "'src' || cast(conv_id % 20 as string)",
    "customer_id": "case when (conv_id + turn) % 9 in (1, 3, 4) then cast(null as string) "
                   "when (conv_id + turn) % 9 = 5 then 'nobody' else cast(conv_id as string) end",
    "asked_at": "cast(1704067200 + conv_id * 3600 + turn * 60 as bigint)",
    "message": _MESSAGE,
}
MESSAGES = f"select {_as_sql(_MESSAGES)} from conversations where role = 'user'"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.selectExpr(*[f"{e} as {n}" for n, e in _MESSAGES.items()])


_CLIENTS = {
    "customer_id": "cast(c_custkey as string)",
    "name": "c_name",
    "email": "'customer' || cast(c_custkey as string) || '@example.com'",
    "plan": "c_mktsegment",
    "billing_current": "c_acctbal >= 0",
}
CLIENTS = f"select {_as_sql(_CLIENTS)} from customer"


def clients(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(*[f"{e} as {n}" for n, e in _CLIENTS.items()])


KB = r"""
    select doc_id, array_to_string(list_slice(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 6), ' ') as title,
           text, source as company_id, case when doc_id % 3 = 0 then 'about ' || lang end as category from documents"""


def kb(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.regexp_extract("text", r"\A(?:\S*+\s++){0,5}+\S*+", 0)  # six words, without a walk over the whole text
    first = F.regexp_replace(lead, r"\s+", " ")
    category = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("about "), "lang"))
    return documents(spark, sf).select(
        "doc_id", first.alias("title"), "text", F.col("source").alias("company_id"), category.alias("category"))


_SERIES = {
    "event_id": "event_id",
    "user_id": "user_id",
    "value": "case when event_id % 17 = 0 then null else value end",
}
SERIES = f"select {_as_sql(_SERIES)}, epoch_us(ts) as at_us from events"


def micros(column: str = "ts") -> F.Column:
    """Microseconds since 1970 of a time-zone-free timestamp, whatever the session time zone."""
    c = F.col(column)
    whole = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return whole.cast("bigint")


def series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        *[F.expr(e).alias(n) for n, e in _SERIES.items()], micros("ts").alias("at_us"))


INTERVALS = """
    select o_custkey as customer, cast(date_diff('day', timestamp '1970-01-01', o_orderdate) as integer) as day_from,
           cast(date_diff('day', timestamp '1970-01-01', o_orderdate) + o_orderkey % 10 as integer) as day_to from orders"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), day.alias("day_from"),
        (day + F.col("o_orderkey") % 10).cast("int").alias("day_to"))


_CHALLENGE = {
    "challenge_id": "p_partkey",
    "track": "case p_partkey % 4 when 0 then 'python' when 1 then 'datascience' when 2 then 'java' else 'spring' end",
    "kind": "case when p_partkey % 2 = 0 then 'mcq' when p_partkey % 5 = 0 then 'rubric' else 'code' end",
    "difficulty": "case p_size % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end",
    "title": "p_name",
    "prompt": "p_brand || ' ' || p_type",
    "answer": "cast(p_partkey % 4 as integer)",
    "rubric": "cast(2 + p_size % 4 as integer)",
    "explanation": "'Because of ' || p_brand",
    "solution": "p_type",
    "hints": "cast(p_size % 3 as integer)",
}
CHALLENGE = f"select {_as_sql(_CHALLENGE)} from part"


def challenge(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*[f"{e} as {n}" for n, e in _CHALLENGE.items()])


_SUBMISSION = {
    "submission_id": "l_orderkey * 10 + l_linenumber",
    "learner": "l_suppkey",
    "challenge_id": "l_partkey",
    "choice": "cast(l_orderkey % 4 as integer)",
    "hints_used": "cast(l_linenumber % 3 as integer)",
    "revealed": "l_returnflag = 'R'",
    "checks": "cast(1 + l_linenumber as integer)",
    "checks_passed": "cast(l_orderkey % (2 + l_linenumber) as integer)",
}
SUBMISSION = f"select {_as_sql(_SUBMISSION)} from lineitem"


def submission(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} as {n}" for n, e in _SUBMISSION.items()])


# A document as a tagged script: every third line opens a turn of one speaker, every third of the other, the rest continue.
SPEAKERS = ["host", "guest"]


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    tagged = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.when(i % 3 == 1, F.concat(F.lit("**Host:** "), line))
        .when(i % 3 == 2, F.concat(F.lit("- guest : (laughs) "), line)).otherwise(line))
    return documents(spark, sf).select("doc_id", F.array_join(tagged, "\n").alias("script"))


DIALOGUE = """
    select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
        case (i - 1) % 3 when 1 then '**Host:** ' || line when 2 then '- guest : (laughs) ' || line else line end), chr(10)) as script
    from documents"""

_THINKING = (
    "case doc_id % 3 when 0 then substr(text, 1, 20) || '<think>plan ' || substr(text, 21, 30) || '</think>' || substr(text, 21) "
    "when 1 then substr(text, 1, 40) || ' a < b <think>' || substr(text, 41) else text end"
)
THINKING = f"select doc_id, {_THINKING} as answer from documents"


def thinking(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).selectExpr("doc_id", f"{_THINKING} as answer")
