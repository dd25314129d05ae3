"""Registered request-log queries.  The SQL twins replay each key's events with a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text
from tidewell.operators import sequences
from tidewell.plans import views
from tidewell.plans.registry import query, table

_LOG = {
    "event_id": "event_id",
    "user_id": "user_id",
    "network": "user_id % 12",
    "browser": "case when user_id % 5 = 0 then 'b' || cast(user_id as string) else '' end",
    "address": "'10.0.0.' || cast(user_id % 12 as string)",
    "outcome": "case when event_type = 'error' and event_id % 7 = 0 then 'trip' when event_type = 'error' then 'failure' "
               "else 'ok' end",
    "question": "event_type",
    "seconds": "cast(60 + event_id % 1800 as bigint)",
    "status": "case when event_type <> 'error' then null when event_id % 9 = 0 then null "
              "else cast(case event_id % 8 when 0 then 401 when 1 then 404 when 2 then 429 when 3 then 503 when 4 then 418 "
              "when 5 then 400 when 6 then 403 else 500 end as integer) end",
    "error_name": "case event_id % 4 when 0 then 'ReadTimeout' when 1 then 'ConnectionError' when 2 then 'ValueError' "
                  "else null end",
}
LOG = f"select {views._as_sql(_LOG)}, epoch_us(ts) as at_us from events"


def log(spark, sf):
    return table(spark, sf, "events").select(
        *[F.expr(e).alias(n) for n, e in _LOG.items()], views.micros("ts").alias("at_us"))


def replay(source: str, key: str, columns: str, start: str, first: str, step: str, state: str) -> str:
    """Recursive SQL over the events of each key: ``start`` is the empty state, ``step`` reads r (before) and e (event)."""
    return f"""
    with recursive e as materialized (select {columns}, {key} as k, row_number() over (partition by {key} order by at_us, event_id) as rn
                         from ({source})),
         r as (select k, cast(0 as bigint) as rn, cast(null as bigint) as event_id, {start}, {first} from (select distinct k from e)
               union all select e.k, e.rn, e.event_id, {state}, {step} from r join e on e.k = r.k and e.rn = r.rn + 1)"""


_DAY = 86_400_000_000
_KEPT = f"list_filter(r.hits, lambda h: e.at_us - h <= {_DAY})"


@query("rate_limit", replay(
    LOG, "user_id", "event_id, user_id, at_us", "[]::bigint[] as hits", "true as allowed",
    f"len({_KEPT}) < 2", f"case when len({_KEPT}) < 2 then list_append({_KEPT}, e.at_us) else {_KEPT} end")
    + " select event_id, allowed from r where rn > 0")
def rate_limit(spark, sf):
    out = sequences.rate_limit(
        log(spark, sf).select("event_id", "user_id", "at_us"), ["user_id"], "at_us", "event_id", 2, 86_400)
    return out.select("event_id", "allowed")


_SEEN = f"list_filter(r.b, lambda h: e.at_us - h.t <= {_DAY})"
_MINE = f"len(list_filter({_SEEN}, lambda h: h.c = e.client))"
_NET = f"list_filter(r.n, lambda h: e.at_us - h <= {_DAY})"
_CLIENT = "'co:' || case when browser = '' then address else browser end as client"


@query("rate_limit_two_level", replay(
    LOG, "network", f"event_id, at_us, {_CLIENT}",
    "[]::struct(c varchar, t bigint)[] as b, []::bigint[] as n, '' as client", "'' as verdict",
    f"e.client, case when {_MINE} >= 3 then 'browser' when len({_NET}) >= 6 then 'network' else 'ok' end",
    f"case when {_MINE} >= 3 then {_SEEN} else list_append({_SEEN}, {{'c': e.client, 't': e.at_us}}) end, "
    f"case when {_MINE} < 3 and len({_NET}) < 6 then list_append({_NET}, e.at_us) else {_NET} end")
    + " select event_id, client, verdict from r where rn > 0")
def rate_limit_two_level(spark, sf):
    rows = log(spark, sf).select(
        "event_id", "network", "at_us",
        text.client_key(F.lit("co"), F.col("browser"), F.col("address")).alias("client"))
    out = sequences.rate_limit_two_level(rows, "network", "client", "at_us", "event_id", 3, 2, 86_400)
    return out.select("event_id", "client", "verdict")


def _held(hold: str) -> tuple[str, str]:
    return "r.until is not null and e.at_us < r.until", f"case when r.until is not null and e.at_us < r.until then r.until else e.at_us + {hold} end"


@query("ttl_reuse", replay(
    LOG, "question", "event_id, at_us", "cast(null as bigint) as until", "false as hit", *_held("1800000000"))
    + " select event_id, hit from r where rn > 0")
def ttl_reuse(spark, sf):
    rows = log(spark, sf).select("event_id", text.question_key(F.lit("co"), F.col("question")).alias("key"), "at_us")
    return sequences.ttl_reuse(rows, ["key"], "at_us", "event_id").select("event_id", "hit")


@query("cache_stats", replay(
    LOG, "question", "event_id, at_us, question", "cast(null as bigint) as until", "false as hit", *_held("1800000000"))
    + f""" select 'all' as cache, count(*) as requests, count_if(hit)::bigint as hits, count_if(not hit)::bigint as misses,
          round(count_if(hit)::double / count(*)::double, 2) as hit_rate,
          least(count(distinct case when not hit then k end), {fixed.MAX_ENTRIES}) as entries from r where rn > 0""")
def cache_stats(spark, sf):
    rows = log(spark, sf).select("event_id", "question", "at_us")
    reused = sequences.ttl_reuse(rows, ["question"], "at_us", "event_id").withColumn("cache", F.lit("all"))
    return sequences.cache_stats(reused, ["cache"], "question")


@query("single_flight", replay(
    LOG, "question", "event_id, at_us, seconds", "cast(null as bigint) as until", "false as shared",
    *_held("e.seconds * 1000000")) + " select event_id, shared from r where rn > 0")
def single_flight(spark, sf):
    rows = log(spark, sf).select("event_id", "question", "at_us", "seconds")
    return sequences.single_flight(rows, ["question"], "at_us", "event_id", "seconds").select("event_id", "shared")


_SHUT = "r.opened is not null and e.at_us - r.opened < 60000000"
_FAILS = "case when e.outcome = 'ok' then 0 when e.outcome = 'trip' then greatest(r.failures, 3) else r.failures + 1 end"


@query("circuit_state", f"""
    with recursive e as materialized (select event_id, at_us, outcome, network as k,
                         row_number() over (partition by network order by at_us, event_id) as rn from ({LOG})),
         r as (select k, cast(0 as bigint) as rn, cast(null as bigint) as event_id, 0 as failures, cast(null as bigint) as opened,
                      true as allowed, cast(0 as bigint) as at_us from (select distinct k from e)
               union all
               select e.k, e.rn, e.event_id, case when {_SHUT} then r.failures else {_FAILS} end,
                      case when {_SHUT} then r.opened when e.outcome = 'ok' then null
                           when r.opened is not null or {_FAILS} >= 3 then e.at_us end,
                      not coalesce({_SHUT}, false), e.at_us
               from r join e on e.k = r.k and e.rn = r.rn + 1)
    select event_id, allowed, case when opened is not null then 'down' when failures > 0 then 'degraded' else 'ok' end as status,
           case when opened is null then 0 else cast(round_even(greatest(0, 60000000 - (at_us - opened)) / 1000000.0::double, 0) as integer) end as retry_in
    from r where rn > 0""")
def circuit_state(spark, sf):
    rows = log(spark, sf).select("event_id", "network", "at_us", "outcome")
    out = sequences.circuit_state(rows, ["network"], "at_us", "event_id", "outcome")
    return out.select("event_id", "allowed", "status", "retry_in")


@query("classify_errors", f"""
    select event_id, case when status in (401, 403) then 'auth' when status in (400, 404, 422) then 'model'
        when status is null and lower(error_name) in ('timeouterror', 'apitimeouterror', 'timeoutexception', 'readtimeout', 'connecttimeout') then 'transient'
        when status is null and lower(error_name) in ('connectionerror', 'apiconnectionerror', 'connecterror', 'gaierror', 'oserror', 'networkerror') then 'network'
        when status in (408, 409, 425, 429) or status >= 500 then 'transient' else 'other' end as error_kind
    from ({LOG}) where outcome <> 'ok'""")
def classify_errors(spark, sf):
    failed = log(spark, sf).where("outcome <> 'ok'")
    return failed.select("event_id", sequences.classify_error(F.col("status"), F.col("error_name")).alias("error_kind"))


@query("lru_hit_analysis", f"""
    with e as (select event_id, network, user_id, row_number() over (partition by network order by at_us, event_id) as rn from ({LOG})),
         p as (select *, lag(rn) over (partition by network, user_id order by rn) as prev from e),
         d as (select a.event_id, count(distinct b.user_id) as between_items from p a join e b
               on a.network = b.network and b.rn > a.prev and b.rn < a.rn group by 1)
    select p.event_id, prev is not null and coalesce(between_items, 0) < 5 as hit from p left join d using (event_id)""")
def lru_hit_analysis(spark, sf):
    rows = log(spark, sf).select("event_id", "network", "user_id", "at_us")
    return sequences.lru_hits(rows, ["network"], "at_us", "event_id", "user_id", 5).select("event_id", "hit")
