"""Registered streaming queries.  Each must give what its batch twin gives on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text, values
from tidewell.operators import packing, sequences, support
from tidewell.plans import duck, requests, texts, views
from tidewell.plans import support as desk
from tidewell.plans.registry import ORACLES, query
from tidewell.streaming import jobs


DAY = 86_400  # seconds of a bucket of waiting rows


def _events(spark, sf, *columns):
    """Request log as a stream with event time and a ten-minute watermark."""
    stream = jobs.file_stream(spark, sf, "events.parquet")
    stream = stream.withColumn("seen_at", F.timestamp_micros(views.micros("ts"))).withWatermark("seen_at", "10 minutes")
    return stream.select(
        *[F.expr(requests._LOG[c]).alias(c) for c in columns], views.micros("ts").alias("at_us"), "seen_at")


@query("rate_limit_stream", ORACLES["rate_limit"])
def rate_limit_stream(spark, sf):
    stream = _events(spark, sf, "event_id", "user_id")
    rule = sequences.limit_rule("at_us", "event_id", 2, 86_400)
    return jobs.run_rule(stream, ["user_id"], rule, "at_us", 86_400, "rate-limit", DAY).table.select("event_id", "allowed")


@query("ttl_reuse_stream", ORACLES["ttl_reuse"])
def ttl_reuse_stream(spark, sf):
    stream = _events(spark, sf, "event_id", "question")
    rule = sequences.hold_rule("at_us", "event_id")
    return jobs.run_rule(stream, ["question"], rule, "at_us", 1800, "ttl-reuse", DAY).table.select("event_id", "hit")


@query("single_flight_stream", ORACLES["single_flight"])
def single_flight_stream(spark, sf):
    stream = _events(spark, sf, "event_id", "question", "seconds")
    rule = sequences.hold_rule("at_us", "event_id", "seconds", "shared")
    return jobs.run_rule(stream, ["question"], rule, "at_us", 3600, "single-flight", DAY).table.select("event_id", "shared")


@query("rate_limit_two_level_stream", ORACLES["rate_limit_two_level"])
def rate_limit_two_level_stream(spark, sf):
    stream = _events(spark, sf, "event_id", "network", "browser", "address")
    stream = stream.select("event_id", "network", "at_us", "seen_at",
                           text.client_key(F.lit("co"), F.col("browser"), F.col("address")).alias("client"))
    rule = sequences.two_level_rule("client", "at_us", "event_id", 3, 2, 86_400)
    run = jobs.run_rule(stream, ["network"], rule, "at_us", 86_400, "two-level", DAY)
    return run.table.select("event_id", "client", "verdict")


@query("circuit_state_stream", ORACLES["circuit_state"])
def circuit_state_stream(spark, sf):
    stream = _events(spark, sf, "event_id", "network", "outcome")
    run = jobs.run_rule(stream, ["network"], sequences.breaker_rule("at_us", "event_id", "outcome"), "at_us", None, "circuit", DAY)
    return run.table.select("event_id", "allowed", "status", "retry_in")


def _messages(spark, sf):
    users = jobs.file_stream(spark, sf, "conversations.parquet").where("role = 'user'")
    return users.selectExpr(*[f"{e} as {n}" for n, e in views._MESSAGES.items()])


_FLOW_ONLY = desk._FLOW.split("order by turn) as rn from found),")[1]


@query("escalation_stream", f"""
    with recursive base as materialized (select conv_id, turn, reason, mail, row_number() over (partition by conv_id order by turn) as rn
             from (select conv_id, turn, {desk._reason_sql()} as reason, {duck.first_email('message')} as mail from ({views.MESSAGES}))),
    {_FLOW_ONLY} select conv_id, turn, action, ticket_reason from flow where rn > 0""")
def escalation_stream(spark, sf):
    """Turns are judged in the order in which they were asked, whatever batch brings them."""
    rows = _messages(spark, sf).select(
        "conv_id", "turn", support.escalation_reason(F.col("message")).alias("reason"),
        text.first_email(F.col("message")).alias("mail"), (F.col("asked_at") * 1_000_000).alias("at_us"))
    rows = rows.withColumn("seen_at", F.timestamp_micros("at_us")).withWatermark("seen_at", "1 day")
    run = jobs.run_rule(rows, ["conv_id"], sequences.escalation_rule("turn", "reason", "mail"), "at_us", None, "escalation", DAY)
    return run.table.select("conv_id", "turn", "action", "ticket_reason")


_SPOKEN = texts._MARKUP


@query("dialogue_stream", f"""
    with clean as (select conv_id, turn, role as speaker, {_SPOKEN} as t from conversations),
         p as (select *, {texts._fold(texts._split('t'), "a.u <> '' and length(a.u) + length(b.u) + 1 > 420")} as f from clean where t <> ''),
         q as (select *, case when length(t) <= 420 then [t] else list_transform(
               case when f.u <> '' then list_append(f.c, f.u) else f.c end, lambda x: substr(x, 1, 420)) end as parts from p)
    select conv_id, turn, speaker, cast(generate_subscripts(parts, 1) - 1 as integer) as part, unnest(parts) as text from q""")
def dialogue_stream(spark, sf):
    """Conversations as scripts that arrive turn by turn."""
    turns = jobs.file_stream(spark, sf, "conversations.parquet")
    said_at = F.expr(f"({views._MESSAGES['asked_at']}) * 1000000")
    pieces = turns.select("conv_id", "turn", F.concat(F.upper("role"), F.lit(": "), "text", F.lit("\n")).alias("piece"), said_at.alias("at_us"))
    pieces = pieces.withColumn("seen_at", F.timestamp_micros("at_us")).withWatermark("seen_at", "1 day")
    roles = ["user", "assistant", "system"]
    run = jobs.run_rule(pieces, ["conv_id"], jobs.dialogue_rule("turn", "piece", roles), "at_us", None, "dialogue", DAY)
    done = jobs.released_turns(run.table, ["conv_id"])
    return jobs.spoken(done.unionByName(jobs.open_turns(run.states, ["conv_id"], roles)), ["conv_id"])


@query("strip_think_stream", texts._SHOWN)
def strip_think_stream(spark, sf):
    """Pieces of answers as a stream; the filter's state is carried from batch to batch."""
    answers = jobs.file_stream(spark, sf, "documents.parquet").selectExpr("doc_id", f"{views._THINKING} as answer")
    pieces = texts._cut(answers).withColumn("n", F.coalesce("n", F.lit(0)))
    pieces = pieces.withColumn("at_us", (F.lit(1_704_067_200).cast("bigint") + F.col("n") % 86_400) * 1_000_000)
    pieces = pieces.withColumn("seen_at", F.timestamp_micros("at_us")).withWatermark("seen_at", "1 day")
    run = jobs.run_rule(pieces, ["doc_id"], packing.think_rule("n", "piece"), "at_us", None, "think", DAY)
    return packing.joined(run.table, ["doc_id"], "n").select("doc_id", F.md5("text").alias("shown_md5"))


@query("topic_counts_stream", f"""
    select reason as topic, count(*) as count from (select {desk._reason_sql()} as reason from ({views.MESSAGES})) where reason is not null group by 1""")
def topic_counts_stream(spark, sf):
    """Running count of escalation topics."""
    reasons = _messages(spark, sf).select(support.escalation_reason(F.col("message")).alias("topic"))
    return jobs.running_counts(reasons.where("topic is not null"), "topic", "topic-counts")


@query("audit_stream", f"""
    select strftime(make_timestamp(asked_at * 1000000), '%Y-%m-%d') as day, conv_id, turn, {duck.redact('message')} as message
    from ({views.MESSAGES})""")
def audit_stream(spark, sf):
    """Messages redacted before they are written; exactly once through the checkpointed file sink."""
    day = F.date_format(values.utc_moment(F.col("asked_at")), "yyyy-MM-dd")
    rows = _messages(spark, sf).select(day.alias("day"), "conv_id", "turn", text.redact(F.col("message")).alias("message"))
    return jobs.run_to_table(rows, "audit")


@query("event_feed", "select event_id, event_type, cast(user_id as bigint) as user_id from events")
def event_feed(spark, sf):
    """One typed event per row, from a file stream to a file sink."""
    feed = jobs.file_stream(spark, sf, "events.parquet").select("event_id", "event_type", "user_id")
    return jobs.run_to_table(feed, "feed")
