"""Support-conversation analytics: lookup, escalation, tickets, replies, topics, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import contact, text, values
from tidewell.operators import skew


def lookup_customer(requests: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer of a request: by id when one is given (unknown ids stay empty), else by the first e-mail in the text."""
    dim = customers.select(*[F.col(c).alias(f"found_{c}") for c in customers.columns])
    email = F.when(F.col("customer_id").isNull(), text.first_email(F.col("message")))
    keyed = requests.withColumn("_key", F.coalesce(
        F.concat(F.lit("id:"), "customer_id"), F.concat(F.lit("mail:"), email)))
    by_id = dim.withColumn("_key", F.concat(F.lit("id:"), "found_customer_id"))
    by_mail = dim.withColumn("_key", F.concat(F.lit("mail:"), F.lower("found_email")))
    return skew.spread_join(keyed, by_id.unionByName(by_mail), "_key").drop("_key")


def account_status(found: DataFrame) -> DataFrame:
    known = F.col("found_customer_id").isNotNull()
    return found.select(
        "*", F.when(known, "active").alias("status"), F.when(known, F.col("found_plan")).alias("plan"),
        F.when(known, F.col("found_billing_current")).alias("billing_current"),
    )


def escalation_reason(message: Column, billing_current: Column | None = None) -> Column:
    """Why a message needs a person, or null.  The first listed phrase decides."""
    low = F.lower(message)
    phrases = reduce(
        lambda chain, term: chain.when(low.contains(term), f"Escalation phrase detected: '{term}'"),
        fixed.URGENT_TERMS[1:],
        F.when(low.contains(fixed.URGENT_TERMS[0]), f"Escalation phrase detected: '{fixed.URGENT_TERMS[0]}'"),
    )
    angry = reduce(lambda a, w: a | low.contains(w), fixed.ANGRY_WORDS, F.regexp_count(message, F.lit("!")) >= 3)
    unpaid = F.lit(False) if billing_current is None else F.coalesce(~billing_current, F.lit(False))
    return F.coalesce(phrases, F.when(angry, fixed.R_TONE), F.when(unpaid, fixed.R_BILLING))


def ticket_id(prefix: str, *parts: Column) -> Column:
    """Stable id of a ticket, so a rerun writes the same one."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8)))


def tickets(escalated: DataFrame, prefix: str = "TICKET") -> DataFrame:
    """``escalated``: company_id, conv_id, turn, message, asked_at, reason, customer_name, customer_email."""
    return escalated.select(
        "company_id", ticket_id(prefix, F.col("conv_id"), F.col("turn")).alias("ticket_id"), "conv_id", "turn",
        F.lit("open").alias("status"), "reason", "asked_at",
        F.date_format(values.utc_moment(F.col("asked_at")), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.coalesce("customer_name", F.lit("Customer")).alias("customer_name"),
        F.coalesce("customer_email", F.lit("")).alias("customer_email"),
        F.substring(text.trim_all(F.col("message")), 1, 200).alias("issue"),
    )


def draft_reply(name: Column, escalated: Column, ticket: Column, title: Column, body: Column) -> Column:
    """The reply to a turn: escalated, answered from a source, or neither."""

    def fill(template: str, **parts: Column) -> Column:
        for part, value in parts.items():
            template = F.replace(F.lit(template) if isinstance(template, str) else template, F.lit("{" + part + "}"), value)
        return template

    who = F.coalesce(name, F.lit(fixed.REPLY_NOBODY))
    return (
        F.when(escalated, fill(fixed.REPLY_ESCALATED, ticket=F.coalesce(ticket, F.lit("N/A")), name=who))
        .when(title.isNotNull(), F.concat(fill(fixed.REPLY_GREETING, name=who), body, F.lit(fixed.REPLY_SOURCE), title, F.lit("_")))
        .otherwise(fill(fixed.REPLY_UNKNOWN, name=who))
    )


def turn_topics(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, topic): distinct topics of a turn's hits; 'escalation' when there are none but it escalated.

    The topic of a hit is its category, else its title, else 'general'.  ``turns``: conv_id, turn, escalated, sources (array of
    category and title).
    """
    topics = F.array_distinct(F.transform("sources", lambda s: F.coalesce(s["category"], s["title"], F.lit("general"))))
    topics = F.when(F.size("sources") > 0, topics).when(F.col("escalated"), F.array(F.lit("escalation")))
    return turns.select("conv_id", "turn", F.explode(topics).alias("topic"))


def topic_counts(topics: DataFrame) -> DataFrame:
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))


def topic_edges(topics: DataFrame) -> DataFrame:
    return topics.select("conv_id", "topic").distinct()


def top_topics(counts: DataFrame, limit: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "topic").limit(limit)


def learning_queue(messages: DataFrame, hits: DataFrame, escalated: DataFrame) -> DataFrame:
    """Messages that found no source and were not escalated, as notes to review."""
    left = messages.join(hits.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti")
    left = left.join(escalated.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_anti")
    return left.select(
        "conv_id", "turn", F.lit("needs-review").alias("status"),
        F.concat(F.lit("Proposed knowledge: "), F.substring("message", 1, 70)).alias("title"), "message",
    )


def audit_rows(messages: DataFrame) -> DataFrame:
    """One redacted log row per handled message."""
    return messages.select(
        F.date_format(values.utc_moment(F.col("asked_at")), "yyyy-MM-dd").alias("day"),
        "conv_id", "turn", F.coalesce("customer_id", F.lit("unknown")).alias("customer_id"), "escalated",
        F.coalesce("ticket_id", F.lit("")).alias("ticket_id"),
        text.redact(F.col("message")).alias("message"), text.redact(F.col("response")).alias("response"),
        F.array_join("titles", " | ").alias("sources"),
    )


def extract_contacts(messages: DataFrame, column: str = "message") -> DataFrame:
    c = F.col(column)
    return messages.withColumn("name", contact.contact_name(c)).withColumn("email", contact.contact_email(c))
