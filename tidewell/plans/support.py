"""Registered retrieval and support queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text
from tidewell.operators import packing, search, sequences, skew, support
from tidewell.plans import duck, views
from tidewell.plans.registry import documents, query, table
from tidewell.plans.texts import CHUNKS
from tidewell.session import materialise, work_dir
from tidewell.sources import store
from tidewell.sources.keyed import KeyedTable

# --- retrieval ------------------------------------------------------------------


def _scored(queries: str, documents: str) -> str:
    """SQL twin of the keyword search: every query against every document."""
    return f"""
    q as (select query_id, {duck.tokens('message')} as qw from ({queries})),
    d as (select doc_id, title, {duck.tokens('title')} as tw, {duck.tokens('text')} as dw from ({documents})),
    s as (select query_id, doc_id, title, len(list_intersect(qw, tw)) * 3
                 + len(list_intersect(qw, dw))::double / greatest(len(dw), 1) * 10 as score from q, d where len(qw) > 0),
    hits as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from s)"""


_TOPICS = "select item_id as query_id, text as message from benchmark"
_QUERY_ID = "cast(conv_id as varchar) || ':' || cast(turn as varchar)"
_ASKED = f"select {_QUERY_ID} as query_id, * from ({views.MESSAGES})"


def _topics(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("message"))


def _asked(spark, sf):
    return views.messages(spark, sf).withColumn(
        "query_id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query("faq_search", f"""with {_scored(_TOPICS, views.KB)}
    select query_id, doc_id, rank, round(score, 6) as score from hits where rank <= 3 and score >= 1.5""")
def faq_search(spark, sf):
    hits = search.keyword_search(_topics(spark, sf), views.kb(spark, sf))
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_COSINE = "list_cosine_similarity(q.embedding::double[], c.embedding::double[])"


@query("vector_topk", f"""
    with s as (select q.vec_id as query_id, c.vec_id as doc_id, {_COSINE} as score
               from embeddings q join embeddings c on q.label = c.label),
         r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from s where score > 0.4)
    select query_id, doc_id, rank, round(score, 3) as score from r where rank <= 5""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("label").alias("tenant"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = e.select(F.col("label").alias("tenant"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    hits = search.vector_search(queries, corpus, k=5, least=0.4)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 3).alias("score"))


def _embed_sql(c: str) -> str:
    slots = (f"list_transform(regexp_extract_all(lower({c}), '[a-z]+'), "
             f"lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 64)")
    return slots


_VECTORS = f"list_transform(range(64), lambda i: len(list_filter(slots, lambda x: x = i))::double)"


@query("hash_embed", f"""
    with s as (select item_id, {_embed_sql('text')} as slots from benchmark),
         v as (select item_id, {_VECTORS} as counts from s),
         n as (select item_id, counts, sqrt(list_sum(list_transform(counts, lambda x: x * x))) as norm from v)
    select item_id, cast(generate_subscripts(counts, 1) - 1 as integer) as slot,
           round(coalesce(unnest(counts) / nullif(norm, 0), 0), 6) as weight from n""")
def hash_embed(spark, sf):
    v = table(spark, sf, "benchmark").select("item_id", search.hash_embedding(F.col("text")).alias("v"))
    return v.select("item_id", F.posexplode("v").alias("slot", "weight")).withColumn("weight", F.round("weight", 6))


def _chunks(spark, sf):
    """Chunk records of every document: id, company, position, text."""
    docs = documents(spark, sf)
    parts = docs.select("doc_id", F.col("source").alias("company_id"),
                        F.posexplode(packing.chunks(F.col("text"))).alias("pos", "chunk"))
    return parts.withColumn("id", F.concat_ws("_", "company_id", F.col("doc_id").cast("string"), F.col("pos").cast("string")))


_CHUNK_ROWS = f"""
    select doc_id, source as company_id, cast(generate_subscripts(parts, 1) - 1 as integer) as pos, unnest(parts) as chunk from ({CHUNKS})"""
_CHUNK_IDS = f"select *, company_id || '_' || doc_id || '_' || pos as id from ({_CHUNK_ROWS})"


@query("ingest_chunks", f"select id, company_id, doc_id, length(chunk) as n from ({_CHUNK_IDS})")
def ingest_chunks(spark, sf):
    return _chunks(spark, sf).select("id", "company_id", "doc_id", F.length("chunk").cast("bigint").alias("n"))


@query("upsert_chunks", f"""
    with v as (select id, 1 as version, chunk as body from ({_CHUNK_IDS})
               union all select id, 2, 'Revised: ' || chunk from ({_CHUNK_IDS}) where pos % 2 = 0)
    select id, max(version) as version, md5(arg_max(body, version)) as body_md5 from v group by 1""")
def upsert_chunks(spark, sf):
    """Every chunk is written once; every other one is written again later, and the later text wins."""
    first = _chunks(spark, sf).select("id", F.lit(1).alias("version"), F.col("chunk").alias("body"), "pos")
    again = first.where(F.col("pos") % 2 == 0).select("id", F.lit(2).alias("version"), F.concat(F.lit("Revised: "), "body").alias("body"), "pos")
    merged = search.latest(first.unionByName(again), "id", "version")
    return merged.select("id", "version", F.md5("body").alias("body_md5"))


@query("chunks_per_document", f"select company_id, doc_id, count(*) as chunks from ({_CHUNK_ROWS}) group by 1, 2")
def chunks_per_document(spark, sf):
    return _chunks(spark, sf).groupBy("company_id", "doc_id").agg(F.count(F.lit(1)).alias("chunks"))


_RAG = f"""
    {_scored(_ASKED, views.KB)},
    mv as (select query_id, company_id, {_VECTORS} as v from (select query_id, company_id, {_embed_sql('message')} as slots from ({_ASKED}))),
    cv as (select id, doc_id, company_id, {_VECTORS} as v from (select id, doc_id, company_id, {_embed_sql('chunk')} as slots from ({_CHUNK_IDS}))),
    sim as (select query_id, id, doc_id, list_cosine_similarity(mv.v, cv.v) as score from mv join cv using (company_id)),
    near as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from sim where score > {{least}}),
    rag as (select query_id, id as hit, doc_id, 'vector' as origin, rank, score from near where rank <= 5
            union all
            select query_id, cast(doc_id as varchar), doc_id, 'keyword', rank, score from hits
            where rank <= 3 and score >= 1.5 and query_id not in (select query_id from near))"""


def _chunk_vectors(spark, sf, *more):
    """Chunks with their vectors, written once, with ``more`` columns: the search and the texts of its hits read the same rows."""
    rows = _chunks(spark, sf).select(
        F.col("company_id").alias("tenant"), "id", *more, search.hash_embedding(F.col("chunk")).alias("vector"))
    return materialise(rows, "chunk-vectors")


def _rag_hits(spark, sf, least: float):
    asked = _asked(spark, sf)
    queries = asked.select(F.col("company_id").alias("tenant"), "query_id",
                           search.hash_embedding(F.col("message")).alias("vector"))
    corpus = _chunk_vectors(spark, sf).select("tenant", F.col("id").alias("doc_id"), "vector")
    # at most five rows per message, written once: they are a result and tell who still needs a keyword search
    near = materialise(search.vector_search(queries, corpus, k=5, least=least), "near")
    asked = asked.join(near.select("query_id").distinct(), "query_id", "left_anti")
    near = near.select("query_id", F.col("doc_id").alias("hit"), F.lit("vector").alias("origin"), "rank", "score")
    words = search.keyword_search(asked.select("query_id", "message"), views.kb(spark, sf))
    words = words.select("query_id", F.col("doc_id").cast("string").alias("hit"), F.lit("keyword").alias("origin"), "rank", "score")
    return near.unionByName(words)


@query("rag_or_faq", f"with {_RAG.replace('{least}', '0.9')} select query_id, hit, origin, rank, round(score, 3) as score from rag")
def rag_or_faq(spark, sf):
    return _rag_hits(spark, sf, 0.9).select("query_id", "hit", "origin", "rank", F.round("score", 3).alias("score"))


# The starter answers that come after the knowledge base; fixed values.
STARTERS = [
    ("Resetting your password", "Select Forgot password on the sign-in page. The reset link expires after 30 minutes."),
    ("Updating billing details", "Open Settings, then Billing, to update your payment method and download invoices."),
    ("Cancelling a subscription",
     "Subscriptions can be cancelled from Settings > Billing and remain active until the end of the current period."),
]


@query("kb_union", f"""
    select 0 as origin, doc_id, title, md5(text) as text_md5 from ({views.KB})
    union all select 1, pos, title, md5(text) from (values {', '.join(f"({i}::bigint, {duck.lit(t)}, {duck.lit(b)})" for i, (t, b) in enumerate(STARTERS))}) s(pos, title, text)""")
def kb_union(spark, sf):
    starters = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(STARTERS)], "doc_id bigint, title string, text string")
    both = views.kb(spark, sf).select(F.lit(0).alias("origin"), "doc_id", "title", "text").unionByName(
        starters.select(F.lit(1).alias("origin"), "doc_id", "title", "text"))
    return both.select("origin", "doc_id", "title", F.md5("text").alias("text_md5"))


# Topics belong to companies like the documents do; vector hits come between the notes and the keyword hits.
_VECTOR_HITS = 4
_TOPIC_COMPANY = "'src' || cast(item_id % 20 as varchar)"
_SOURCES = f"""
    {_scored(_TOPICS, views.KB)},
    tv as (select item_id as query_id, company_id, {_VECTORS} as v
           from (select item_id, {_TOPIC_COMPANY} as company_id, {_embed_sql('text')} as slots from benchmark)),
    cv as (select id, doc_id, company_id, chunk, {_VECTORS} as v from (select *, {_embed_sql('chunk')} as slots from ({_CHUNK_IDS}))),
    sim as (select query_id, id, doc_id, chunk, list_cosine_similarity(tv.v, cv.v) as score from tv join cv using (company_id)),
    near as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from sim where score > 0.4),
    src as (select b.item_id as topic_id, 0 as rank, 'Your notes' as title, substr({duck.trim('d.text')}, 1, 8000) as text
            from benchmark b join documents d on d.doc_id = b.item_id
            union all
            select query_id, n.rank, d.title, n.chunk from near n join ({views.KB}) d using (doc_id) where n.rank <= {_VECTOR_HITS}
            union all
            select query_id, cast(h.rank + {_VECTOR_HITS} as integer), d.title, d.text from hits h join ({views.KB}) d using (doc_id)
            where h.rank <= 3 and h.score >= 1.5),
    trimmed as (select topic_id, rank, coalesce(nullif({duck.trim('title')}, ''), 'Document') as title, {duck.trim('text')} as text from src),
    once as (select *, row_number() over (partition by topic_id, lower(title || substr(text, 1, 80)) order by rank) as nth
             from trimmed where text <> ''),
    cut as (select topic_id, rank, title, substr(text, 1, case when title = 'Your notes' then 8000 else 1800 end) as text
            from once where nth = 1),
    total as (select *, sum(length(text)) over (partition by topic_id order by rank) as running from cut)"""


def _sources(spark, sf):
    kb = views.kb(spark, sf)
    topics = _topics(spark, sf)
    notes = topics.join(kb, F.col("query_id") == F.col("doc_id")).select(
        F.col("query_id").alias("topic_id"), F.lit(0).alias("rank"), F.lit("Your notes").alias("title"),
        F.substring(text.trim_all(F.col("text")), 1, fixed.NOTES_SIZE).alias("text"))
    hits = materialise(search.keyword_search(topics, kb).select("query_id", "doc_id", "rank"), "hits")
    found = hits.join(kb, "doc_id").select(
        F.col("query_id").alias("topic_id"), (F.col("rank") + _VECTOR_HITS).alias("rank"), "title", "text")
    chunks = _chunk_vectors(spark, sf, "doc_id", "chunk")
    asked = table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("tenant"), F.col("item_id").alias("query_id"),
        search.hash_embedding(F.col("text")).alias("vector"))
    corpus = chunks.select("tenant", F.col("id").alias("doc_id"), "vector")
    near = materialise(search.vector_search(asked, corpus, k=_VECTOR_HITS, least=0.4), "near")
    near = near.select("query_id", F.col("doc_id").alias("id"), "rank").join(chunks.select("id", "doc_id", "chunk"), "id")
    near = near.join(kb.select("doc_id", "title"), "doc_id").select(
        F.col("query_id").alias("topic_id"), "rank", "title", F.col("chunk").alias("text"))
    return notes.unionByName(near).unionByName(found)


@query("gather_sources", f"""with {_SOURCES}
    select topic_id, rank, title, md5(text) as text_md5, cast(running as bigint) as running from total where running <= 14000""")
def gather_sources(spark, sf):
    kept = search.gather_sources(_sources(spark, sf), fixed.SOURCE_SIZE, fixed.NOTES_SIZE, fixed.CONTEXT_SIZE)
    return kept.select("topic_id", "rank", "title", F.md5("text").alias("text_md5"), "running")


@query("context_budget", """
    with t as (select source as topic_id, doc_id as rank, sum(length(text)) over (partition by source order by doc_id) as running from documents)
    select topic_id, rank, cast(running as bigint) as running from t where running <= 14000""")
def context_budget(spark, sf):
    docs = documents(spark, sf).select(F.col("source").alias("topic_id"), F.col("doc_id").alias("rank"), "text")
    return search.context_budget(docs.where("text <> ''"), fixed.CONTEXT_SIZE).select("topic_id", "rank", "running")


@query("topic_digest", f"""
    with {_SOURCES},
    kept as (select topic_id, rank, title, text from total where running <= 14000),
    parts as (select topic_id, rank, title, list_filter(list_transform(
                  string_split(regexp_replace({duck.trim(duck.collapse(duck.sub(duck.sub(duck.sub(duck.sub('text', chr(92) + 'A---(?s:.*?)---' + chr(92) + 's*'), '(?i)' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']|' + chr(92) + '((?:laughs?|chuckles?|pauses?|sighs?|music|intro|outro)[^)]*' + chr(92) + ')', ' '), '[*_#`~>|]+'), '[' + chr(92) + 'x{1F000}-' + chr(92) + 'x{1FAFF}' + chr(92) + 'x{2600}-' + chr(92) + 'x{27BF}]')))},
                  '([.!?])' || '{fixed.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {duck.trim('x')}), lambda x: length(x) > 3) as s from kept),
    first3 as (select *, row_number() over (partition by topic_id order by rank) as place from parts where len(s) > 0)
    select topic_id, cast(place as integer) as place, 'This comes from ' || title || '. ' || array_to_string(s[1:2], ' ') as opening,
           array_to_string(s[3:4], ' ') as more from first3 where place <= 3
    union all
    select item_id, 0, 'nothing found', '' from benchmark where item_id not in (select topic_id from first3)""")
def topic_digest(spark, sf):
    """Title and first two sentences of up to three sources per topic, then the next two; an honest line when none."""
    kept = search.gather_sources(_sources(spark, sf), fixed.SOURCE_SIZE, fixed.NOTES_SIZE, fixed.CONTEXT_SIZE)
    said = kept.withColumn("s", text.sentences(F.col("text"))).where(F.size("s") > 0)
    order = Window.partitionBy("topic_id").orderBy("rank")
    top = said.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3)
    told = top.select(
        "topic_id", "place",
        F.concat(F.lit("This comes from "), "title", F.lit(". "), F.array_join(F.slice("s", 1, 2), " ")).alias("opening"),
        F.array_join(F.slice("s", 3, 2), " ").alias("more"))
    silent = _topics(spark, sf).select(F.col("query_id").alias("topic_id")).join(told, "topic_id", "left_anti")
    return told.unionByName(silent.select(
        "topic_id", F.lit(0).alias("place"), F.lit("nothing found").alias("opening"), F.lit("").alias("more")))


# --- customers, escalation, tickets ---------------------------------------------


@query("lookup_by_id", """
    select o_orderkey, c_name as name, c_mktsegment as plan from orders
    left join customer on cast(c_custkey as varchar) = case when o_orderkey % 10 = 9 then 'nobody' else cast(o_custkey as varchar) end""")
def lookup_by_id(spark, sf):
    asked = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 10 = 9 then 'nobody' else cast(o_custkey as string) end as customer_id",
        "'' as message")
    found = support.lookup_customer(asked, views.clients(spark, sf))
    return found.select("o_orderkey", F.col("found_name").alias("name"), F.col("found_plan").alias("plan"))


_FOUND = f"""
    m as (select * from ({_ASKED})), c as (select * from ({views.CLIENTS})),
    found as (select m.*, c.name, c.email, c.plan, c.billing_current, c.customer_id as found_id from m left join c
              on case when m.customer_id is not null then c.customer_id = m.customer_id else c.email = {duck.first_email('m.message')} end)"""


def _found(spark, sf):
    return support.account_status(support.lookup_customer(_asked(spark, sf), views.clients(spark, sf)))


@query("lookup_by_email", f"with {_FOUND} select conv_id, turn, name, email from found where customer_id is null")
def lookup_by_email(spark, sf):
    mine = _asked(spark, sf).where(F.col("customer_id").isNull())
    found = support.lookup_customer(mine, views.clients(spark, sf))
    return found.select("conv_id", "turn", F.col("found_name").alias("name"), F.col("found_email").alias("email"))


@query("account_status", f"""with {_FOUND}
    select conv_id, turn, case when found_id is not null then 'active' end as status, plan, billing_current from found""")
def account_status(spark, sf):
    return _found(spark, sf).select("conv_id", "turn", "status", "plan", "billing_current")


def _reason_sql(billing: str = "true") -> str:
    terms = " ".join(f"when contains(lower(message), {duck.lit(t)}) then {duck.lit(f'Escalation phrase detected: {chr(39)}{t}{chr(39)}')}"
                     for t in fixed.URGENT_TERMS)
    angry = " or ".join(f"contains(lower(message), {duck.lit(w)})" for w in fixed.ANGRY_WORDS)
    return (f"case {terms} when length(message) - length(replace(message, '!', '')) >= 3 or {angry} then {duck.lit(fixed.R_TONE)} "
            f"when not coalesce({billing}, true) then {duck.lit(fixed.R_BILLING)} end")


@query("escalation_flag", f"with {_FOUND} select conv_id, turn, {_reason_sql('billing_current')} as reason from found")
def escalation_flag(spark, sf):
    reason = support.escalation_reason(F.col("message"), F.col("billing_current"))
    return _found(spark, sf).select("conv_id", "turn", reason.alias("reason"))


@query("extract_contact")
def extract_contact(spark, sf):
    return support.extract_contacts(views.messages(spark, sf)).select("conv_id", "turn", "name", "email")


# A pending request is seen while it lies within the last 12 history entries: the five turns after it.
_FLOW = f"""
    {_FOUND},
    base as materialized (select conv_id, turn, {_reason_sql('billing_current')} as reason, {duck.first_email('message')} as mail,
             row_number() over (partition by conv_id order by turn) as rn from found),
    flow as (select conv_id, cast(0 as bigint) as rn, cast(null as bigint) as turn, cast(null as varchar) as pending, 0 as age,
                    '' as action, cast(null as varchar) as ticket_reason from (select distinct conv_id from base)
             union all
             select b.conv_id, b.rn, b.turn,
                    case when f.pending is not null and f.age < 6 then case when b.mail is null then f.pending end
                         when b.reason is not null and b.mail is null then b.reason end,
                    case when f.pending is not null and f.age < 6 then f.age + 1 else 1 end,
                    case when f.pending is not null and f.age < 6 then case when b.mail is null then 'retry' else 'ticket' end
                         when b.reason is null then 'none' when b.mail is null then 'ask' else 'ticket' end,
                    case when f.pending is not null and f.age < 6 then case when b.mail is not null then f.pending end
                         else b.reason end
             from flow f join base b on b.conv_id = f.conv_id and b.rn = f.rn + 1)"""


def _flow(spark, sf, part_rows=skew.PART_ROWS):
    rows = _found(spark, sf).select(
        "conv_id", "turn", support.escalation_reason(F.col("message"), F.col("billing_current")).alias("reason"),
        text.first_email(F.col("message")).alias("mail"))
    return materialise(sequences.escalation_flow(rows, ["conv_id"], "turn", "reason", "mail", part_rows), "flow")


@query("escalation_flow", f"with recursive {_FLOW} select conv_id, turn, action, ticket_reason from flow where rn > 0")
def escalation_flow(spark, sf):
    return _flow(spark, sf).select("conv_id", "turn", "action", "ticket_reason")


def _tickets(spark, sf, flow=None):
    opened = (flow or _flow(spark, sf)).where("action = 'ticket'").select("conv_id", "turn", F.col("ticket_reason").alias("reason"))
    asked = _found(spark, sf).join(opened, ["conv_id", "turn"])
    named = support.extract_contacts(asked)
    known = F.col("found_customer_id").isNotNull()
    return support.tickets(named.select(
        "company_id", "conv_id", "turn", "message", "asked_at", "reason",
        F.when(known, F.col("found_name")).otherwise(F.col("name")).alias("customer_name"),
        F.when(known, F.col("found_email")).otherwise(F.col("email")).alias("customer_email")))


_TICKETS = f"""
    {_FLOW},
    tickets as (select found.company_id, 'TICKET-' || upper(substr(sha256(found.conv_id || ':' || found.turn), 1, 8)) as ticket_id,
                       found.conv_id, found.turn, 'open' as status, ticket_reason as reason, asked_at,
                       strftime(make_timestamp(asked_at * 1000000), '%Y-%m-%dT%H:%M:%S') as created_at,
                       coalesce(email, {duck.first_email('message')}, '') as customer_email, substr({duck.trim('message')}, 1, 200) as issue
                from found join flow on flow.conv_id = found.conv_id and flow.turn = found.turn where action = 'ticket')"""


@query("tickets", f"with recursive {_TICKETS} select company_id, ticket_id, status, reason, created_at, customer_email, issue from tickets")
def tickets(spark, sf):
    return _tickets(spark, sf).select(
        "company_id", "ticket_id", "status", "reason", "created_at", "customer_email", "issue")


@query("ticket_contacts")
def ticket_contacts(spark, sf):
    return _tickets(spark, sf).select("ticket_id", "customer_name", "customer_email")


@query("tickets_recent", f"""with recursive {_TICKETS}
    select company_id, ticket_id, created_at from tickets order by company_id, asked_at desc, ticket_id""")
def tickets_recent(spark, sf):
    """Newest first per tenant: a range-partitioned sort, so a large tenant is spread over tasks."""
    listed = _tickets(spark, sf).orderBy("company_id", F.desc("asked_at"), "ticket_id")
    return listed.select("company_id", "ticket_id", "created_at")


# --- topics, queue, log ----------------------------------------------------------

_HITS = _scored(_ASKED, views.KB)
_TOPIC_ROWS = f"""
    {_TICKETS}, {_HITS},
    kept as (select * from hits where rank <= 3 and score >= 1.5),
    topics as (select distinct m.conv_id, m.turn, coalesce(b.category, k.title) as topic from m join kept k using (query_id)
               join ({views.KB}) b using (doc_id)
               union all
               select conv_id, turn, 'escalation' from flow where action = 'ticket'
               and {_QUERY_ID} not in (select query_id from kept))"""


def _hits(spark, sf):
    found = search.keyword_search(_asked(spark, sf).select("query_id", "message"), views.kb(spark, sf))
    found = materialise(found, "hits")  # at most three rows per message, read by several steps
    part = F.split("query_id", ":")
    return found.withColumn("conv_id", part[0].cast("bigint")).withColumn("turn", part[1].cast("bigint"))


def _turn_topics(spark, sf, flow=None, hits=None):
    # at most three hits per turn, so the lists are short
    found = (hits or _hits(spark, sf)).join(views.kb(spark, sf).select("doc_id", "category"), "doc_id")
    order = F.sort_array(F.collect_list(F.struct("rank", "title", "category")))
    titles = found.groupBy("conv_id", "turn").agg(
        F.transform(order, lambda x: x["title"]).alias("titles"),
        F.transform(order, lambda x: F.struct(x["category"].alias("category"), x["title"].alias("title"))).alias("sources"))
    turns = (flow or _flow(spark, sf)).select("conv_id", "turn", (F.col("action") == "ticket").alias("escalated"))
    turns = turns.join(titles, ["conv_id", "turn"], "left")
    return turns.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>"))).withColumn(
        "sources", F.coalesce("sources", F.array().cast("array<struct<category:string,title:string>>")))


@query("turn_topics", f"with recursive {_TOPIC_ROWS} select conv_id, turn, topic from topics")
def turn_topics(spark, sf):
    return support.turn_topics(_turn_topics(spark, sf))


@query("topic_counts", f"with recursive {_TOPIC_ROWS} select topic, count(*) as count from topics group by 1")
def topic_counts(spark, sf):
    return support.topic_counts(support.turn_topics(_turn_topics(spark, sf)))


@query("topic_edges", f"""with recursive {_TOPIC_ROWS}
    select distinct conv_id, 'ASKED_ABOUT' as edge, topic as target from topics
    union all select conv_id, 'CREATED_TICKET', ticket_id from tickets""")
def topic_edges(spark, sf):
    flow = _flow(spark, sf)
    asked = support.topic_edges(support.turn_topics(_turn_topics(spark, sf, flow)))
    made = _tickets(spark, sf, flow).select("conv_id", F.lit("CREATED_TICKET").alias("edge"), F.col("ticket_id").alias("target"))
    return asked.select("conv_id", F.lit("ASKED_ABOUT").alias("edge"), F.col("topic").alias("target")).unionByName(made.distinct())


@query("topic_edges_merged", f"""with recursive {_TOPIC_ROWS} select distinct conv_id, topic from topics""")
def topic_edges_merged(spark, sf):
    """Edges kept up to date by batches of conversations: what a rebuild gives, in a table that is only ever merged into."""
    edges = materialise(support.topic_edges(support.turn_topics(_turn_topics(spark, sf))).withColumn("seen", F.lit(1)), "edges")
    kept = KeyedTable(spark, work_dir(spark, "topic-edges"), ["conv_id", "topic"], most=3)
    for number in range(5):
        kept.merge(edges.where(F.pmod(F.col("conv_id"), F.lit(5)) <= number), number)  # later batches bring old edges again
    return kept.read().select("conv_id", "topic")


@query("vector_topk_approx", """
    select 'recall' as measure, true as reached union all select 'scores', true union all select 'share', true""")
def vector_topk_approx(spark, sf):
    """The approximate search beside the exact one: recall of at least 0.9, equal scores, and few pairs looked at."""
    e = table(spark, sf, "embeddings")
    queries = e.select(F.col("label").alias("tenant"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    corpus = e.select(F.col("label").alias("tenant"), F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    exact = search.vector_search(queries, corpus, k=5, least=0.4).select("query_id", "doc_id", F.col("score").alias("exact"))
    near = search.vector_search_approx(queries, corpus, k=5, least=0.4).select("query_id", "doc_id", "score")
    both = exact.join(near, ["query_id", "doc_id"], "left")
    told = both.agg(
        (F.coalesce(F.avg(F.col("score").isNotNull().cast("int")), F.lit(1.0)) >= 0.9).alias("recall"),
        F.coalesce(F.max(F.abs(F.col("score") - F.col("exact"))) < 1e-9, F.lit(True)).alias("scores"), F.lit(search.PROBES <= 0.125).alias("share"))
    return told.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, told.columns)), F.array(*map(F.col, told.columns)))).alias("measure", "reached"))


@query("tenant_chunks", f"""
    select company_id, count(*) as chunks, sum(length(chunk))::bigint as characters from ({_CHUNK_ROWS})
    where company_id in (select distinct source from documents where doc_id % 97 = 5) group by 1""")
def tenant_chunks(spark, sf):
    """Chunks in a store by tenant; only the folders of the tenants asked for are read."""
    path = work_dir(spark, "tenants")
    store.write_tenants(_chunks(spark, sf).select("id", "company_id", "chunk"), path, "company_id")
    asked = table(spark, sf, "documents").where("doc_id % 97 = 5").select(F.col("source").alias("company_id"))
    found = store.read_tenants(spark, path, asked, "company_id")
    return found.groupBy("company_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("characters"))


@query("top_topics", f"with recursive {_TOPIC_ROWS} select topic, count(*) as count from topics group by 1 order by 2 desc, 1 limit 10")
def top_topics(spark, sf):
    return support.top_topics(support.topic_counts(support.turn_topics(_turn_topics(spark, sf))), 10)


@query("tenant_stats", f"""with recursive {_TOPIC_ROWS},
    docs as (select company_id, count(distinct doc_id) as docs_indexed from ({_CHUNK_ROWS}) group by 1),
    tk as (select company_id, count(*) as n from tickets group by 1),
    tc as (select m.company_id, topic, count(*) as n from topics join m using (conv_id, turn) group by 1, 2),
    tt as (select company_id, topic from (select *, row_number() over (partition by company_id order by n desc, topic) as r from tc) where r = 1)
    select company_id, coalesce(tk.n, 0) as total_tickets, docs_indexed, coalesce(topic, 'None yet') as top_topic
    from docs left join tk using (company_id) left join tt using (company_id)""")
def tenant_stats(spark, sf):
    docs = _chunks(spark, sf).select("company_id", "doc_id").distinct().groupBy("company_id").agg(
        F.count(F.lit(1)).alias("docs_indexed"))
    flow = _flow(spark, sf)
    made = _tickets(spark, sf, flow).groupBy("company_id").agg(F.count(F.lit(1)).alias("total_tickets"))
    topics = support.turn_topics(_turn_topics(spark, sf, flow)).join(
        views.messages(spark, sf).select("conv_id", "turn", "company_id"), ["conv_id", "turn"])
    counts = topics.groupBy("company_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("company_id").agg(F.min_by("topic", F.struct(-F.col("n"), "topic")).alias("top_topic"))
    return docs.join(made, "company_id", "left").join(top, "company_id", "left").select(
        "company_id", F.coalesce("total_tickets", F.lit(0)).alias("total_tickets"), "docs_indexed",
        F.coalesce("top_topic", F.lit("None yet")).alias("top_topic"))


@query("learning_queue", f"""with recursive {_TOPIC_ROWS}
    select conv_id, turn, 'needs-review' as status, 'Proposed knowledge: ' || substr(message, 1, 70) as title, message from m
    where query_id not in (select query_id from kept)
      and query_id not in (select {_QUERY_ID} from flow where action = 'ticket')""")
def learning_queue(spark, sf):
    escalated = _flow(spark, sf).where("action = 'ticket'")
    return support.learning_queue(views.messages(spark, sf), _hits(spark, sf), escalated)


def _handled(spark, sf, flow=None, hits=None):
    """Every user turn with its outcome, reply and source titles."""
    found = _found(spark, sf)
    flow = (flow or _flow(spark, sf)).select("conv_id", "turn", "action")
    best = (hits or _hits(spark, sf)).where("rank = 1").select("conv_id", "turn", "title", "doc_id")
    kb = skew.only_wanted(views.kb(spark, sf).select("doc_id", F.col("text").alias("body")), best, "doc_id")
    best = skew.spread_join(best, kb, "doc_id").drop("doc_id")
    rows = found.join(flow, ["conv_id", "turn"]).join(best, ["conv_id", "turn"], "left")
    escalated = F.col("action") == "ticket"
    ticket = F.when(escalated, support.ticket_id("TICKET", F.col("conv_id"), F.col("turn")))
    reply = (
        F.when(F.col("action") == "ask", fixed.REPLY_ASK).when(F.col("action") == "retry", fixed.REPLY_RETRY)
        .otherwise(support.draft_reply(F.col("found_name"), escalated, ticket, F.col("title"), F.col("body"))))
    return rows.select("*", escalated.alias("escalated"), ticket.alias("ticket_id"), reply.alias("response"))


_HANDLED = f"""
    {_TOPIC_ROWS},
    best as (select query_id, k.title, d.text as body from kept k join documents d using (doc_id) where rank = 1),
    handled as (select found.*, flow.action, best.title, best.body, flow.action = 'ticket' as escalated,
        case when flow.action = 'ticket' then 'TICKET-' || upper(substr(sha256(found.conv_id || ':' || found.turn), 1, 8)) end as tid
        from found join flow on flow.conv_id = found.conv_id and flow.turn = found.turn left join best using (query_id)),
    replied as (select *, case when action = 'ask' then {duck.lit(fixed.REPLY_ASK)} when action = 'retry' then {duck.lit(fixed.REPLY_RETRY)}
        when escalated then 'Hi ' || coalesce(name, 'there') || ', I completely understand — this needs immediate attention. I''ve opened ticket **'
             || tid || '** and flagged it as urgent. A member of our team will reach out to you shortly.'
        when title is not null then 'Hi ' || coalesce(name, 'there') || ', ' || body || chr(10) || chr(10) || '_Source: ' || title || '_'
        else 'Hi ' || coalesce(name, 'there') || ', thanks for getting in touch! I wasn''t able to find an exact match for that in our '
             || 'knowledge base, but I''ve logged your message and our team will follow up with you soon.' end as response from handled)"""


@query("draft_replies", f"with recursive {_HANDLED} select conv_id, turn, action, response from replied")
def draft_replies(spark, sf):
    return _handled(spark, sf).select("conv_id", "turn", "action", "response")


@query("audit_log", f"""with recursive {_HANDLED}
    select strftime(make_timestamp(asked_at * 1000000), '%Y-%m-%d') as day, conv_id, turn, coalesce(customer_id, 'unknown') as customer_id,
           escalated, coalesce(tid, '') as ticket_id, {duck.redact('message')} as message, {duck.redact('response')} as response,
           coalesce((select string_agg(k.title, ' | ' order by k.rank) from kept k where k.query_id = replied.query_id), '') as sources
    from replied""")
def audit_log(spark, sf):
    flow, hits = _flow(spark, sf), _hits(spark, sf)
    titles = _turn_topics(spark, sf, flow, hits).select("conv_id", "turn", "titles")
    return support.audit_rows(_handled(spark, sf, flow, hits).join(titles, ["conv_id", "turn"]))


# --- history ----------------------------------------------------------------------


@query("history_window", """
    with h as (select conv_id, turn, role, count(*) over w as entries,
               string_agg(role || ': ' || text, chr(10)) over w as seen from conversations
               window w as (partition by conv_id order by turn rows between 12 preceding and 1 preceding))
    select conv_id, turn, entries, md5(coalesce(seen, '')) as seen_md5 from h where role = 'user'""")
def history_window(spark, sf):
    rows = skew.with_lookback(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", 12)
    frame = Window.partitionBy("conv_id", "_part").orderBy("turn").rowsBetween(-12, -1)
    line = F.concat("role", F.lit(": "), "text")
    seen = rows.withColumn("entries", F.count(F.lit(1)).over(frame)).withColumn("seen", F.collect_list(line).over(frame))
    return seen.where("role = 'user' and not _extra").select(
        "conv_id", "turn", "entries", F.md5(F.array_join("seen", "\n")).alias("seen_md5"))


@query("pending_escalation", f"""
    with marked as (select c.conv_id, c.turn, c.role, r.reason from conversations c left join
                    (select conv_id, turn, {_reason_sql()} as reason from ({views.MESSAGES})) r using (conv_id, turn))
    select conv_id, turn, last_value(reason ignore nulls) over (partition by conv_id order by turn
           rows between 12 preceding and 1 preceding) as pending from marked""")
def pending_escalation(spark, sf):
    marks = views.messages(spark, sf).select(
        "conv_id", "turn", support.escalation_reason(F.col("message")).alias("reason"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role").join(marks, ["conv_id", "turn"], "left")
    rows = skew.with_lookback(rows, ["conv_id"], "turn", "role", 12)
    frame = Window.partitionBy("conv_id", "_part").orderBy("turn").rowsBetween(-12, -1)
    seen = rows.withColumn("pending", F.last("reason", ignorenulls=True).over(frame))
    return seen.where(~F.col("_extra")).select("conv_id", "turn", "pending")


# --- tenants ------------------------------------------------------------------------

_KEYS = "select sha256(n_name) as api_key, lower(n_name) as company_id, n_name as company from nation"
_CALLS = ("select o_orderkey, case when o_orderkey % 10 = 9 then 'wrong' when o_orderkey % 10 = 8 then null "
          "else sha256('NATION_' || (o_custkey % 25)) end as api_key from orders")


@query("tenant_keys", f"""
    select o_orderkey, company_id, case when c.api_key is null then 'missing key' when company_id is null then 'invalid key' end as rejected
    from ({_CALLS}) c left join ({_KEYS}) k on k.api_key = c.api_key""")
def tenant_keys(spark, sf):
    """Registry lookup: a missing or unknown key is rejected."""
    registry = table(spark, sf, "nation").select(
        F.sha2("n_name", 256).alias("api_key"), F.lower("n_name").alias("company_id"))
    key = (F.when(F.col("o_orderkey") % 10 == 9, "wrong").when(F.col("o_orderkey") % 10 == 8, None)
           .otherwise(F.sha2(F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")), 256)))
    calls = table(spark, sf, "orders").select("o_orderkey", key.alias("api_key"))
    found = calls.join(registry, "api_key", "left")  # one row per tenant: Spark broadcasts it by its file size
    why = F.when(F.col("api_key").isNull(), "missing key").when(F.col("company_id").isNull(), "invalid key")
    return found.select("o_orderkey", "company_id", why.alias("rejected"))


@query("validate_requests", f"""
    select conv_id, turn, case when length(message) > 5000 then 'message too long' when {duck.trim('message')} = '' then 'message empty'
        when customer_id is not null and not regexp_full_match(customer_id, '[0-9]+') then 'bad customer id' end as rejected from ({views.MESSAGES})""")
def validate_requests(spark, sf):
    why = (F.when(F.length("message") > 5000, "message too long").when(text.trim_all(F.col("message")) == "", "message empty")
           .when(F.col("customer_id").isNotNull() & ~F.col("customer_id").rlike("^[0-9]+$"), "bad customer id"))
    return views.messages(spark, sf).select("conv_id", "turn", why.alias("rejected"))
