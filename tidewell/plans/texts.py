"""Registered text queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text
from tidewell.operators import packing, sequences
from tidewell.plans import duck, views
from tidewell.plans.registry import documents, query, table


def _docs(spark, sf):
    return documents(spark, sf)


@query("extract_email", f"select doc_id, {duck.first_email('text')} as email from documents")
def extract_email(spark, sf):
    return _docs(spark, sf).select("doc_id", text.first_email(F.col("text")).alias("email"))


@query("redact_pii", f"select doc_id, md5({duck.redact('text')}) as redacted_md5, length({duck.redact('text')}) as n from documents")
def redact_pii(spark, sf):
    clean = text.redact(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.md5(clean).alias("redacted_md5"), F.length(clean).cast("bigint").alias("n"))


_ERROR = "'Error: ' || props || ' with bearer abc.' || cast(user_id as string) || ' and sk-' || event_type || '-1'"


@query("scrub_secrets", f"""
    select event_id, {duck.sub(f"substr({_ERROR}, 1, 120)", fixed.SECRET_TOKEN, chr(92) + '1***')} as message from events""")
def scrub_secrets(spark, sf):
    events = table(spark, sf, "events").selectExpr("event_id", f"{_ERROR} as error")
    return events.select("event_id", text.scrub_secrets(F.col("error")).alias("message"))


@query("find_credentials", f"select doc_id from documents where {duck.has('text', fixed.CREDENTIAL_ANY)}")
def find_credentials(spark, sf):
    return _docs(spark, sf).where(text.has_credential(F.col("text"))).select("doc_id")


@query("tokenize", f"""
    select doc_id, w as word from (select doc_id, unnest({duck.tokens('text')}) as w from documents)""")
def tokenize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(text.search_tokens(F.col("text"))).alias("word"))


_MARKUP = duck.trim(duck.collapse(duck.sub(duck.sub(duck.sub(
    duck.sub("text", r"\A---(?s:.*?)---\s*"),
    r"(?i)\[[^\]]*\]|\((?:laughs?|chuckles?|pauses?|sighs?|music|intro|outro)[^)]*\)", " "), r"[*_#`~>|]+"),
    r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]")))


def _split(c: str) -> str:
    return f"string_split(regexp_replace({c}, '([.!?]){fixed.WS}+', '\\1' || chr(1), 'g'), chr(1))"


@query("strip_markup", f"select doc_id, md5({_MARKUP}) as clean_md5 from documents")
def strip_markup(spark, sf):
    clean = text.strip_markup(text.strip_front_matter(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.md5(clean).alias("clean_md5"))


@query("sentences", f"""
    with s as (select doc_id, list_filter(list_transform({_split(_MARKUP)}, lambda x: {duck.trim('x')}),
                      lambda x: length(x) > 3) as parts from documents)
    select doc_id, unnest(parts) as sentence, cast(generate_subscripts(parts, 1) - 1 as integer) as pos from s""")
def sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


def _fold(parts: str, over: str) -> str:
    """Pack a list of sentences in SQL; ``over`` compares states a and b."""
    closed = "case when a.u <> '' then list_append(a.c, a.u) else a.c end"
    return (
        f"list_reduce(list_prepend({{'c': []::varchar[], 'u': ''}}, list_transform({parts}, lambda s: {{'c': []::varchar[], 'u': s}})), "
        f"lambda a, b: case when {over} then {{'c': {closed}, 'u': b.u}} else {{'c': a.c, 'u': {duck.trim(chr(97) + '.u || chr(32) || b.u')}}} end)"
    )


CHUNKS = f"""
    select doc_id, source, list_filter(case when f.u <> '' then list_append(f.c, {duck.trim('f.u')}) else f.c end,
           lambda p: length(p) > 30) as parts
    from (select doc_id, source, {_fold(_split(duck.trim('text')), 'length(a.u) + length(b.u) > 500')} as f from documents)"""


@query("chunk_documents", f"""
    select doc_id, cast(generate_subscripts(parts, 1) - 1 as integer) as pos, md5(unnest(parts)) as chunk_md5 from ({CHUNKS})""")
def chunk_documents(spark, sf):
    parts = _docs(spark, sf).select("doc_id", F.posexplode(packing.chunks(F.col("text"))).alias("pos", "chunk"))
    return parts.select("doc_id", "pos", F.md5("chunk").alias("chunk_md5"))


@query("split_long_lines", f"""
    with clean as (select doc_id, {_MARKUP} as t from documents),
         p as (select doc_id, t, {_fold(_split('t'), "a.u <> '' and length(a.u) + length(b.u) + 1 > 420")} as f from clean),
         q as (select doc_id, case when length(t) <= 420 then [t] else list_transform(
               case when f.u <> '' then list_append(f.c, f.u) else f.c end, lambda x: substr(x, 1, 420)) end as parts from p)
    select doc_id, cast(generate_subscripts(parts, 1) - 1 as integer) as pos, unnest(parts) as line from q""")
def split_long_lines(spark, sf):
    clean = text.strip_markup(text.strip_front_matter(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.posexplode(packing.spoken_lines(clean)).alias("pos", "line"))


@query("chunk_overlap")
def chunk_overlap(spark, sf):
    parts = packing.overlapping_chunks(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.posexplode(parts).alias("pos", "chunk"))


@query("sentences_abbrev")
def sentences_abbrev(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(packing.read_aloud(F.col("text"))).alias("pos", "sentence"))


_TAG = r"[^\p{L}\p{N}_\n]*(?i:host|guest)[^\p{L}\p{N}_\n]*:"
_TURN_TEXT = _MARKUP.replace("(text,", "(body,").replace(duck.sub("text", r"\A---(?s:.*?)---\s*"), "body")


@query("dialogue_turns", f"""
    with cut as (select doc_id, string_split(regexp_replace(chr(10) || script, '\\n({_TAG})', chr(1) || '\\1', 'g'), chr(1)) as parts from ({views.DIALOGUE})),
         tagged as (select doc_id, unnest(parts[2:]) as part, generate_subscripts(parts[2:], 1) as pos from cut),
         said as (select doc_id, pos, lower(regexp_extract(part, '(?i)(host|guest)', 1)) as speaker,
                         regexp_replace(part, '^{_TAG}\\s*', '') as body from tagged),
         clean as (select doc_id, pos, speaker, {_TURN_TEXT} as t from said),
         kept as (select *, cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as turn from clean where t <> ''),
         p as (select *, {_fold(_split('t'), "a.u <> '' and length(a.u) + length(b.u) + 1 > 420")} as f from kept),
         q as (select *, case when length(t) <= 420 then [t] else list_transform(
               case when f.u <> '' then list_append(f.c, f.u) else f.c end, lambda x: substr(x, 1, 420)) end as lines from p)
    select doc_id, turn, speaker, cast(generate_subscripts(lines, 1) - 1 as integer) as line, unnest(lines) as text from q""".replace("\\\\", "\\"))
def dialogue_turns(spark, sf):
    turns = packing.dialogue(F.col("script"), views.SPEAKERS)
    rows = views.dialogue(spark, sf).select("doc_id", F.posexplode(turns).alias("turn", "t"))
    lines = rows.select("doc_id", "turn", "t.speaker", F.posexplode(packing.spoken_lines(F.col("t.text"))).alias("line", "text"))
    return lines


@query("strip_think", f"""
    select doc_id, md5({duck.sub('answer', '(?s)<think>.*?(</think>|' + chr(92) + 'z)')}) as shown_md5 from ({views.THINKING})""")
def strip_think(spark, sf):
    return views.thinking(spark, sf).select("doc_id", F.md5(text.strip_reasoning(F.col("answer"))).alias("shown_md5"))


_SHOWN = f"""
    select doc_id, md5(coalesce({duck.sub('answer', '(?s)<think>.*?(</think>|' + chr(92) + 'z)')}, '')) as shown_md5 from ({views.THINKING})"""


def _cut(answers):
    """Answers in pieces of 5 to 64 characters."""
    size = F.lit(5) + F.col("doc_id") % 60
    # one walk over the text: a substring per piece would count its letters from the start each time
    found = F.regexp_extract_all("answer", F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    pieces = F.when(F.col("answer") == "", F.array(F.lit(""))).otherwise(found)
    return answers.select("doc_id", F.posexplode_outer(pieces).alias("n", "piece"))


@query("strip_think_pieces", _SHOWN)
def strip_think_pieces(spark, sf):
    """Answers that arrive in pieces, tags cut anywhere, give what whole answers give."""
    kept = sequences.sequential(_cut(views.thinking(spark, sf)), ["doc_id"], packing.think_rule("n", "piece"))
    return packing.joined(kept, ["doc_id"], "n").select("doc_id", F.md5("text").alias("shown_md5"))


@query("slugify", """
    with s as (select doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as s
               from documents)
    select doc_id, coalesce(nullif(s, ''), 'overview') as slug from s""")
def slugify(spark, sf):
    return _docs(spark, sf).select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("safe_filename", r"""
    select page_id, coalesce(nullif(substr(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^\p{L}\p{N}_.\-]', '_', 'g'), 1, 100), ''),
           'data.csv') as name from pages""")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("question_key", f"""
    select conv_id, turn, sha256(company_id || '::' || {duck.trim(duck.collapse('lower(message)'))}) as key from ({views.MESSAGES})""")
def question_key(spark, sf):
    return views.messages(spark, sf).select(
        "conv_id", "turn", text.question_key(F.col("company_id"), F.col("message")).alias("key"))


@query("prompt_key", """
    select conv_id, turn, sha256(cast(to_json({'content': text, 'role': role}) as varchar)) as key from conversations""")
def prompt_key(spark, sf):
    """Keys in fixed order, so equal prompts share one key."""
    body = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("key"))


@query("text_extract", f"""
    with t as (select doc_id, {duck.trim(duck.sub('text', '{n}{3,}'.replace('{n}', chr(92) + 'n'), chr(10) + chr(10)))} as body from documents)
    select doc_id, md5(substr(body, 1, 12000)) as body_md5, length(body) > 12000 as truncated from t where body <> ''""")
def text_extract(spark, sf):
    body = _docs(spark, sf).select("doc_id", text.extract_text(F.col("text")).alias("body")).where("body <> ''")
    return body.select("doc_id", F.md5(F.substring("body", 1, fixed.EXTRACT_SIZE)).alias("body_md5"),
                       (F.length("body") > fixed.EXTRACT_SIZE).alias("truncated"))
