"""Registered cleaning and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text, values
from tidewell.operators import cleaning
from tidewell.plans import duck, views
from tidewell.plans.registry import query, table

TEXT_COLUMNS = [c for c in views._DIRTY if c != "row_id"]
KINDS = {
    "id": "id", "full_name": "short_text", "email": "email", "phone": "phone", "signup_date": "date",
    "monthly_spend": "number", "age": "number", "gender": "gender", "province": "province", "segment": "short_text",
}
DISPLAY = dict(KINDS, full_name="text", monthly_spend="decimal", age="integer", gender="category",
               province="category", segment="category")


def _dirty(spark, sf):
    return views.dirty_customer(spark, sf)


def _one(name: str, column: str, sql_out: str, plan_out, alias: str):
    """A query that applies one column expression to the dirty customers."""
    sql = f"select row_id, {sql_out} as {alias} from (select row_id, {column} as v from ({views.DIRTY_CUSTOMER}))"

    @query(name, sql)
    def run(spark, sf):
        return _dirty(spark, sf).select("row_id", plan_out(F.col(column)).alias(alias))


_one("null_tokens", "gender", duck.null_tokens("v"), text.null_tokens, "value")
_one("ws_collapse", "full_name", duck.collapse("v"), text.collapse_spaces, "value")
_one("formula_guard", "phone", duck.formula("v"), text.guard_formula, "value")
_one("parse_numbers", "monthly_spend", f"cast({duck.digits('v')} as double)", values.parse_number, "value")
_one("parse_dates", "signup_date", f"strftime({duck.date('v')}, '%Y-%m-%d')",
     lambda c: F.date_format(values.parse_date(c, True), "yyyy-MM-dd"), "value")
_one("clean_email", "email", duck.email("v"), values.clean_email, "value")
_one("clean_phone", "phone", duck.phone("v"), values.clean_phone, "value")
_one("alias_gender", "gender", duck.gender("v"), values.gender_alias, "value")
_one("alias_region", "province", duck.province(duck.collapse("v")),
     lambda c: values.province_alias(text.collapse_spaces(c)), "value")


@query("smart_title", f"""
    select row_id, {duck.title('v')} as title
    from (select row_id, trim(full_name) || ' van der o''brien-' || lower(segment) as v from ({views.DIRTY_CUSTOMER}))""")
def smart_title(spark, sf):
    name = F.concat(F.trim("full_name"), F.lit(" van der o'brien-"), F.lower("segment"))
    return _dirty(spark, sf).select("row_id", text.smart_title(name).alias("title"))


@query("clean_number", f"""
    with v as (select row_id, {duck.null_tokens('monthly_spend')} as spend, {duck.null_tokens('age')} as age
               from ({views.DIRTY_CUSTOMER})),
         n as (select row_id, cast({duck.digits('spend')} as double) as spend, cast({duck.digits('age')} as double) as age from v)
    select row_id, round(case when spend >= 0 then spend end, 2) as monthly_spend,
           cast(case when age between 1 and 120 then age end as bigint) as age from n""")
def clean_number(spark, sf):
    frame = _dirty(spark, sf).select(F.col("row_id").alias(cleaning.ROW), "monthly_spend", "age")
    return cleaning.clean(frame).rows.withColumnRenamed(cleaning.ROW, "row_id")


@query("clean_date", f"""
    select row_id, strftime({duck.date('v')}, '%Y-%m-%d') as signup_date
    from (select row_id, {duck.null_tokens('signup_date')} as v from ({views.DIRTY_CUSTOMER}))""")
def clean_date(spark, sf):
    frame = _dirty(spark, sf).select(F.col("row_id").alias(cleaning.ROW), "signup_date")
    return cleaning.clean(frame).rows.withColumnRenamed(cleaning.ROW, "row_id")


_DAY = f"cast(regexp_extract(v, {duck.lit(fixed.DMY)}, 1) as integer)"
_MONTH = f"cast(regexp_extract(v, {duck.lit(fixed.DMY)}, 2) as integer)"


@query("date_order", f"""
    with v as (select signup_date as v from ({views.DIRTY_CUSTOMER}) where {duck.has('signup_date', fixed.DMY)}),
         e as (select count(*) filter ({_DAY} > 12) as d,
                      count(*) filter ({_DAY} <= 12 and {_MONTH} > 12) as m,
                      count(*) filter ({_DAY} <= 12 and {_MONTH} <= 12 and {_DAY} <> {_MONTH}) as a from v)
    select m <= d as day_first, d as day_votes, m as month_votes, a as either_votes from e""")
def date_order(spark, sf):
    vote = values.date_order(F.col("signup_date"))
    day, month = F.count_if(vote == "day"), F.count_if(vote == "month")
    return _dirty(spark, sf).agg(
        (month <= day).alias("day_first"), day.alias("day_votes"), month.alias("month_votes"),
        F.count_if(vote == "either").alias("either_votes"))


@query("canonical_case", f"""
    with s as (select row_id, {duck.collapse(duck.null_tokens('segment'))} as v from ({views.DIRTY_CUSTOMER})),
         g as (select lower(v) as fold, v, count(*) as n from s where v is not null group by 1, 2),
         b as (select fold, v as best, row_number() over (partition by fold order by {duck.mono('v')}, n desc, v desc) as r
               from g)
    select row_id, best as segment from s left join b on lower(v) = fold and r = 1""")
def canonical_case(spark, sf):
    frame = _dirty(spark, sf).select(F.col("row_id").alias(cleaning.ROW), "segment")
    return cleaning.clean(frame).rows.withColumnRenamed(cleaning.ROW, "row_id")


@query("drop_empty_columns", f"""
    select row_id, {duck.null_tokens('full_name')} as full_name from ({views.DIRTY_CUSTOMER})""")
def drop_empty_columns(spark, sf):
    frame = _dirty(spark, sf).select(
        F.col("row_id").alias(cleaning.ROW), "full_name", F.lit("N/A").alias("nickname"), F.lit(" ").alias("fax"))
    found = cleaning.profile(frame)
    return frame.select(F.col(cleaning.ROW).alias("row_id"),
                        *[text.null_tokens(F.col(c.name)).alias(c.name) for c in found.kept])


@query("drop_empty_rows", f"""
    with v as (select row_id, {duck.null_tokens('full_name')} as full_name, {duck.null_tokens('email')} as email
               from ({views.DIRTY_CUSTOMER}))
    select * from v where full_name is not null or email is not null""")
def drop_empty_rows(spark, sf):
    cells = _dirty(spark, sf).select("row_id", *[text.null_tokens(F.col(c)).alias(c) for c in ("full_name", "email")])
    return cells.na.drop(how="all", subset=["full_name", "email"])


# The same clean in SQL: one CTE per stage, with the kinds written out.
def _sql_stages(source: str) -> str:
    strip = ", ".join(f"{c} as raw_{c}, {duck.null_tokens(c)} as {c}" for c in TEXT_COLUMNS)
    stage = []
    for c, kind in KINDS.items():
        one = duck.collapse(c)
        stage.append({
            "id": f"{c} as out_{c}",
            "email": f"{duck.email(c)} as out_{c}",
            "phone": f"{duck.phone(c)} as out_{c}",
            "date": f"strftime({duck.date(c)}, '%Y-%m-%d') as out_{c}",
            "number": f"{duck.digits(c)} as dig_{c}, {duck.plain(c)} as plain_{c}",
            "gender": f"{one} as one_{c}, {duck.gender(one)} as st_{c}",
            "province": f"{one} as one_{c}, {duck.province(one)} as st_{c}",
            "short_text": f"{one} as one_{c}, {one} as st_{c}",
        }[kind])
    parts = [f"stripped as (select row_id, {strip} from ({source}))",
             f"staged as materialized (select *, {', '.join(stage)} from stripped)"]
    final, joins = [], []
    for c, kind in KINDS.items():
        if kind not in cleaning.TEXT_KINDS:
            continue
        parts.append(f"mono_{c} as (select avg(cast({duck.mono('st_' + c)} as integer)) >= 0.9 as same from staged where st_{c} is not null)")
        parts.append(f"""best_{c} as materialized (select fold, best, variants from (select lower(st_{c}) as fold, st_{c} as best,
            count(*) over (partition by lower(st_{c})) as variants, row_number() over (partition by lower(st_{c})
            order by {duck.mono('st_' + c)}, count(*) desc, st_{c} desc) as r from staged where st_{c} is not null
            group by st_{c}) where r = 1)""")
        joins.append(f"left join best_{c} on best_{c}.fold = lower(st_{c})")
        final.append(f"case when (select same from mono_{c}) then best_{c}.best else "
                     f"{duck.canonical_alone(f'best_{c}.best', False)} end as fin_{c}")
    final.append("case when cast(dig_monthly_spend as double) >= 0 then round(cast(dig_monthly_spend as double), 2) end as out_monthly_spend")
    final.append("case when cast(dig_age as double) between 1 and 120 then cast(cast(dig_age as double) as bigint) end as out_age")
    parts.append(f"joined as materialized (select staged.*, {', '.join(final)} from staged {' '.join(joins)})")
    guarded = ", ".join(f"{duck.formula('fin_' + c)} as out_{c}" for c, k in KINDS.items() if k in cleaning.TEXT_KINDS)
    parts.append(f"done as materialized (select *, {guarded} from joined)")
    return "with " + ",\n".join(parts)


_OUT = ", ".join(f"out_{c} as {c}" for c in TEXT_COLUMNS)
_IDENTITY = ", ".join(f"out_{c}" for c in TEXT_COLUMNS if c != "id")
_FIRST = f"select *, row_number() over (partition by {_IDENTITY} order by row_id) as nth, min(row_id) over (partition by {_IDENTITY}) as first from done"


def _clean(spark, sf, keep=False):
    frame = views.dirty_records(spark, sf).withColumnRenamed("row_id", cleaning.ROW)
    return cleaning.clean(frame, keep=keep)


@query("clean_customers", f"{_sql_stages(views.DIRTY_RECORDS)} select row_id, {_OUT} from ({_FIRST}) where nth = 1")
def clean_customers(spark, sf):
    return _clean(spark, sf).table.withColumnRenamed(cleaning.ROW, "row_id")


@query("dedupe_records", f"{_sql_stages(views.DIRTY_RECORDS)} select row_id, out_id as id, out_email as email from ({_FIRST}) where nth = 1")
def dedupe_records(spark, sf):
    result = _clean(spark, sf)
    return result.table.select(F.col(cleaning.ROW).alias("row_id"), "id", "email")


@query("duplicate_map", f"""{_sql_stages(views.DIRTY_RECORDS)}
    select row_id + 2 as row, first + 2 as duplicate_of_row from ({_FIRST}) where nth > 1""")
def duplicate_map(spark, sf):
    return _clean(spark, sf).duplicates


def _sql_changes() -> str:
    out = []
    for i, (c, kind) in enumerate(KINDS.items()):
        def add(reason, before, after, when, stage, seq):
            out.append(f"select row_id + 2 as row, '{c}' as column, {before} as before, cast({after} as varchar) as after, "
                       f"{duck.lit(reason)} as reason, {stage} as stage, {i} as pos, {seq} as seq from done where {when}")

        add(fixed.R_MISSING, f"raw_{c}", "null", f"{c} is null and raw_{c} <> ''", 0, 0)
        add(fixed.R_WS, f"raw_{c}", c, f"{c} <> raw_{c}", 0, 1)
        bad = {"email": fixed.R_EMAIL, "phone": fixed.R_PHONE_BAD, "date": fixed.R_DATE_BAD}
        fmt = {"email": fixed.R_CASE, "phone": fixed.R_PHONE, "date": fixed.R_DATE}
        if kind in bad:
            add(bad[kind], c, "null", f"{c} is not null and out_{c} is null", 1, 2)
            add(fmt[kind], c, f"out_{c}", f"out_{c} <> {c}", 1, 3)
        elif kind == "number":
            add(fixed.R_NUM_BAD, c, "null", f"{c} is not null and dig_{c} is null", 1, 2)
            add(fixed.R_RANGE, c, "null", f"dig_{c} is not null and out_{c} is null", 1, 3)
            add(fixed.R_NUM_FMT, c, f"dig_{c}", f"out_{c} is not null and not plain_{c}", 1, 4)
        elif kind in cleaning.TEXT_KINDS:
            add(fixed.R_WS, c, f"one_{c}", f"one_{c} <> {c}", 1, 2)
            add(fixed.R_CATEGORY, f"one_{c}", f"st_{c}", f"st_{c} <> one_{c}", 1, 3)
            add(fixed.R_CASE, f"st_{c}", f"fin_{c}", f"fin_{c} <> st_{c}", 2, 4)
            add(fixed.R_FORMULA, f"fin_{c}", f"out_{c}", f"out_{c} <> fin_{c}", 2, 5)
    return " union all ".join(out)


_CHANGES = f"{_sql_stages(views.DIRTY_RECORDS)}, log as ({_sql_changes()})"
_LOG = ["row", "column", "before", "after", "reason"]


@query("change_log", f"{_CHANGES} select row, \"column\", before, after, reason from log")
def change_log(spark, sf):
    return _clean(spark, sf).changes.select(*_LOG)


@query("change_log_capped", f"""{_CHANGES}
    select row, \"column\", before, after, reason from log
    order by case when stage = 0 then 0 else 1 end, pos, stage, row, seq limit 500""")
def change_log_capped(spark, sf):
    return cleaning.capped(_clean(spark, sf).changes).select(*_LOG)


@query("change_summary", f"""{_CHANGES}
    select reason, count(*) as count, array_to_string(list_sort(list_distinct(list(\"column\"))), ',') as columns from log group by 1""")
def change_summary(spark, sf):
    return _clean(spark, sf).summary.withColumn("columns", F.array_join("columns", ","))


_MISSING_LIMIT = 0.6 * (len(TEXT_COLUMNS) - 1)
_NULLS = " + ".join(f"cast(out_{c} is null as integer)" for c in TEXT_COLUMNS if c != "id")
_FEW = ["full_name", "email", "phone", "signup_date", "gender"]
_FEW_NULLS = " + ".join(f"cast(out_{c} is null as integer)" for c in _FEW)


@query("sparse_rows", f"""{_sql_stages(views.DIRTY_RECORDS)},
    kept as (select *, row_number() over (partition by {', '.join('out_' + c for c in _FEW)},
             case when {_FEW_NULLS} = 5 then row_id end order by row_id) as nth from done
             where {' or '.join(c + ' is not null' for c in _FEW)})
    select row_id + 2 as row, {_FEW_NULLS} as missing from kept where nth = 1 and {_FEW_NULLS} >= 3""")
def sparse_rows(spark, sf):
    frame = views.dirty_records(spark, sf).select(F.col("row_id").alias(cleaning.ROW), *_FEW)
    return cleaning.clean(frame).sparse


@query("clean_metrics", f"""{_CHANGES},
    kept as (select * from ({_FIRST}) where nth = 1),
    a as (select count(*) as rows_before from done), b as (select count(*) as rows_after from kept),
    c as (select count(*) as changes, count(distinct reason) as reasons from log),
    e as (select count(*) as n from kept where {_NULLS} >= {_MISSING_LIMIT}),
    f as (select count(*) as n from stripped where {duck.has('signup_date', fixed.DMY)}
          and {_DAY.replace('(v,', '(signup_date,')} <= 12 and {_MONTH.replace('(v,', '(signup_date,')} <= 12
          and {_DAY.replace('(v,', '(signup_date,')} <> {_MONTH.replace('(v,', '(signup_date,')})
    select rows_before, rows_after, rows_before - rows_after as rows_removed, changes,
           reasons + case when e.n > 0 then 1 else 0 end + case when f.n > 0 then 1 else 0 end as issues
    from a, b, c, e, f""")
def clean_metrics(spark, sf):
    return cleaning.metrics(_clean(spark, sf, keep=True))


_NOTES = "select doc_id as row_id, case when doc_id % 7 = 0 then '=' || text else text end as note, source as origin from documents"


@query("clean_free_text", f"""
    select row_id, md5({duck.formula('note')}) as note_md5, origin
    from (select row_id, {duck.null_tokens('note')} as note, origin from ({_NOTES}))""")
def clean_free_text(spark, sf):
    """Long texts keep their words; what a spreadsheet would run as a formula is neutralised."""
    notes = table(spark, sf, "documents").selectExpr(
        f"doc_id as {cleaning.ROW}", "case when doc_id % 7 = 0 then '=' || text else text end as note", "source as origin")
    out = cleaning.clean(notes, dedupe=False).table
    return out.select(F.col(cleaning.ROW).alias("row_id"), F.md5("note").alias("note_md5"), "origin")


@query("review_notes", f"""{_CHANGES},
    kept as (select * from ({_FIRST}) where nth = 1),
    sparse as (select row_id + 2 as row from kept where {_NULLS} >= {_MISSING_LIMIT}),
    f as (select count(*) as n from stripped where {duck.has('signup_date', fixed.DMY)}
          and {_DAY.replace('(v,', '(signup_date,')} <= 12 and {_MONTH.replace('(v,', '(signup_date,')} <= 12
          and {_DAY.replace('(v,', '(signup_date,')} <> {_MONTH.replace('(v,', '(signup_date,')})
    select replace('{fixed.N_AMBIGUOUS.format(column='signup_date', count='#', order=fixed.N_DAY_FIRST)}', '#', n::varchar) as note from f where n > 0
    union all
    select replace(replace('{fixed.N_SPARSE.format(total='#', rows='@')}', '#', count(*)::varchar), '@',
        (select string_agg(row::varchar, ', ' order by row) from (select row from sparse order by row limit 10))
        || case when count(*) > 10 then '…' else '' end) from sparse having count(*) > 0""")
def review_notes(spark, sf):
    """What a reader should look at: ambiguous dates, and mostly empty rows with the first ten named."""
    return spark.createDataFrame([(n,) for n in cleaning.flag_lines(_clean(spark, sf, keep=True))], "note string")


_CELL_COUNT = " + ".join(f"count(*) filter ({duck.null_tokens(c)} is null)" for c in TEXT_COLUMNS)


@query("profile_totals", f"""{_CHANGES},
    kept as (select * from ({_FIRST}) where nth = 1),
    a as (select count(*) as rows, {_CELL_COUNT} as null_count from ({views.DIRTY_RECORDS})),
    b as (select count(*) as rows_after from kept),
    c as (select count(distinct reason) as reasons,
                 coalesce(array_to_string(list_sort(list_distinct(list("column") filter (reason = '{fixed.R_WS}'))), ','), '') as whitespace_columns
          from log),
    e as (select count(*) as n from kept where {_NULLS} >= {_MISSING_LIMIT}),
    f as (select count(*) as n from stripped where {duck.has('signup_date', fixed.DMY)}
          and {_DAY.replace('(v,', '(signup_date,')} <= 12 and {_MONTH.replace('(v,', '(signup_date,')} <= 12
          and {_DAY.replace('(v,', '(signup_date,')} <> {_MONTH.replace('(v,', '(signup_date,')})
    select rows, {len(TEXT_COLUMNS)}::bigint as columns, null_count, rows - rows_after as duplicate_rows, whitespace_columns,
           reasons + case when rows > rows_after then 1 else 0 end + case when e.n > 0 then 1 else 0 end
           + case when f.n > 0 then 1 else 0 end as issue_count
    from a, b, c, e, f""")
def profile_totals(spark, sf):
    return cleaning.totals(_clean(spark, sf, keep=True))


@query("clean_idempotent", f"{_sql_stages(views.DIRTY_RECORDS)} select 0::bigint as changed_rows, count(*) as rows from ({_FIRST}) where nth = 1")
def clean_idempotent(spark, sf):
    from tidewell.session import materialise

    first = materialise(_clean(spark, sf).table, "clean-once")
    again = cleaning.clean(cleaning.text_frame(first))
    names = again.names
    old = first.select(cleaning.ROW, *[F.col(n).cast("string") for n in names])
    new = again.table.select(cleaning.ROW, *[F.col(n).cast("string") for n in names])
    changed = old.exceptAll(new).unionAll(new.exceptAll(old)).agg(F.count(F.lit(1)).alias("changed_rows"))
    return first.agg(F.count(F.lit(1)).alias("rows")).select(changed.scalar().alias("changed_rows"), "rows")


_UNPIVOT = "unpivot (select {} from ({})) on columns(*) into name column_name value value"
_CELLS = ("select * from (unpivot (select " + ", ".join(f"coalesce({duck.null_tokens(c)}, chr(0)) as {c}" for c in TEXT_COLUMNS)
          + f" from ({views.DIRTY_CUSTOMER})) on columns(*) into name col value v)")


def _frame(spark, sf):
    return _dirty(spark, sf).withColumnRenamed("row_id", cleaning.ROW)


@query("missing_by_column", f"""
    select col as column_name, count(*) as missing from ({_CELLS}) where v = chr(0) group by 1""")
def missing_by_column(spark, sf):
    found = cleaning.missing_counts(_frame(spark, sf)).where("missing > 0")
    return found.select(F.col("column").alias("column_name"), "missing")


@query("unique_by_column", f"""
    select col as column_name, count(distinct nullif(v, chr(0))) as uniques from ({_CELLS}) group by 1""")
def unique_by_column(spark, sf):
    return cleaning.distinct_counts(_frame(spark, sf)).select(F.col("column").alias("column_name"), F.col("distinct").alias("uniques"))


def _flag(word_set) -> str:
    return duck.words([c for c in TEXT_COLUMNS if values.name_words(c) & word_set] or [""])


_CLASSIFY = f"""
    with c as (select col, nullif(v, chr(0)) as v from ({_CELLS})),
         s as (select col, count(v) as n, count(distinct v) as u, avg(case when contains(v, '@') then 1 else 0 end) filter (v is not null) as at_share,
                      avg(case when {duck.date('v')} is not null then 1 else 0 end) filter (v is not null) as dates,
                      avg(case when {duck.digits('v')} is not null then 1 else 0 end) filter (v is not null) as numbers,
                      bool_or(regexp_full_match(v, '0\\d+')) as zeros, avg(length(v)) as len,
                      bool_and(not contains(v, '.')) filter ({duck.digits('v')} is not null) as whole,
                      max(len(string_split({duck.collapse('v')}, ' '))) as words from c group by 1),
         k as (select col, n, u, whole, case when n = 0 then 'empty' when col in {_flag(fixed.ID_WORDS)} then 'id'
             when col in {_flag(fixed.EMAIL_WORDS)} or at_share >= 0.8 then 'email'
             when col in {_flag(fixed.PHONE_WORDS)} then 'phone' when col in {_flag(fixed.GENDER_WORDS)} then 'gender'
             when dates >= case when col in {_flag(fixed.DATE_WORDS)} then 0.6 else 0.8 end then 'date'
             when not zeros and numbers >= case when col in {_flag(fixed.NUMERIC_WORDS)} then 0.5 else 0.8 end then 'number'
             when col in {_flag(fixed.PROVINCE_WORDS)} then 'province'
             when len <= 40 and words <= 6 then 'short_text' else 'free_text' end as kind from s)"""
_DISPLAY = """case when kind = 'number' then case when whole then 'integer' else 'decimal' end
    when kind in ('gender', 'province') then 'category'
    when kind = 'short_text' then case when u <= greatest(10, n * 0.2) then 'category' else 'text' end
    when kind = 'free_text' then 'text' else kind end"""


@query("classify_columns", f"{_CLASSIFY} select col as name, kind from k")
def classify_columns(spark, sf):
    found = cleaning.profile(_frame(spark, sf))
    return cleaning.column_profile(found, spark).select("name", "kind")


@query("display_kinds", f"{_CLASSIFY} select col as name, {_DISPLAY} as dtype from k")
def display_kinds(spark, sf):
    found = cleaning.profile(_frame(spark, sf))
    return cleaning.column_profile(found, spark).select("name", "dtype")


@query("profile_table", f"""{_CLASSIFY}
    select col as name, {_DISPLAY} as dtype, u as unique_count, (select count(*) from customer) - n as null_count from k""")
def profile_table(spark, sf):
    found = cleaning.profile(_frame(spark, sf))
    return cleaning.column_profile(found, spark).drop("kind")


@query("key_detection", f"""
    select 'id' as key_column from ({views.DIRTY_RECORDS}) having count(*) = count(distinct id)""")
def key_detection(spark, sf):
    found = cleaning.profile(views.dirty_records(spark, sf).withColumnRenamed("row_id", cleaning.ROW))
    return spark.createDataFrame([(k,) for k in found.keys], "key_column string")


@query("profile_text")
def profile_text(spark, sf):
    result = _clean(spark, sf, keep=True)
    body = cleaning.profile_text(result.plan, cleaning.issue_lines(result))
    lines = spark.createDataFrame([(body,)], "body string").select(F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return lines.where("line <> ''")


@query("clean_report", None)
def clean_report(spark, sf):
    told = cleaning.overview(_clean(spark, sf, keep=True))
    return told.select(F.to_json(F.struct("*")).alias("report"))
