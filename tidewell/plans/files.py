"""Registered source and sink queries: each writes its own files from the tables, then reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import cleaning, estimates
from tidewell.plans import cleaning as clean_plans
from tidewell.plans import duck, support, views
from tidewell.plans.registry import ORACLES, documents, query, table
from tidewell.session import work_dir
from tidewell.sources import files

_COLUMNS = ["id", "full_name", "email", "phone", "monthly_spend"]


@query("scan_csv_text", f"select row_number() over (order by row_id) - 1 as row, {', '.join(_COLUMNS)} from ({views.DIRTY_CUSTOMER})")
def scan_csv_text(spark, sf):
    path = work_dir(spark, "scan") + ".csv"
    ordered = views.dirty_customer(spark, sf).orderBy("row_id").select(*_COLUMNS)
    ordered.write.option("header", True).option("sep", ";").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_delimited(spark, path).withColumnRenamed(cleaning.ROW, "row")


@query("scan_sniff_delimiter", "select * from (values (',', ','), (';', ';'), (chr(9), chr(9)), ('|', '|')) t(written, found)")
def scan_sniff_delimiter(spark, sf):
    people = views.dirty_customer(spark, sf).select(*_COLUMNS)
    found = []
    for mark in files.DELIMITERS:
        path = work_dir(spark, "sniff")
        people.write.option("header", True).option("sep", mark).csv(path)
        seen = files.delimiters(spark, path).select(F.lit(mark).alias("written"), F.col("delimiter").alias("found"))
        found.append(seen.distinct())
    return found[0].unionAll(found[1]).unionAll(found[2]).unionAll(found[3])


@query("scan_encoding_detect", """
    select 'UTF-8' as written, 'UTF-8' as found, count(*) as rows from documents
    union all select 'ISO-8859-1', case when max(cast(text <> regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as integer)) = 1
        then 'windows-1252' else 'UTF-8' end, count(*) from documents""")
def scan_encoding_detect(spark, sf):
    docs = documents(spark, sf)
    lines = docs.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    out = []
    for name in ("UTF-8", "ISO-8859-1"):
        path = work_dir(spark, "encoding")
        lines.write.option("encoding", name).option("escapeQuotes", False).csv(path)
        found = files.common_encoding(files.encodings(spark, path))
        rows = lines.agg(F.count(F.lit(1)).alias("rows"))
        out.append(found.select(F.lit(name).alias("written"), F.col("encoding").alias("found"), rows.scalar().alias("rows")))
    return out[0].unionAll(out[1])


_CELL = "c_name || chr(10) || '\"' || c_mktsegment || '\", ' || chr(10) || cast(c_custkey as {text})"


@query("scan_csv_breaks", f"select cast(c_custkey as varchar) as id, {_CELL.format(text='varchar')} as note from customer")
def scan_csv_breaks(spark, sf):
    """Cells with quotes, delimiters and line breaks; eight files, read one per task."""
    path = work_dir(spark, "breaks") + ".csv"
    rows = table(spark, sf, "customer").selectExpr("cast(c_custkey as string) as id", f"{_CELL.format(text='string')} as note")
    rows.repartition(8).write.option("header", True).option("escape", '"').csv(path)
    return files.read_delimited(spark, path).drop(cleaning.ROW)


@query("scan_legacy_text", "select cast(c_custkey as varchar) as id, c_name || ' – café „Österreich“ €' || cast(c_custkey as varchar) as note from customer")
def scan_legacy_text(spark, sf):
    """Files in windows-1252: the signs that ISO-8859-1 lacks come back."""
    path = work_dir(spark, "legacy") + ".csv"
    note = F.concat("c_name", F.lit(" – café „Österreich“ €"), F.col("c_custkey").cast("string"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), note.alias("note"))
    rows = rows.withColumn("note", F.translate("note", files.LEGACY_SIGNS, files.LATIN_CONTROLS))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_delimited(spark, path).drop(cleaning.ROW)


@query("scan_mixed_folder", """
    select cast(c_custkey as varchar) as id, case when c_custkey % 5 < 4 then c_name || case when c_custkey % 5 = 1 then ' – „café“' else '; é' end end as name,
        case when c_custkey % 5 = 2 then c_mktsegment || chr(10) || '"' || cast(c_nationkey as varchar) || '"' else c_mktsegment end as segment,
        case when c_custkey % 5 in (0, 3) then cast(c_nationkey as varchar) end as nation
    from customer""")
def scan_mixed_folder(spark, sf):
    """One folder of files that differ in delimiter, encoding, order of columns, columns and quoted line breaks."""
    path = work_dir(spark, "mixed")
    people = table(spark, sf, "customer").withColumn("kind", F.col("c_custkey") % 5)
    key, segment, nation = F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string")
    plain = F.concat("c_name", F.lit("; é")).alias("name")
    signs = F.translate(F.concat("c_name", F.lit(" – „café“")), files.LEGACY_SIGNS, files.LATIN_CONTROLS).alias("name")
    broken = F.concat("c_mktsegment", F.lit('\n"'), nation, F.lit('"')).alias("segment")
    parts = [
        (",", "UTF-8", [key, plain, segment, nation.alias("nation")]), (";", "ISO-8859-1", [segment, key, signs]), ("\t", "UTF-8", [key, plain, broken]),
        ("|", "UTF-8", [nation.alias("nation"), plain, key, segment]), (",", "UTF-8", [segment, key])]
    for kind, (mark, encoding, columns) in enumerate(parts):
        rows = people.where(F.col("kind") == kind).select(*columns).repartition(2)
        rows.write.mode("append").option("header", True).option("sep", mark).option("encoding", encoding).option("escape", '"').csv(path)
    return files.read_delimited(spark, path).select("id", "name", "segment", "nation")


@query("scan_repeated_headers", 'select cast(c_custkey as varchar) as code, c_name as "code.1", c_mktsegment as "code.2" from customer')
def scan_repeated_headers(spark, sf):
    path = work_dir(spark, "headers") + ".csv"
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias(" code"), F.col("c_mktsegment").alias("code "))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_delimited(spark, path).drop(cleaning.ROW)


@query("scan_json_columns", "select c_custkey as row, c_name as name, cast(c_nationkey as varchar) as nation from customer")
def scan_json_columns(spark, sf):
    """Column-form JSON, {column: {row: value}}, in documents of at most a hundred rows."""
    path = work_dir(spark, "columns")
    key = F.col("c_custkey").cast("string")
    one = lambda c: F.map_from_entries(F.collect_list(F.struct(key, F.col(c).cast("string"))))
    docs = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(
        F.to_json(F.struct(one("c_name").alias("name"), one("c_nationkey").alias("nation"))).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json_columns(spark, path).withColumnRenamed(cleaning.ROW, "row")


@query("kb_array_scan", f"select title, md5(text) as text_md5 from ({views.KB})")
def kb_array_scan(spark, sf):
    """A knowledge base in files that hold an array of records each."""
    path = work_dir(spark, "kb-arrays")
    lists = views.kb(spark, sf).groupBy(F.floor(F.col("doc_id") / 50)).agg(
        F.to_json(F.collect_list(F.struct("title", "text"))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_knowledge_json(spark, path).select("title", F.md5("text").alias("text_md5"))


@query("scan_json_text", "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, cast(o_custkey as varchar) as o_custkey from orders")
def scan_json_text(spark, sf):
    path = work_dir(spark, "json")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").write.json(path)
    return files.read_json_records(spark, path, multi_line=False).drop(cleaning.ROW)


@query("scan_json_array", """
    select cast(o_orderkey as varchar) as key, o_clerk || '}, {"\\ [' || o_comment as note, cast(o_custkey as varchar) as customer from orders""".replace("o_clerk", "o_orderstatus").replace("o_comment", "o_orderpriority"))
def scan_json_array(spark, sf):
    """Files of one JSON array each, nested and with brackets in strings, every file cut by many tasks."""
    path = work_dir(spark, "arrays")
    note = F.concat("o_orderstatus", F.lit('}, {"\\ ['), "o_orderpriority").alias("note")
    rows = table(spark, sf, "orders").select(
        F.struct(F.col("o_orderkey").alias("key"), note, F.struct(F.col("o_custkey").alias("id"), F.array(F.lit(1), F.lit(2)).alias("list")).alias("customer")).alias("r"),
        F.floor(F.col("o_orderkey") / 4000).alias("part"))
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = files.read_json_array(spark, path, "key string, note string, customer struct<id: string>")
    return read.select("key", "note", F.col("customer.id").alias("customer"))


@query("unique_estimates", """
    select 'user_id' as "column", count(distinct user_id) as exact, true as close, 0 as again from events
    union all select 'event_id', count(distinct event_id), true, 0 from events
    union all select 'value', count(distinct value), true, 0 from events""")
def unique_estimates(spark, sf):
    """Distinct counts from sketches per file within 3% of the exact ones; a second run has no file to read."""
    columns, held = ["user_id", "event_id", "value"], work_dir(spark, "sketches")
    source = f"{sf}/events.parquet"
    estimates.update_sketches(spark, source, held, columns)
    again = estimates.update_sketches(spark, source, held, columns)
    exact = table(spark, sf, "events").agg(*[F.count_distinct(c).alias(c) for c in columns])
    exact = exact.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(F.col, columns)))).alias("column", "exact"))
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.03 * F.col("exact"))
    return exact.join(estimates.estimates(spark, source, held), "column").select("column", "exact", close.alias("close"), F.lit(again).alias("again"))


@query("scan_guard", r"""
    with f as (select page_id, 'page.' || case page_id % 4 when 0 then 'csv' when 1 then 'json' when 2 then 'exe' else 'CSV' end as name,
                      case when page_id % 5 = 0 then 0 else length(html) * 1000 end as size from pages)
    select page_id, case when lower(regexp_extract(name, '\.([^./]+)$', 1)) not in ('csv', 'json') then 'unsupported file type'
           when size > 10485760 then 'file too large' when size = 0 then 'no data rows' end as rejected from f""")
def scan_guard(spark, sf):
    kind = F.element_at(F.array(F.lit("csv"), F.lit("json"), F.lit("exe"), F.lit("CSV")), (F.col("page_id") % 4 + 1).cast("int"))
    size = F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html") * 1000)
    named = table(spark, sf, "pages").select("page_id", F.concat(F.lit("page."), kind).alias("name"), size.alias("size"))
    return named.select("page_id", files.file_verdict(F.col("name"), F.col("size"), 10_485_760).alias("rejected"))


@query("kb_json_scan", f"select title, md5(text) as text_md5 from ({views.KB})")
def kb_json_scan(spark, sf):
    path = work_dir(spark, "kb")
    views.kb(spark, sf).select("title", "text").write.json(path)
    read = spark.read.schema("title string, text string").json(path)
    return read.select("title", F.md5("text").alias("text_md5"))


@query("kb_markdown_scan")
def kb_markdown_scan(spark, sf):
    """Documents written as Markdown files of a few notes each, then scanned, cut and titled."""
    path = work_dir(spark, "markdown")
    docs = documents(spark, sf)
    note = F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n# Note "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    docs.select(note.alias("value")).write.option("maxRecordsPerFile", 50).text(path)
    return files.read_markdown(spark, path, pattern="*.txt").select("title", F.md5("text").alias("text_md5"))


@query("sink_csv_decimals", ORACLES["clean_customers"].rsplit(" select row_id,", 1)[0]
       + f" select row_id, id, out_email as email, case when out_monthly_spend is not null then printf('%.2f', out_monthly_spend) end as monthly_spend, "
       f"cast(out_age as varchar) as age from ({clean_plans._FIRST}) where nth = 1")
def sink_csv_decimals(spark, sf):
    result = clean_plans._clean(spark, sf)
    decimals = {c.name: c.decimals for c in result.plan.kept if c.decimals is not None}
    path = work_dir(spark, "clean-csv")
    files.write_delimited(result.table.withColumnRenamed(cleaning.ROW, "row_id").select(
        "row_id", "id", "email", "monthly_spend", "age"), path, decimals)
    return spark.read.schema("row_id bigint, id string, email string, monthly_spend string, age string").option(
        "header", True).csv(path)


@query("audit_log_sink", ORACLES["audit_log"].replace(", customer_id,", ", customer_id,"))
def audit_log_sink(spark, sf):
    path = work_dir(spark, "audit")
    rows = support.audit_log(spark, sf)
    files.append_table(rows, path, "day")
    return spark.read.schema(rows.schema).parquet(path)


@query("learning_queue_sink", ORACLES["learning_queue"])
def learning_queue_sink(spark, sf):
    path = work_dir(spark, "queue")
    rows = support.learning_queue(spark, sf)
    files.append_table(rows, path)
    return spark.read.schema(rows.schema).parquet(path)
