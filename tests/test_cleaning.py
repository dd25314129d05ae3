"""Cleaning of whole files: edge cases, properties, report."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import cleaning
from tidewell.plans import views
from tidewell.sources import files


@pytest.fixture
def load(spark, tmp_path):
    def run(body, name="in.csv"):
        path = tmp_path / name
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
        return cleaning.text_frame(files.read_delimited(spark, str(path)))

    return run


def rows(result):
    out = result.table.orderBy(cleaning.ROW).drop(cleaning.ROW).collect()
    return [r.asDict() for r in out]


HEADER = ["member_id", "full_name", "mail", "mobile", "sex", "state", "joined", "balance", "tier"]
GOOD = {"full_name": "Person {i}", "mail": "person{i}@site.test", "mobile": "+2771000{i:04d}", "sex": "Female", "state": "Limpopo",
        "joined": "2021-06-{d:02d}", "balance": "{i}.25", "tier": "Silver"}
# one row per kind of fault: (column, cell as it arrives, cell after cleaning)
FAULTS = [
    ("full_name", "  lower   case name ", "Lower Case Name"), ("full_name", "UPPER NAME", "Upper Name"),
    ("mail", "MixedCase@Site.Test", "mixedcase@site.test"), ("mail", "nobody@", None), ("mail", "-", None),
    ("mobile", "071 555 0042", "+27715550042"), ("mobile", "99", None), ("sex", "f", "Female"), ("sex", "null", None),
    ("state", "LP", "Limpopo"), ("state", "limpopo", "Limpopo"), ("joined", "25/06/2021", "2021-06-25"),
    ("joined", "32/06/2021", None), ("balance", "R 1,050.50", 1050.5), ("balance", "lots", None),
    ("tier", "=cmd()", "'=cmd()"), ("tier", "sIlVeR", "Silver"),
]


def members():
    """Clean rows made from a rule, one cell of each spoilt, then a copy of row 1, a blank row and an almost empty one."""
    lines = [",".join(HEADER)]
    cells = lambda i: {"member_id": str(i)} | {k: v.format(i=i, d=1 + i % 12) for k, v in GOOD.items()}
    write = lambda row: lines.append(",".join(f'"{row[h]}"' if "," in row[h] else row[h] for h in HEADER))
    for i, (column, cell, _) in enumerate(FAULTS, 1):
        write(cells(i) | {column: cell})
    for i in range(len(FAULTS) + 1, 41):
        write(cells(i))
    write(cells(20) | {"member_id": "41"})
    lines.append("," * (len(HEADER) - 1))
    write(dict.fromkeys(HEADER, "") | {"member_id": "42", "tier": "Silver"})
    return "\n".join(lines) + "\n"


def test_members(load):
    result = cleaning.clean(load(members()))
    out = {r["member_id"]: r for r in rows(result)}
    for i, (column, _, wanted) in enumerate(FAULTS, 1):
        assert out[str(i)][column] == wanted, (column, wanted)
    assert sorted(map(int, out)) == [*range(1, 41), 42]
    assert [tuple(r) for r in result.duplicates.collect()] == [(42, 21)]
    kinds = {c.name: c.display for c in result.plan.columns}
    assert (kinds["mail"], kinds["joined"], kinds["balance"]) == ("email", "date", "decimal")
    assert result.plan.keys == ["member_id"] and result.plan.empty_rows == 1


def test_overview(load):
    result = cleaning.clean(load(members()), keep=True)
    told = cleaning.overview(result).first()
    assert tuple(told.size) == (43, 41, 1, 1, 0)
    assert [tuple(r) for r in told.repeats] == [(42, 21)] and not told.repeats_cut
    spoilt = [r for r in told.edits if r.column == "sex" and r.before == "f"]
    assert [(r.row, r.after) for r in spoilt] == [(9, "Female")] and not told.edits_cut
    assert sum(r["count"] for r in told.reasons) == result.changes.count()
    assert [r.row for r in told.sparse] == [44] and {c.name for c in told.columns} == set(HEADER)
    short = cleaning.overview(result, limit=3).first()
    assert len(short.edits) == 3 and short.edits_cut
    body = cleaning.profile_text(result.plan, cleaning.issue_lines(result))
    assert cleaning.parse_profile(body)["columns"][0] == ("member_id", "id", 1, 42)
    assert cleaning.profile_text(result.plan, [], 20) == body[:20]


def test_idempotent(load, spark, tmp_path):
    first = cleaning.clean(load(members()))
    decimals = {c.name: c.decimals for c in first.plan.kept if c.decimals is not None}
    assert decimals == {"balance": 2}
    out = str(tmp_path / "out")
    files.write_delimited(first.table.orderBy(cleaning.ROW).drop(cleaning.ROW).coalesce(1), out, decimals)
    second = cleaning.clean(cleaning.text_frame(files.read_delimited(spark, out)))
    assert second.duplicates.count() == 0
    assert rows(second) == rows(first)


def test_input_is_left_alone(load):
    frame = load(members())
    before = frame.orderBy(cleaning.ROW).collect()
    cleaning.clean(frame).table.collect()
    assert frame.orderBy(cleaning.ROW).collect() == before


def test_no_rows(load):
    result = cleaning.clean(load("left,right\n"))
    assert result.plan.rows == 0 and result.table.count() == 0 and result.plan.empty_columns == ["left", "right"]


@pytest.mark.parametrize("blank", [",,", "N/A,-,null"])
def test_empty_rows_and_columns(load, blank):
    result = cleaning.clean(load(f"city,gap,code\nOslo,,q7\n{blank}\nRome,-,q8\n"))
    assert result.plan.empty_columns == ["gap"] and result.names == ["city", "code"]
    assert result.plan.empty_rows == 1 and len(rows(result)) == 2


@pytest.mark.parametrize(("body", "column", "wanted"), [
    ("part,shelf\n0042,north\n0100,south\n", "part", ["0042", "0100"]),  # numbers with leading zeros are codes
    ('shelf,remark\nnorth,"+SUM(A1:A9)"\nsouth,fine\n', "remark", ["'+SUM(A1:A9)", "fine"]),
    ("shelf,date_due\na,06/30/2022\nb,02/05/2022\nc,11/17/2022\n", "date_due", ["2022-06-30", "2022-02-05", "2022-11-17"]),
    ('shelf,cost\na,"$3,400.75"\nb,$ 12\nc,8.5\n', "cost", [3400.75, 12.0, 8.5]),
    ("shelf,quantity\na,4\nb,many\nc,6\nd,9\n", "quantity", [4, None, 6, 9]),
])
def test_cells(load, body, column, wanted):
    assert [r[column] for r in rows(cleaning.clean(load(body)))] == wanted


def test_semicolon_and_legacy_encoding(load):
    frame = load("plaats;straat\nBrugge;Café-wal\nGenève;Öst\n".encode("cp1252"))
    assert [tuple(r)[1:] for r in frame.orderBy(cleaning.ROW).collect()] == [("Brugge", "Café-wal"), ("Genève", "Öst")]


def test_quoted_line_breaks(load):
    frame = load('ref,remark\nr1,"first\nsecond, ""third"""\nr2,plain\n')
    assert [tuple(r) for r in frame.orderBy(cleaning.ROW).collect()] == [(0, "r1", 'first\nsecond, "third"'), (1, "r2", "plain")]


def test_byte_order_mark(load):
    assert load("\ufeffcity,code\nOslo,q\n".encode()).columns == [cleaning.ROW, "city", "code"]


def test_repeats(load):
    body = "ref,city,mail\nr1,Oslo,o@x.test\nr2,Oslo,o@x.test\nr3,Rome,o@x.test\n"
    assert len(rows(cleaning.clean(load(body)))) == 3  # ref is no key by name, so it tells the rows apart
    assert len(rows(cleaning.clean(load(body), dedupe=False))) == 3
    # with a single column beside the key, the key counts
    assert len(rows(cleaning.clean(load("id,city\n1,Oslo\n2,Oslo\n")))) == 2
    assert len(rows(cleaning.clean(load("id,city,zip\n1,Oslo,9\n2,Oslo,9\n")))) == 1


def test_repeated_headers():
    assert files.unique_names(["a", " a", "b", "a "]) == ["a", "a.1", "b", "a.2"]


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported"):
        files.read_upload(spark, "x.exe")
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="No data rows"):
        files.read_upload(spark, str(tmp_path / "empty.csv"))


def test_json_shapes(spark, tmp_path):
    (tmp_path / "records.json").write_text('[{"id": 1, "price": 1.50}, {"id": 2, "price": null}]')
    out = files.read_upload(spark, str(tmp_path / "records.json")).orderBy(cleaning.ROW).collect()
    assert [(r["id"], r["price"]) for r in out] == [("1", "1.50"), ("2", None)]
    (tmp_path / "columns.json").write_text('{"id": {"0": "a", "1": "b"}, "n": {"0": "1", "1": "2"}}')
    out = files.read_json_columns(spark, str(tmp_path / "columns.json")).orderBy(cleaning.ROW).collect()
    assert [(r["id"], r["n"]) for r in out] == [("a", "1"), ("b", "2")]


def test_row_numbers_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 5000, 1, 7).selectExpr("cast(id as string) as v").write.csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        out = files.with_row_numbers(spark.read.schema("v bigint").csv(path))
        assert out.where(F.col("v") != F.col(cleaning.ROW)).count() == 0 and out.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_spelling_table_and_hot_values(load, monkeypatch):
    """The join for large spelling tables gives what the small one gives, also when one value fills the column."""
    body = "id,city\n" + "".join(f"{i},{'Cape Town' if i % 3 else 'cape town' if i % 2 else f'town {i % 7}'}\n" for i in range(300))
    small = rows(cleaning.clean(load(body), dedupe=False))
    monkeypatch.setattr(cleaning, "SMALL_TABLE_BYTES", 0)
    assert rows(cleaning.clean(load(body), dedupe=False)) == small
    monkeypatch.setattr(cleaning.skew, "HEAVY_KEYS", 1)
    assert rows(cleaning.clean(load(body), dedupe=False)) == small


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "reset-password.md").write_text("---\ntags: x\n---\n# Resetting\nUse the link.\n")
    (tmp_path / "no-heading.md").write_text("Plain body.")
    (tmp_path / "blank.md").write_text("# Only a heading\n")
    out = files.read_markdown(spark, str(tmp_path)).orderBy("title").collect()
    assert [(r["title"], r["text"]) for r in out] == [("Resetting", "Use the link."), ("no heading", "Plain body.")]


def test_one_row_group_is_dealt_over_all_cores(spark):
    """The customer table is one row group, which one task reads; the work on its cells is for all of them."""
    cores = spark.sparkContext.defaultParallelism
    for view in (views.dirty_customer, views.dirty_records):
        sizes = [r["count"] for r in view(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == cores and max(sizes) < 1.5 * sum(sizes) / cores
