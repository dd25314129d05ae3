import pytest
from pyspark.sql import functions as F

from tidewell.functions import text, values


def test_phones(column):
    """Local numbers of ten digits from 0, with country code, international ones, and what is no number."""
    local = [f"0{a} {b} {c}" for a, b, c in ((61, 200, 3004), (74, 999, 1000))] + ["061-200-3004", "(061) 2003004"]
    coded = ["+27 61 200 3004", "27612003004", "0027612003004", "+27(61)200-3004"]
    foreign = ["+31 20 555 0199", "+1 212 555 0143"]
    assert column(local, values.clean_phone) == ["+27612003004", "+27749991000", "+27612003004", "+27612003004"]
    assert column(coded, values.clean_phone) == ["+27612003004"] * 4
    assert column(foreign, values.clean_phone) == ["+31205550199", "+12125550143"]
    assert column(["4711", "1111111111", "call me", "", None], values.clean_phone) == [None] * 5


SHAPES = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d %b %Y", "%d-%b-%Y", "%b %d, %Y", "%B %d %Y", "%Y-%m-%dT%H:%M:%SZ"]


@pytest.mark.parametrize("shape", SHAPES)
def test_dates_in_every_shape(column, shape):
    import datetime

    days = [datetime.datetime(1999, 12, 31), datetime.datetime(2020, 2, 29), datetime.datetime(2031, 7, 8)]
    out = column([d.strftime(shape) for d in days], lambda c: F.date_format(values.parse_date(c, True), "yyyy-MM-dd"))
    assert out == [d.strftime("%Y-%m-%d") for d in days]


@pytest.mark.parametrize(("given", "day_first", "expected"), [
    ("09/10/2018", True, "2018-10-09"), ("09/10/2018", False, "2018-09-10"), ("28/09/2018", False, "2018-09-28"),
    ("30/02/2018", True, None), ("10/2018/09", True, None), ("1750-05-05", True, None), ("next week", True, None),
])
def test_order_and_bad_dates(column, given, day_first, expected):
    assert column([given], lambda c: F.date_format(values.parse_date(c, day_first), "yyyy-MM-dd")) == [expected]


def test_times(column):
    out = column(["2018-10-09 23:59:58+05:30"], lambda c: F.date_format(values.parse_date(c, True), "yyyy-MM-dd HH:mm:ss"))
    assert out == ["2018-10-09 23:59:58"]


def test_numbers(column):
    good = {"88.75": 88.75, "R6,070.10": 6070.1, "$ 19": 19.0, "-41": -41.0, "3 600,5": 3600.5}
    assert column(list(good), values.parse_number) == list(good.values())
    assert column(["2e9", "nan", "ten", "4,5,6", None], values.parse_number) == [None] * 5
    assert column(["88.75", "$19", " 19"], values.number_is_plain) == [True, False, True]


def test_titles(column):
    given = ["willem van den berg", "d'arcy", "DE KLERK-MEYER", "le roux"]
    assert column(given, text.smart_title) == ["Willem van den Berg", "D'Arcy", "De Klerk-Meyer", "Le Roux"]


def test_null_tokens_and_formulas(column):
    assert column([" N/A ", "", " x ", "null", "-", "--x"], text.null_tokens) == [None, None, "x", None, None, "--x"]
    assert column(["=1+1", "@x", "-5", "-x", "+ 1", "ok"], text.guard_formula) == ["'=1+1", "'@x", "-5", "'-x", "+ 1", "ok"]


def test_emails(column):
    given = ["User@Example.COM", "user@", "test@test.com", "a.b+c@sub.domain.org"]
    assert column(given, values.clean_email) == ["user@example.com", None, None, "a.b+c@sub.domain.org"]


def test_name_words():
    assert values.name_words("signupDate_2") == {"signup", "date"}
    assert values.number_bounds("monthlySpend") == (0.0, None)
    assert values.number_bounds("Age") == (1.0, 120.0)
