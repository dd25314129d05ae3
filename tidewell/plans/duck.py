"""Fragments of DuckDB SQL that say the same as the Spark expressions; used for the SQL twins only."""

from __future__ import annotations

from tidewell import fixed


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(lit(w) for w in items) + ")"


def sub(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(by)}, 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {lit(pattern)})"


def trim(c: str) -> str:
    return sub(c, f"^{fixed.WS}+|{fixed.WS}+$")


def collapse(c: str) -> str:
    return sub(c, f"{fixed.WS}+", " ")


def null_tokens(c: str) -> str:
    t = trim(c)
    return f"case when lower({t}) in {words(fixed.NULL_TOKENS)} then null else {t} end"


def title(c: str) -> str:
    part = "upper(p[1]) || p[2:]"
    by_quote = f"array_to_string(list_transform(string_split(h, ''''), lambda p: {part}), '''')"
    by_hyphen = f"array_to_string(list_transform(string_split(w, '-'), lambda h: {by_quote}), '-')"
    return (
        f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w, i: case when i > 1 and w in "
        f"{words(fixed.NAME_PARTICLES)} then w else {by_hyphen} end), ' ')"
    )


def mono(c: str) -> str:
    return (f"({has(c, '[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Ll}]')} and (not {has(c, '[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Lt}]')} "
            f"or not {has(c, '[' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')}))")


def acronym(c: str) -> str:
    return f"(length({c}) <= 3 and {c} = upper({c}) and {c} <> lower({c}))"


def canonical_alone(c: str, consistent: bool) -> str:
    if consistent:
        return c
    return f"case when {mono(c)} and not {acronym(c)} then {title(c)} else {c} end"


def formula(c: str) -> str:
    return f"case when {has(c, '^([=@]|[+-][^0-9. ])')} then '''' || {c} else {c} end"


def number_text(c: str) -> str:
    t = trim(f"replace({c}, chr(160), ' ')")
    return f"replace({sub(t, fixed.CURRENCY_MARK)}, ' ', '')"


def digits(c: str) -> str:
    t = number_text(c)
    return (f"case when {has(t, fixed.PLAIN_NUMBER)} then {t} when {has(t, fixed.THOUSANDS_NUMBER)} "
            f"then replace({t}, ',', '') when {has(t, fixed.DECIMAL_COMMA)} then replace({t}, ',', '.') end")


def plain(c: str) -> str:
    t = number_text(c)
    return f"({has(t, fixed.PLAIN_NUMBER)} and {t} = {trim(c)})"


def _date(y: str, m: str, d: str) -> str:
    return f"try_cast(printf('%04d-%02d-%02d', cast({y} as integer), cast({m} as integer), cast({d} as integer)) as date)"


def date(c: str, day_first: bool = True) -> str:
    y = [f"regexp_extract({c}, {lit(fixed.YMD)}, {g})" for g in (1, 2, 3)]
    d = [f"regexp_extract({c}, {lit(fixed.DMY)}, {g})" for g in (1, 2, 3)]
    dm, md = _date(d[2], d[1], d[0]), _date(d[2], d[0], d[1])
    first, second = (dm, md) if day_first else (md, dm)
    formats = ["%B %d %Y", "%b %d %Y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%d %B, %Y", "%d-%b-%Y"]
    names = "[" + ", ".join(lit(f) for f in formats) + "]"
    return (f"case when {has(c, fixed.YMD)} then {_date(*y)} when {has(c, fixed.DMY)} then coalesce({first}, {second}) "
            f"else cast(try_strptime({c}, {names}) as date) end")


def phone(c: str) -> str:
    raw = sub(c, r"[^\d+]")
    dig = f"(case when {raw} like '00%' then '+' || substr({raw}, 3) else {raw} end)"
    bare = sub(dig, r"^\++")
    one = f"length(replace({bare}, substr({bare}, 1, 1), '')) = 0"
    return (f"case when {bare} = '' or {one} then null when {dig} like '+27%' and length({bare}) = 11 then '+' || {bare} "
            f"when {bare} like '27%' and length({bare}) = 11 and {dig} not like '+%' then '+' || {bare} "
            f"when {dig} like '0%' and length({dig}) = 10 then '+27' || substr({dig}, 2) "
            f"when {dig} like '+%' and length({bare}) between 8 and 15 then '+' || {bare} end")


def email(c: str) -> str:
    return (f"case when {has(f'lower({c})', fixed.EMAIL_VALID)} and lower({c}) not in {words(fixed.PLACEHOLDER_EMAILS)} "
            f"then lower({c}) end")


def alias(c: str, table: dict[str, str]) -> str:
    return f"case {c} " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items()) + " end"


def gender(c: str) -> str:
    return f"coalesce({alias(f'lower({c})', fixed.GENDERS)}, {c})"


def province(c: str) -> str:
    return f"coalesce({alias(sub(f'lower({c})', '[^a-z]'), fixed.PROVINCES)}, {c})"


def tokens(c: str) -> str:
    return (f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]{{3,}}')), "
            f"lambda w: w not in {words(fixed.STOP_WORDS)})")


def redact(c: str) -> str:
    return sub(sub(c, fixed.EMAIL_FIND, "[EMAIL]"), fixed.PHONE_FIND, "[PHONE]")


def first_email(c: str) -> str:
    return f"nullif(lower(regexp_extract({c}, {lit(fixed.EMAIL_FIND)}, 0)), '')"
