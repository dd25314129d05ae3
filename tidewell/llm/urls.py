"""URL filters: pattern rules indexed by their rarest literal token; only the fetched rules run a regular expression.

A rule is ``(rule, filter, verdict, site)``.  Filters are matched against host (lower-cased) followed by path and use four
signs: ``||`` at the start (the host or any parent of it), ``|`` at the start or end (there), ``*`` (anything) and ``^`` (an
end or a character other than letters, digits, ``_`` and ``%``).  Site rules (``site`` true) decide first, the longest one
wins, ties by name; without one a page is blocked if a blocking pattern fits and no allowing one does.

A literal token is a run of ``a-z 0-9`` in the filter with another sign, but no ``*``, on both sides: a text that fits must
hold it as a whole token.  Token counts over the pages' addresses say which token of a rule is the rarest.  Rules without such a
token are kept under the empty token, which every address has.  All joins are equi-joins on tokens or addresses; Spark
broadcasts a side only when its size is known to be small, and splits hot ones otherwise.

Defined results: a null address or one without ``://`` has an empty host and path, fits no site rule and gets the verdict of
the patterns (allow by default); repeated rows give a row each; extra columns are left alone; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import materialise

# fixed values: the sites judged by name
SITES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
BLOCKED_WORDS = (
    "casino", "poker", "jackpot", "betting", "pills", "viagra", "cialis", "porn", "xxx", "escort", "payday", "replica", "warez",
    "torrent", "adserver", "doubleclick",
)
RULE = "rule string, filter string, verdict string, site boolean"
SPECIAL = r"([\\\[\](){}.+?$|])"


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(name, f"||{name}", verdict, True) for name, verdict in SITES]
    rows += [(f"word {word}", f"^{word}^", "block", False) for word in BLOCKED_WORDS]
    return spark.createDataFrame(rows, RULE)


def host(url: Column) -> Column:
    return _lower(_part(url, "([^/?#]*)"))


def path(url: Column) -> Column:
    return _part(url, "[^/?#]*([^?#]*)")


def _part(url: Column, tail: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), f"(?s)^.*?://{tail}", 1)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(text), F.lit(pattern), 1))


def pattern(rule: Column) -> Column:
    """The regular expression of a filter."""
    body = F.regexp_replace(rule, r"^\|\|?", "")
    body = F.regexp_replace(body, r"\|$", "")
    body = F.regexp_replace(body, SPECIAL, r"\\$1")
    body = F.regexp_replace(body, r"\*", ".*")
    body = F.regexp_replace(body, r"\^", "(?:^|[^A-Za-z0-9_%]|\\$)")
    head = F.when(rule.startswith("||"), r"^(?:[^/]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    return F.concat(F.lit("(?s)"), head, body, F.when(rule.rlike(r".\|$"), r"\z").otherwise(""))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (the site rule that decided, else null) and ``verdict`` for every page."""
    rows = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    subject = F.concat("host", "path")
    addresses = rows.select(subject.alias("subject")).distinct()
    addresses = materialise(addresses.select("subject", _tokens(F.col("subject"), "([a-z0-9]+)").alias("tokens")), "addresses")

    listed = rules.select(
        "rule", "verdict", "site", pattern(F.col("filter")).alias("pattern"),
        _tokens(F.col("filter"), r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])").alias("tokens"))
    listed = materialise(listed, "rules")
    each = listed.select("rule", "pattern", F.explode("tokens").alias("token"))
    asked = each.select("token").distinct()
    seen = addresses.select(F.explode("tokens").alias("token")).join(asked, "token", "left_semi").groupBy("token").count()
    rarest = each.join(seen, "token", "left").groupBy("rule", "pattern").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("token").alias("token")))["token"].alias("token"))
    index = listed.drop("tokens").join(rarest, ["rule", "pattern"], "left").withColumn("token", F.coalesce("token", F.lit("")))
    index = materialise(index, "index")

    offered = addresses.select("subject", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
    fits = offered.join(index, "token").where(F.rlike("subject", F.col("pattern")))
    best = F.max(F.when(F.col("site"), F.struct(F.length("rule").alias("size"), F.col("rule"), F.col("verdict"))))
    says = lambda verdict: F.max(~F.col("site") & (F.col("verdict") == verdict))
    decided = fits.groupBy("subject").agg(best.alias("best"), says("block").alias("blocked"), says("allow").alias("allowed"))
    by_patterns = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return rows.withColumn("subject", subject).join(decided, "subject", "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), by_patterns).alias("verdict"))


def oracle() -> str:
    """The same with every rule tried on every page."""
    cases = sorted(SITES, key=lambda s: -len(s[0]))
    fits = lambda s: (
        f"((host = '{s.split('/', 1)[0]}' or ends_with(host, '.{s.split('/', 1)[0]}')) "
        f"and starts_with(path, '/{s.split('/', 1)[1]}'))")
    rule = "case " + " ".join(f"when {fits(s)} then '{s}'" for s, _ in cases) + " end"
    words = "|".join(BLOCKED_WORDS)
    verdicts = " ".join(f"when '{s}' then '{v}'" for s, v in cases)
    return f"""
        with parts as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
            from pages),
        cut as (
            select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
            from parts),
        ruled as (select *, {rule} as rule from cut)
        select page_id, host, path, rule,
            coalesce(case rule {verdicts} end,
                case when regexp_matches(host || path, '(^|[^A-Za-z0-9_%])({words})([^A-Za-z0-9_%]|$)') then 'block' else 'allow' end) as verdict
        from ruled"""
