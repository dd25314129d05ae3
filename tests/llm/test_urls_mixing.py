"""URL rules against every rule on every page; Poisson replication against its distribution."""

import math
import random
import re

from pyspark.sql import functions as F

from tidewell.llm import mixing, urls


def as_regex(rule):
    body = re.sub(r"^\|\|?|\|$", "", rule)
    body = re.escape(body).replace(r"\*", ".*").replace(r"\^", r"(?:^|[^A-Za-z0-9_%]|$)")
    head = r"^(?:[^/]*\.)?" if rule.startswith("||") else "^" if rule.startswith("|") else ""
    return head + body + (r"\Z" if rule.endswith("|") else "")


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [r for r in rules if re.search(as_regex(r[1]), host + path, re.S)]
    site = sorted((len(r[0]), r[0], r[2]) for r in fits if r[3])
    if site:
        return host, path, site[-1][1], site[-1][2]
    block, allow = (any(r[2] == v for r in fits) for v in ("block", "allow"))
    return host, path, None, "block" if block and not allow else "allow"


def test_urls(spark):
    rng = random.Random(1)
    names = ["Example", "org", "com", "casino", "a", "sub", "x-casino", "fr", "xn_y", "1", "é"]
    urls_ = [None, "", "nothing", "://", "HTTP://A.ORG", "http://a.org/", "http://org/x?y", "a://b://org/", "http://u@org/", "http://org:80/",
             "http://example.org/en/12", "http://notorg/", "http://q.example.org/en?x=/es/", "http://com/FR/"]
    for _ in range(400):
        host = ".".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
        urls_.append(f"http://{host}/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "?a", "#b"]))
    rules = [(n, f"||{n}", v, True) for n, v in urls.SITES] + [
        ("w", "^casino^", "block", False), ("in", "a/sub", "block", False), ("star", "||a.*/1|", "block", False),
        ("none", "asin", "block", False), ("but", "|sub.", "allow", False), ("dots", ".fr/", "block", False)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls_ + urls_[:20])], "page_id long, url string, rule string")
    got = urls.judge(pages, spark.createDataFrame(rules, urls.RULE)).collect()
    assert len(got) == len(urls_) + 20
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge((urls_ + urls_[:20])[r.page_id], rules), (urls_ + urls_[:20])[r.page_id]
    assert urls.judge(pages.where("false"), urls.default_rules(spark)).count() == 0


def test_mixing_follows_poisson(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 30_000, "hot").when(F.col("id") < 39_000, "mid").alias("source"))
    shares = spark.createDataFrame([("hot", 1.0), ("mid", 2.0), (None, 1.0), ("absent", 0.0)], "source string, share double")
    rate = {r.source: r.rate for r in mixing.rates(docs, shares=shares).collect()}
    assert math.isclose(rate["hot"], 1 / 3) and math.isclose(rate["mid"], 20_000 / 9_000) and math.isclose(rate[None], 10)
    mixed = mixing.mix(docs, shares=shares)
    copies = mixed.groupBy("doc_id", "source").count().collect()
    for source, size in (("hot", 30_000), ("mid", 9_000), (None, 1_000)):
        counts = [r["count"] for r in copies if r.source == source]
        assert abs(sum(counts) / size - rate[source]) < 5 * math.sqrt(rate[source] / size)
        zero = size * math.exp(-rate[source])
        assert abs(size - len(counts) - zero) < 5 * math.sqrt(zero + 1)
    assert mixed.count() == mixed.distinct().count()


def test_mixing_edges(spark, docs):
    table = docs(["a", None, "", "b"])
    mixed = mixing.mix(table)
    assert mixed.columns == [*table.columns, "copy"]
    assert mixing.mix(table.where("false")).count() == 0
    twice = mixing.mix(table.union(table), epochs=40.0).groupBy("doc_id", "copy").count().collect()
    assert {r["count"] for r in twice} == {2}
    large = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    assert abs(mixing.mix(large, epochs=900.0).count() / 45_000 - 1) < 0.03


def test_mixing_keeps_clashing_columns(spark):
    table = spark.createDataFrame(
        [(i, f"s{i % 2}", f"own {i}", i * 0.5, -i, "x") for i in range(60)],
        "doc_id long, source string, copy string, _u double, _n long, steps string")
    mixed = mixing.mix(table, epochs=3.0)
    assert mixed.columns == [*table.columns, "copy_2"]
    rows = mixed.collect()
    assert all(r["copy"] == f"own {r.doc_id}" and r._u == r.doc_id * 0.5 and r._n == -r.doc_id for r in rows)
    plain = mixing.mix(table.select("doc_id", "source"), epochs=3.0, copy="turn").collect()
    assert sorted((r.doc_id, r.copy_2) for r in rows) == sorted((r.doc_id, r.turn) for r in plain)
