"""Grading of answers and code submissions against keys and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text
from tidewell.functions.values import alias
from tidewell.operators import lint
from tidewell.operators.skew import spread_join

PRIVATE = ["solution", "answer", "rubric", "explanation"]
# fixed values: where each track's review lesson lives
REVIEW_LESSONS = {"python": "python-1", "datascience": "ds-3", "java": "java-1", "spring": "spring-3"}
DIFFICULTY_ORDER = {"easy": 0, "medium": 1, "hard": 2}


def points(difficulty: Column) -> Column:
    return alias(difficulty, fixed.POINTS)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def public_view(challenges: DataFrame) -> DataFrame:
    """What a learner may see before answering; ``rubric`` is the number of checks of an exercise that has them."""
    return challenges.select(
        *[c for c in challenges.columns if c not in [*PRIVATE, "hints"]],
        points(F.col("difficulty")).alias("points"), F.col("hints").alias("hint_count"),
        alias(F.col("track"), REVIEW_LESSONS).alias("review_lesson"),
        F.when(F.col("kind") == "code", "browser").otherwise("server").alias("graded"),
        F.when(F.col("kind") == "rubric", F.col("rubric")).alias("check_count"),
    )


def rejected_answer(kind: Column, options: Column, choice: Column, code: Column) -> Column:
    """Why an answer cannot be graded here, or null."""
    blank = text.trim_all(F.coalesce(code, F.lit(""))) == ""
    return (
        F.when(kind == "code", fixed.ANSWER_BROWSER)
        .when((kind == "mcq") & (choice.isNull() | (choice >= options)), fixed.ANSWER_OPTION)
        .when((kind == "rubric") & blank, fixed.ANSWER_BLANK)
    )


def challenge_list(challenges: DataFrame, track: str) -> DataFrame:
    rank = alias(F.col("difficulty"), DIFFICULTY_ORDER)
    return public_view(challenges.where(F.col("track") == track)).orderBy(rank, "challenge_id")


def grade_mcq(submissions: DataFrame, challenges: DataFrame) -> DataFrame:
    keys = challenges.select("challenge_id", "answer", "explanation", "difficulty")
    both = spread_join(submissions, keys, "challenge_id").where(F.col("answer").isNotNull())
    passed = F.col("choice") == F.col("answer")
    return both.select(
        "submission_id", passed.alias("passed"), F.col("answer").alias("correct_index"), "explanation",
        F.when(passed, points(F.col("difficulty"))).otherwise(0).alias("points"),
    )


def rubric_table(spark, rules: list[tuple]) -> DataFrame:
    """Rules (challenge, rule, pattern, must, fix) as one row per challenge with its list of rules."""
    rows = spark.createDataFrame(rules, "rubric string, rule string, pattern string, must boolean, fix string")
    packed = F.sort_array(F.collect_list(F.struct("rule", "pattern", "must", "fix")))
    return rows.groupBy("rubric").agg(packed.alias("rules"))


def check_rubric(submissions: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Adds ``checks``: one (rule, ok, message) per rule, matched against the code without strings and comments.

    The rules come as one row per rubric, so code is joined once and never shuffled again.
    """
    bare = submissions.withColumn("_bare", text.strip_code(F.col("code")))
    both = spread_join(bare, rubrics, "rubric").where(F.col("rules").isNotNull())
    judged = F.transform("rules", lambda r: F.struct(
        r["rule"].alias("rule"), (F.regexp_like(F.col("_bare"), r["pattern"]) == r["must"]).alias("ok"),
        r["fix"].alias("fix")))
    return both.withColumn("checks", judged).drop("_bare", "rules")


def grade_rubric(submissions: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Score, pass only when every rule holds, and the advice for rules that do not."""
    judged = check_rubric(submissions, rubrics)
    ok = F.size(F.filter("checks", lambda c: c["ok"]))
    total = F.size("checks")
    score = F.bround((ok / total).cast("double"), 2)
    advice = F.transform(F.filter("checks", lambda c: ~c["ok"]), lambda c: c["fix"])
    return judged.select(
        "snippet_id", "rubric", ok.alias("ok"), total.alias("total"), score.alias("score"), (ok == total).alias("passed"),
        F.array_join(advice, " ").alias("advice"),
    )


def rubric_notes(submissions: DataFrame) -> DataFrame:
    """Errors and warnings of the language rules, shown beside the rubric."""
    found = lint.lint_java(submissions.where("language = 'java'")).unionByName(
        lint.lint_java(submissions.where("language = 'spring'"), spring=True))
    return found.where(F.col("severity").isin("error", "warning")).select("snippet_id", "rule", "severity")


def attempt_score(full: Column, fraction: Column, hints: Column, revealed: Column) -> Column:
    """Points of an attempt: 25% off per hint, nothing once the solution was shown."""
    kept = F.greatest(F.lit(0.0), 1 - fixed.HINT_PENALTY * hints)
    return F.when(revealed, 0).otherwise(F.greatest(F.lit(0), round_half_up(full * fraction * kept))).cast("int")


def partial_credit(passed: Column, checks: Column, code: Column, starter: Column) -> Column:
    """Share of checks passed; an unchanged starter earns nothing."""
    share = F.coalesce(F.try_divide(passed.cast("double"), checks.cast("double")), F.lit(0.0))
    return F.when(text.trim_all(code) == text.trim_all(starter), 0.0).otherwise(share)


def interview_summary(attempts: DataFrame, learner: str) -> DataFrame:
    """Points per learner with percent, band and the difficulties to work on."""
    earned, most = F.sum("points"), F.sum("full_points")
    percent = F.coalesce(round_half_up(F.try_divide(earned, most) * 100), F.lit(0)).cast("int")
    missed = F.array_join(F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("difficulty")))), ",")
    out = attempts.groupBy(learner).agg(earned.alias("earned"), most.alias("full_points"), percent.alias("percent"), missed.alias("missed"))
    band = F.when(F.col("percent") >= 70, "good").when(F.col("percent") >= 40, "fair").otherwise("weak")
    return out.withColumn("band", band)


def quality_score(answers: DataFrame, group: str, passed: Column, evaluated: Column) -> DataFrame:
    """Share of criteria met as 0..100; below 75 needs review; empty when it could not be evaluated."""
    out = answers.groupBy(group).agg(
        F.count_if(passed).alias("passed"), F.count(passed).alias("total"), F.bool_and(evaluated).alias("evaluated"))
    score = F.coalesce(F.bround(F.try_divide(F.col("passed").cast("double"), F.col("total")) * 100, 0), F.lit(0.0))
    score = F.when(F.col("evaluated"), score).cast("int")
    return out.select(
        group, F.when(F.col("evaluated"), F.col("passed")).alias("passed"),
        F.when(F.col("evaluated"), F.col("total")).alias("total"), score.alias("score"),
        F.coalesce(score < fixed.REVIEW_BELOW, F.lit(False)).alias("needs_review"))
