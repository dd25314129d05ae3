"""Registered grading and code-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.operators import grading, lint
from tidewell.operators.skew import spread_join
from tidewell.plans import duck, views
from tidewell.plans.registry import documents, query, table

# Code templates, good and bad; part k takes template k % n with its own key in the names.
SNIPPETS = [
    ("java", "public class Crate{n} {\n    private int load;\n    public int getLoad() { return load; }\n"
             "    public void unload() { try { crane.lift(); } catch (RuntimeException broken) { } }\n}\n"),
    ("java", "public class Gate{n} {\n    String apiKey = \"orchard-9-lantern\";\n    // an open ( in a comment\n"
             "    public void raise(int level) { if (level > 0) { move(level); }\n}\n"),
    ("java", "/* a lone ]\n   over two lines */\nrecord Span{n}(int from, int to) {\n    int width() { return (to - from]; }\n}\n"),
    ("spring", "@RestController\npublic class Dock{n} {\n    @Autowired\n    private Berths berths;\n"
               "    @PutMapping(\"/berths\")\n    public Berth book(@RequestBody Berth berth) {\n"
               "        System.out.println(berth);\n        return berths.findById(berth.number).get();\n    }\n}\n"),
    ("spring", "@Entity\npublic class Buoy{n} {\n    private long depth;\n}\n@CrossOrigin(\"*\")\npublic class Pier{n} {\n"
               "    void guard(Chain chain) { chain.csrf().disable(); chain.auth(all -> all.anyRequest().permitAll()); }\n}\n"),
    ("spring", "@Service\npublic class Pilot{n} {\n    private final Berths berths;\n    public Pilot{n}(Berths berths) { this.berths = berths; }\n"
               "    public Berth find(long number) { return berths.findById(number).orElseThrow(); }\n}\n"),
    ("spring", "@SpringBootApplication\npublic class Harbour{n} {\n    // TODO: light the lamps\n}\n@Controller\nclass Jetty{n} { }\n"),
    ("python", "import csv, math\nfrom pathlib import Path\n\ndef tide{n}(table, seen={}):\n    try:\n        return eval(table)\n"
               "    except:\n        pass\n    if table != None:\n        return open(table)\n"),
    ("python", "import requests\n\ndef forecast{n}(port):\n    # TODO: cache it\n    secret = 'harbour-lights-77'\n"
               "    for hour in range(6):\n        requests.post(port)\n    with open('log{n}') as log:\n        return log.read()\n"),
    ("python", "class Anchor{n}:\n    def drop(self, rope=None):\n        while rope is not None:\n            rope = self.pay(rope, 'exec(2)')\n"
               "        return requests.put('port', timeout=9)\n"),
    ("datascience", "from numpy import *\nimputer = SimpleImputer()\nW{n} = imputer.fit_transform(W)\n"
                    "left, right = train_test_split(W{n})\nwaves.dropna(inplace=True)\nwaves['height'][0] = 4\n"
                    "print(accuracy_score(left, right))\n"),
    ("datascience", "import polars as pl\naxes.bar(ports, calls)\naxes.set_ylim(35, 50)\nfor k, row in df{n}.iterrows():\n"
                    "    df_all = df_all.append(row)\ndf_all = df_all.append(row)\n"),
    ("datascience", "left, right = train_test_split(W{n}, random_state=6)\nencoder.fit(left)\naxes.plot(left)\naxes.set_ylim(2, 4)\n"
                    "print(accuracy_score(left, right), recall_score(left, right))\n"),
]

_LIST = "[" + ", ".join(f"{{'language': {duck.lit(lang)}, 'code': {duck.lit(code)}}}" for lang, code in SNIPPETS) + "]"
SNIPPET = f"""
    select p_partkey as snippet_id, t.language as language, replace(t.code, '{{n}}', cast(p_partkey as varchar)) as code
    from (select p_partkey, {_LIST}[p_partkey % {len(SNIPPETS)} + 1] as t from part)"""


def snippets(spark, sf):
    made = F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(code).alias("code")) for lang, code in SNIPPETS])
    at = F.get(made, (F.col("p_partkey") % len(SNIPPETS)).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("snippet_id"), at["language"].alias("language"),
        F.replace(at["code"], F.lit("{n}"), F.col("p_partkey").cast("string")).alias("code"))


def _strip(c: str, pattern: str) -> str:
    p = duck.lit(pattern)
    gap = "case when z[2] is null then '' when contains(z[2], chr(10)) then regexp_replace(z[2], '[^\\n]+', '', 'g') else ' ' end"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({c}, {p}), regexp_extract_all({c}, {p})), "
            f"lambda z: z[1] || {gap}), '')")


_CODE = f"""
    code as materialized (select *, case when language in ('java', 'spring') then {_strip('code', fixed.CODE_TEXT)}
                     else {_strip('code', lint.PYTHON_TEXT)} end as logic from ({SNIPPET})),
    lines as materialized (select snippet_id, language, logic, unnest(string_split(logic, chr(10))) as l,
                     cast(generate_subscripts(string_split(logic, chr(10)), 1) as integer) as line from code),
    marks as (select snippet_id, line, unnest(regexp_extract_all(l, '[()\\[\\]{{}}]')) as ch,
                     generate_subscripts(regexp_extract_all(l, '[()\\[\\]{{}}]'), 1) as place from lines),
    stacks as (select snippet_id, list_reduce(list_prepend({{'s': []::struct(ch varchar, line integer)[], 'p': null::varchar, 'ch': '', 'line': 0}},
                list({{'s': []::struct(ch varchar, line integer)[], 'p': null::varchar, 'ch': ch, 'line': line}} order by line, place)),
                lambda a, b: case when a.p is not null then a
                    when b.ch in ('(', '[', '{{') then {{'s': list_append(a.s, {{'ch': b.ch, 'line': b.line}}), 'p': null, 'ch': '', 'line': 0}}
                    when len(a.s) > 0 and a.s[-1].ch = translate(b.ch, ')]}}', '([{{') then {{'s': a.s[1:-2], 'p': null, 'ch': '', 'line': 0}}
                    else {{'s': a.s, 'p': 'Unmatched ''' || b.ch || ''' on line ' || b.line || '.', 'ch': '', 'line': 0}} end) as st
               from marks group by 1),
    balance as (select code.snippet_id, code.language, coalesce(st.p, case when len(st.s) > 0 then '''' || st.s[-1].ch || ''' opened on line ' || st.s[-1].line
               || ' is never closed.' end) as problem from code left join stacks using (snippet_id))"""


def _code_rules(rules, languages) -> list[str]:
    out = []
    for r in rules:
        body = "code" if r.raw else "logic"
        test = " and ".join([duck.has(body, p) for p in r.has] + [f"not {duck.has(body, p)}" for p in r.lacks])
        out.append(f"select snippet_id, '{r.rule}' as rule, '{r.severity}' as severity, cast(null as integer) as line, "
                   f"{duck.lit(r.message)} as message from code where language in {duck.words(languages)} and {test}")
    return out


def _line_rules(rules, languages) -> list[str]:
    out = []
    for r in rules:
        group = f"regexp_extract(l, {duck.lit(r.find)}, 1)" if "{0}" in r.message else "''"
        test = duck.has("l", r.find) + (f" and not {duck.has('l', r.unless)}" if r.unless else "")
        out.append(f"select snippet_id, '{r.rule}' as rule, '{r.severity}' as severity, line, "
                   f"replace(replace({duck.lit(r.message)}, '{{line}}', cast(line as varchar)), '{{0}}', {group}) as message "
                   f"from lines where language in {duck.words(languages)} and {test}")
    return out


_BRACKETS = ("select snippet_id, 'brackets' as rule, 'error' as severity, cast(null as integer) as line, "
             "'Brackets don''t balance: ' || problem as message from balance where problem is not null and language in {}")
_SWALLOWED = (f"select a.snippet_id, 'swallowed', 'warning', a.line, replace({duck.lit(lint.SWALLOWED)}, '{{line}}', cast(a.line as varchar)) "
              "from lines a left join lines b on a.snippet_id = b.snippet_id and b.line = a.line + 1 "
              "left join lines c on a.snippet_id = c.snippet_id and c.line = a.line + 2 "
              "where a.language in ('python', 'datascience') and (regexp_matches(a.l, '^\\s*except\\b[^:]*:\\s*pass\\s*$') or "
              "(regexp_matches(a.l, '^\\s*except\\b[^:]*:\\s*$') and regexp_matches(b.l, '^\\s*pass\\s*$') and (c.l is null or trim(c.l) = '' "
              "or length(regexp_extract(c.l, '^(\\s*)', 1)) < length(regexp_extract(b.l, '^(\\s*)', 1)))))")
_AXIS = (f"select snippet_id, 'bar-axis', 'warning', line, replace(replace({duck.lit(lint.AXIS_MESSAGE)}, '{{line}}', cast(line as varchar)), '{{0}}', "
         f"regexp_extract(l, {duck.lit(lint.AXIS)}, 1)) from lines where language = 'datascience' and {duck.has('logic', lint.BAR)} "
         f"and try_cast(regexp_extract(l, {duck.lit(lint.AXIS)}, 1) as double) > 0")
_LEAKS = (f"select a.snippet_id, 'leakage' as rule, 'warning' as severity, a.line, replace(replace(replace({duck.lit(lint.LEAK_MESSAGE)}, '{{line}}', cast(a.line as varchar)), "
          f"'{{0}}', lower(regexp_extract(l, {duck.lit(lint.FIT_CALL)}, 1))), '{{1}}', regexp_extract(l, {duck.lit(lint.FIT_CALL)}, 2)) as message "
          f"from lines a join (select snippet_id, min(line) as first from lines where {duck.has('l', lint.SPLIT_CALL)} group by 1) s "
          f"on a.snippet_id = s.snippet_id and a.line < s.first where a.language = 'datascience' and {duck.has('l', lint.FIT_CALL)}")


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


_JAVA = _union([_BRACKETS.format("('java')"), *_code_rules(lint.JAVA_RULES, ["java"])])
_SPRING = _union([_BRACKETS.format("('spring')"), *_code_rules(lint.JAVA_RULES + lint.SPRING_RULES, ["spring"])])
_PY = ["python", "datascience"]
_PYTHON = _union([*_line_rules(lint.PYTHON_LINE_RULES, _PY), _SWALLOWED, *_code_rules(lint.PYTHON_RULES, _PY)])
_DATA = "select distinct * from (" + _union([
    *_line_rules(lint.DATA_LINE_RULES, ["datascience"]), _AXIS, _LEAKS, *_code_rules(lint.DATA_RULES, ["datascience"])]) + ")"


@query("bracket_balance", f"with {_CODE} select snippet_id, problem from balance where language in ('java', 'spring')")
def bracket_balance(spark, sf):
    return lint.bracket_balance(snippets(spark, sf).where("language in ('java', 'spring')"))


@query("lint_java", f"with {_CODE} {_JAVA}")
def lint_java(spark, sf):
    return lint.lint_java(snippets(spark, sf).where("language = 'java'"))


@query("lint_spring", f"with {_CODE} {_SPRING}")
def lint_spring(spark, sf):
    return lint.lint_java(snippets(spark, sf).where("language = 'spring'"), spring=True)


@query("lint_python_lines", f"with {_CODE} {_PYTHON}")
def lint_python_lines(spark, sf):
    return lint.lint_python(snippets(spark, sf).where("language in ('python', 'datascience')"))


# Snippets over several lines and what they must give: (code, [(rule, line)])
SPANS = [
    ("import requests\nreply = requests.get(\n    address,\n    timeout=10,\n)\n", []),
    ("reply = requests.post(\n    address,\n    json=build(timeout=3),\n)\n", [("no-timeout", 1)]),
    ("def keep(\n    item,\n    basket=[],\n    *,\n    seen={},\n):\n    return basket\n", [("mutable-default", 3), ("mutable-default", 5)]),
    ("with (\n    open(a) as f,\n    open(b) as g,\n):\n    f.read()\nh = open(\n    c)\n", [("open", 6)]),
    ("try:\n    go()\nexcept OSError:\n    pass\n\n    pass\nexcept KeyError:\n    pass\n    log()\n", [("swallowed", 3)]),
    ("size = max(\n    eval(a),\n    exec(b) if x == None else 0)\n", [("eval", 2), ("eval", 3), ("none-compare", 3)]),
    ("def tidy(a, b=(1, 2), c=None):\n    return [x for x in a if x is not None], {'open(': 'eval('}\n", []),
]
_SPANS = ", ".join(f"({i}, {duck.lit(rule)}, {line})" for i, (_, found) in enumerate(SPANS) for rule, line in found)


@query("lint_python_spans", f"""
    select p_partkey as snippet_id, rule, line::integer as line from part join (values {_SPANS}) e(kind, rule, line) on p_partkey % {len(SPANS)} = kind""")
def lint_python_spans(spark, sf):
    """Calls, function heads and blocks over several lines."""
    code = F.element_at(F.array(*[F.lit(c) for c, _ in SPANS]), (F.col("p_partkey") % len(SPANS) + 1).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("snippet_id"), F.lit("python").alias("language"), code.alias("code"))
    return lint.lint_python_spans(rows).select("snippet_id", "rule", "line")


@query("lint_datascience", f"with {_CODE} {_DATA}")
def lint_datascience(spark, sf):
    return lint.lint_data_science(snippets(spark, sf).where("language = 'datascience'"))


@query("lint_leakage", f"with {_CODE} {_LEAKS}")
def lint_leakage(spark, sf):
    return lint.lint_leakage(snippets(spark, sf).where("language = 'datascience'"))


@query("lint_summary", f"""with {_CODE}, found as ({_JAVA} union all {_SPRING} union all {_PYTHON} union all {_DATA})
    select rule, count(*) filter (severity = 'error') as error, count(*) filter (severity = 'warning') as warning,
           count(*) filter (severity = 'tip') as tip from found group by 1""")
def lint_summary(spark, sf):
    return lint.lint_summary(lint.lint_code(snippets(spark, sf)))


_N = "cast(len(regexp_extract_all(logic, {})) as integer)"


def _names(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(logic, {duck.lit(pattern)}, {group})"


_IS_JAVA = "language in ('java', 'spring')"


@query("code_structure", f"""with {_CODE}
    select snippet_id, language,
        case when {_IS_JAVA} then '' else array_to_string(list_sort(list_distinct(list_concat(list_transform(flatten(list_transform(
            {_names('(?m)^' + chr(92) + 's*import' + chr(92) + 's+([^' + chr(92) + 'n;]+)$')}, lambda s: string_split(s, ','))), lambda s: regexp_extract(s, '^\\s*(\\w+)', 1)),
            {_names('(?m)^' + chr(92) + 's*from' + chr(92) + 's+([' + chr(92) + 'w.]+)' + chr(92) + 's+import' + chr(92) + 'b')}))), ',') end as imports,
        case when {_IS_JAVA} then 0 else {_N.format(duck.lit('(?m)^[ ' + chr(92) + 't]*(?:async' + chr(92) + 's+)?def' + chr(92) + 's+' + chr(92) + 'w+'))} end as functions,
        case when {_IS_JAVA} then {_N.format(duck.lit(chr(92) + 'b(?:class|interface|record|enum)' + chr(92) + 's+' + chr(92) + 'w+'))}
             else {_N.format(duck.lit('(?m)^[ ' + chr(92) + 't]*class' + chr(92) + 's+' + chr(92) + 'w+'))} end as classes,
        case when {_IS_JAVA} then 0 else {_N.format(duck.lit('(?m)^[ ' + chr(92) + 't]*(?:async' + chr(92) + 's+for|for|while)' + chr(92) + 'b'))} end as loops,
        case when {_IS_JAVA} then 0 else {_N.format(duck.lit('(?m)^[ ' + chr(92) + 't]*(?:if|elif)' + chr(92) + 'b'))} end as branches,
        case when {_IS_JAVA} then array_to_string(list_sort(list_distinct(list_filter({_names('@(' + chr(92) + 'w+)')}, lambda a: a <> 'Override'))), ',') else '' end as annotations,
        case when {_IS_JAVA} then array_to_string({_names('(?:public|private|protected)' + chr(92) + 's+(?:static' + chr(92) + 's+)?[' + chr(92) + 'w<>' + chr(92) + '[' + chr(92) + '], ?]+' + chr(92) + 's+(' + chr(92) + 'w+)' + chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')')}, ',') else '' end as methods
    from code""")
def code_structure(spark, sf):
    return lint.code_structure(snippets(spark, sf))


@query("code_todos", rf"""
    select snippet_id, trim(regexp_replace(trim(l), '^\W*TODO:?\s*', '')) as todo
    from (select snippet_id, unnest(string_split(code, chr(10))) as l from ({SNIPPET})) where contains(l, 'TODO')""")
def code_todos(spark, sf):
    return lint.code_todos(snippets(spark, sf))


# Rules of two exercises: a Java holder class and a Spring service.
RUBRICS = [
    ("java", "private-field", r"private\s+\w+\s+\w+\s*;", True, "Make the field private."),
    ("java", "getter", r"\bget[A-Z]\w*\s*\(\s*\)", True, "Add a getter."),
    ("java", "no-empty-catch", r"catch\s*\([^)]*\)\s*\{\s*\}", False, "Handle the exception."),
    ("spring", "service", r"@Service|@RestController", True, "Annotate the class."),
    ("spring", "final-field", r"private\s+final\s+\w+\s+\w+", True, "Use a private final field."),
    ("spring", "no-field-injection", r"@Autowired\s+(private|protected|public)", False, "Inject through the constructor."),
    ("spring", "or-else-throw", r"\.orElseThrow\s*\(", True, "Use orElseThrow."),
]


def _judged() -> str:
    parts = []
    for rubric, rule, pattern, must, fix in RUBRICS:
        test = duck.has("logic", pattern) if must else f"not {duck.has('logic', pattern)}"
        parts.append(f"select snippet_id, language as rubric, '{rule}' as rule, {test} as ok, {duck.lit(fix)} as fix from code where language = '{rubric}'")
    return _union(parts)


def _rubric_submissions(spark, sf):
    return snippets(spark, sf).where("language in ('java', 'spring')").withColumn("rubric", F.col("language"))


@query("grade_rubric", f"""with {_CODE}, judged as ({_judged()})
    select snippet_id, rubric, cast(count_if(ok) as integer) as ok, cast(count(*) as integer) as total,
           round_even(count_if(ok)::double / count(*)::double, 2) as score, bool_and(ok) as passed,
           coalesce(string_agg(fix, ' ' order by rule) filter (not ok), '') as advice from judged group by 1, 2""")
def grade_rubric(spark, sf):
    return grading.grade_rubric(_rubric_submissions(spark, sf), grading.rubric_table(spark, RUBRICS))


@query("rubric_notes", f"with {_CODE} select snippet_id, rule, severity from ({_JAVA} union all {_SPRING}) where severity in ('error', 'warning')")
def rubric_notes(spark, sf):
    return grading.rubric_notes(_rubric_submissions(spark, sf))


_POINTS = "case difficulty when 'easy' then 10 when 'medium' then 20 else 30 end"
_LESSON = "case track when 'python' then 'python-1' when 'datascience' then 'ds-3' when 'java' then 'java-1' else 'spring-3' end"
_PUBLIC = f"""
    select challenge_id, track, kind, difficulty, title, prompt, cast({_POINTS} as integer) as points, hints as hint_count,
           {_LESSON} as review_lesson, case when kind = 'code' then 'browser' else 'server' end as graded,
           case when kind = 'rubric' then rubric end as check_count from ({views.CHALLENGE})"""


@query("challenge_public", _PUBLIC)
def challenge_public(spark, sf):
    return grading.public_view(views.challenge(spark, sf))


_ANSWER = ["case when l_linenumber % 3 = 0 then null else cast(l_orderkey % 6 as integer) end as choice",
           "case when l_orderkey % 4 = 0 then '  ' else 'x = 1' end as code"]


@query("validate_answers", f"""
    select submission_id, case when kind = 'code' then '{fixed.ANSWER_BROWSER}'
        when kind = 'mcq' and (choice is null or choice >= 4) then '{fixed.ANSWER_OPTION}'
        when kind = 'rubric' and {duck.trim('code')} = '' then '{fixed.ANSWER_BLANK}' end as rejected
    from (select l_orderkey * 10 + l_linenumber as submission_id, l_partkey as challenge_id, {', '.join(_ANSWER)} from lineitem)
    join (select challenge_id, kind from ({views.CHALLENGE})) using (challenge_id)""")
def validate_answers(spark, sf):
    """Answers with a choice out of range, blank code, or for the browser; every question has four options."""
    answers = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as submission_id", "l_partkey as challenge_id", *_ANSWER)
    known = views.challenge(spark, sf).select("challenge_id", "kind")
    why = grading.rejected_answer(F.col("kind"), F.lit(4), F.col("choice"), F.col("code"))
    return answers.join(known, "challenge_id").select("submission_id", why.alias("rejected"))


@query("challenge_list", f"select * from ({_PUBLIC}) where track = 'java'")
def challenge_list(spark, sf):
    return grading.challenge_list(views.challenge(spark, sf), "java")


@query("challenge_solution", f"select challenge_id, explanation, solution, answer as correct_index from ({views.CHALLENGE})")
def challenge_solution(spark, sf):
    return views.challenge(spark, sf).select("challenge_id", "explanation", "solution", F.col("answer").alias("correct_index"))


_ASK = "select l_orderkey * 10 + l_linenumber as request_id, l_partkey as lesson_id, case l_linenumber % 4 when 0 then 'python' when 1 then 'datascience' when 2 then 'java' else 'spring' end as language from lineitem"


@query("lesson_lookup", f"""
    select request_id, lesson_id, title from ({_ASK}) r left join ({views.CHALLENGE}) c
    on c.challenge_id = r.lesson_id and c.track = r.language""")
def lesson_lookup(spark, sf):
    """A lesson shows only under its own language."""
    asked = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as request_id", "l_partkey as lesson_id",
        "case l_linenumber % 4 when 0 then 'python' when 1 then 'datascience' when 2 then 'java' else 'spring' end as language")
    lessons = views.challenge(spark, sf).select(F.col("challenge_id").alias("lesson_id"), "track", F.col("title").alias("any_title"))
    found = spread_join(asked, lessons, "lesson_id")
    return found.select("request_id", "lesson_id", F.when(F.col("track") == F.col("language"), F.col("any_title")).alias("title"))


@query("grade_mcq", f"""
    select submission_id, choice = answer as passed, answer as correct_index, explanation,
           cast(case when choice = answer then {_POINTS} else 0 end as integer) as points
    from ({views.SUBMISSION}) join ({views.CHALLENGE}) using (challenge_id)""")
def grade_mcq(spark, sf):
    return grading.grade_mcq(views.submission(spark, sf), views.challenge(spark, sf))


_FRACTION = "case when challenge_id % 10 = 0 then 0.0::double else least(checks_passed, checks)::double / checks end"
_ATTEMPTS = f"""
    select submission_id, learner, difficulty, cast({_POINTS} as integer) as full_points, {_FRACTION} as fraction,
           cast(case when revealed then 0 else greatest(0, floor({_POINTS} * ({_FRACTION}) * greatest(0.0, 1 - 0.25::double * hints_used) + 0.5)) end as integer) as points
    from ({views.SUBMISSION}) join ({views.CHALLENGE}) using (challenge_id)"""


def _attempts(spark, sf):
    keys = views.challenge(spark, sf).select("challenge_id", "difficulty")
    both = spread_join(views.submission(spark, sf), keys, "challenge_id").where(F.col("difficulty").isNotNull())
    # every tenth challenge was handed in as the unchanged starter
    starter = F.lit("def solve():\n    pass\n")
    code = F.when(F.col("challenge_id") % 10 == 0, F.concat(starter, F.lit("\n"))).otherwise("def solve():\n    return 1\n")
    fraction = grading.partial_credit(F.least("checks_passed", "checks"), F.col("checks"), code, starter)
    full = grading.points(F.col("difficulty"))
    return both.select(
        "submission_id", "learner", "difficulty", full.alias("full_points"), fraction.alias("fraction"),
        grading.attempt_score(full, fraction, F.col("hints_used"), F.col("revealed")).alias("points"))


@query("partial_credit", f"select submission_id, round(fraction, 6) as fraction from ({_ATTEMPTS})")
def partial_credit(spark, sf):
    return _attempts(spark, sf).select("submission_id", F.round("fraction", 6).alias("fraction"))


@query("score_attempts", f"select submission_id, full_points, points from ({_ATTEMPTS})")
def score_attempts(spark, sf):
    return _attempts(spark, sf).select("submission_id", "full_points", "points")


@query("interview_summary", f"""
    with a as ({_ATTEMPTS}),
         s as (select learner, sum(points)::bigint as earned, sum(full_points)::bigint as full_points, cast(floor(sum(points)::double / sum(full_points)::double * 100 + 0.5) as integer) as percent,
                      coalesce(string_agg(distinct difficulty, ',' order by difficulty) filter (fraction < 1), '') as missed from a group by 1)
    select *, case when percent >= 70 then 'good' when percent >= 40 then 'fair' else 'weak' end as band from s""")
def interview_summary(spark, sf):
    return grading.interview_summary(_attempts(spark, sf).withColumn("passed", F.col("fraction") >= 1), "learner")


@query("quality_score", """
    with g as (select source, count_if(quality = 1)::bigint as passed, count(quality) as total, source <> 'src0' as evaluated
               from documents left join labels using (doc_id) group by 1, 4),
         s as (select *, case when evaluated then cast(coalesce(round_even(passed::double / nullif(total, 0) * 100, 0), 0) as integer) end as score from g)
    select source, case when evaluated then passed end as passed, case when evaluated then total end as total, score,
           coalesce(score < 75, false) as needs_review from s""")
def quality_score(spark, sf):
    """Labels as criteria per source; one source stands for answers that could not be evaluated."""
    docs = documents(spark, sf).select("doc_id", "source")
    both = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return grading.quality_score(both, "source", F.col("quality") == 1, F.col("source") != "src0")
