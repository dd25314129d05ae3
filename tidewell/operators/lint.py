"""Checks over a table of code text: rules are data, every rule is an expression, findings stay in the row.

No rule shuffles code: a snippet's findings are built as an array and only exploded at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text

FINDING = "array<struct<rule:string,severity:string,line:int,message:string>>"


@dataclass(frozen=True)
class CodeRule:
    """Fires once per snippet when all ``has`` patterns occur and no ``lacks`` pattern does."""

    rule: str
    severity: str
    message: str
    has: tuple[str, ...]
    lacks: tuple[str, ...] = ()
    raw: bool = False  # look at the text with its strings and comments


@dataclass(frozen=True)
class LineRule:
    """Fires on every line that matches ``find`` and not ``unless``; {0} is the first group, {line} the line number."""

    rule: str
    severity: str
    message: str
    find: str
    unless: str | None = None


# --- fixed values: Java and Spring rules ---------------------------------------

JAVA_RULES = [
    CodeRule("empty-catch", "warning", "Empty catch block swallows the error. Log it, handle it, or rethrow it.",
             (r"catch\s*\([^)]*\)\s*\{\s*\}",)),
    CodeRule("credential", "warning",
             "A credential looks hard-coded. Move it to an environment variable or secrets manager and rotate it.",
             (fixed.CREDENTIAL_JAVA,), raw=True),
]
SPRING_RULES = [
    CodeRule("field-injection", "tip",
             "Field injection with @Autowired is hard to test. Prefer constructor injection with a final field.",
             (r"@Autowired\s+(?:private|protected|public)?\s*[\w<>,\s]+\s+\w+\s*;",)),
    CodeRule("boot-without-run", "warning",
             "@SpringBootApplication is present but nothing calls SpringApplication.run(...).",
             ("@SpringBootApplication",), (r"SpringApplication\.run",)),
    CodeRule("run-without-boot", "warning",
             "SpringApplication.run(...) needs a class annotated with @SpringBootApplication.",
             (r"SpringApplication\.run",), ("@SpringBootApplication",)),
    CodeRule("no-mapping", "tip", "This controller has no *Mapping annotations, so it exposes no endpoints yet.",
             (r"@(?:Rest)?Controller\b",), (r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping",)),
    CodeRule("unvalidated-body", "tip",
             "@RequestBody input isn't validated. Add @Valid and constraint annotations such as @NotBlank or @Email.",
             (r"@RequestBody\b",), ("@Valid",)),
    CodeRule("entity-without-id", "error", "An @Entity needs an @Id field.", ("@Entity",), ("@Id",)),
    CodeRule("csrf-off", "warning",
             "CSRF protection is disabled. That's only safe for stateless token-based APIs. "
             "Make sure that's what you intend.",
             (r"csrf\s*\(\s*\w+\s*->\s*\w+\.disable\(\)\s*\)|csrf\(\)\.disable\(\)",)),
    CodeRule("permit-all", "warning",
             "anyRequest().permitAll() leaves every endpoint public. "
             "Require authentication by default and open specific paths.",
             (r"anyRequest\(\)\s*\.\s*permitAll\(\)",)),
    CodeRule("open-cors", "warning",
             "@CrossOrigin allows every origin. Restrict it to the front-end origins you trust.",
             (r'@CrossOrigin\s*(?:\(\s*(?:origins\s*=\s*)?"\*"\s*\))?\s*(?:\n|public|class)',), raw=True),
    CodeRule("println", "tip", "Use an SLF4J logger instead of System.out.println in Spring code.",
             (r"System\.out\.println",)),
    CodeRule("optional-get", "tip",
             "findById(...).get() throws an unclear NoSuchElementException. "
             "Use orElseThrow(...) with a meaningful exception.",
             (r"\.get\(\)\s*;", "findById")),
]

# --- fixed values: Python and data-science rules ---------------------------------

PYTHON_LINE_RULES = [
    LineRule("bare-except", "warning",
             "Bare 'except:' on line {line} also catches KeyboardInterrupt. Catch a specific exception.",
             r"^\s*except\s*:"),
    LineRule("mutable-default", "warning",
             "'{0}' uses a mutable default argument. It is shared between calls. Use None and create it inside.",
             r"^\s*(?:async\s+)?def\s+(\w+)\s*\([^)]*=\s*[\[{]"),
    LineRule("eval", "warning", "{0}() on line {line} runs arbitrary code. Avoid it, especially with user input.",
             r"\b(eval|exec)\s*\("),
    LineRule("open", "tip",
             "open() on line {line} isn't in a 'with' block, so the file may stay open. Use 'with open(...) as f:'.",
             r"\bopen\s*\(", r"^\s*(?:async\s+)?with\b"),
    LineRule("no-timeout", "warning",
             "requests.{0}() on line {line} has no timeout, so it can hang forever. Pass timeout=10.",
             r"\brequests\.(get|post|put|delete|request)\s*\(", r"\btimeout\s*="),
    LineRule("none-compare", "tip", "Use 'is None' / 'is not None' instead of == None on line {line}.",
             r"[!=]=\s*None\b"),
]
PYTHON_RULES = [
    CodeRule("credential", "warning",
             "A credential looks hard-coded. Move it to an environment variable and rotate it.",
             (fixed.CREDENTIAL_ANY,), raw=True),
]
SWALLOWED = "The except block on line {line} swallows the error silently. Log it or handle it."
DATA_LINE_RULES = [
    LineRule("inplace", "tip",
             "inplace=True on line {line} rarely saves memory and is being phased out. "
             "Assign the result instead: df = df.fillna(...).",
             r"\binplace\s*=\s*True\b"),
    LineRule("no-seed", "tip",
             "train_test_split on line {line} has no random_state, so results change every run. "
             "Set random_state=42 to make it reproducible.",
             r"\btrain_test_split\s*\(", r"\brandom_state\s*="),
    LineRule("iterrows", "tip",
             "iterrows() on line {line} is slow. Prefer vectorised column operations, or groupby/merge.",
             r"\biterrows\s*\("),
    LineRule("frame-append", "warning", "DataFrame.append on line {line} was removed in pandas 2.0. Use pd.concat([...]).",
             r"(?i)\bdf\w*\.append\s*\("),
    LineRule("chained", "warning",
             "Chained assignment on line {line} may modify a copy and silently do nothing. "
             "Use df.loc[mask, 'column'] = value.",
             r"^\s*[\w.]+\[[^\]]*\]\[[^\]]*\]\s*=(?:[^=]|$)"),
    LineRule("star-import", "tip",
             "'from {0} import *' on line {line} hides where names come from. Import only what you use.",
             r"^\s*from\s+([\w.]+)\s+import\s+\*"),
]
AXIS = r"\b(?:set_)?ylim\s*\(\s*([0-9]*\.?[0-9]+)"
AXIS_MESSAGE = "The y-axis on line {line} starts at {0}, not 0. On a bar chart that exaggerates small differences."
BAR = r"\bbarh?\s*\("
DATA_RULES = [
    CodeRule("accuracy-only", "tip",
             "Accuracy alone can look great on imbalanced data. Also check precision, recall or F1, "
             "and compare against a do-nothing baseline.",
             (r"\baccuracy_score\b",),
             (r"\b(?:precision_score|recall_score|f1_score|roc_auc_score|classification_report|confusion_matrix|"
              r"average_precision_score)\b",)),
]
SPLIT_CALL = r"\btrain_test_split\s*\("
FIT_CALL = r"(?i)\b(\w*(?:scal|impute|encod|pca|vectori|normal|transform)\w*)\.(fit_transform|fit)\s*\("
LEAK_MESSAGE = (
    "Data leakage: '{0}.{1}' on line {line} learns from ALL rows before train_test_split. "
    "Split first, fit on the training set only, then transform the test set."
)
PYTHON_TEXT = r"(?s)\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*"


# --- building findings ------------------------------------------------------------


def _finding(rule: str, severity: str, line: Column, message: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), line.cast("int").alias("line"),
                    message.alias("message"))


def _code_rule(r: CodeRule, code: Column, logic: Column) -> Column:
    body = code if r.raw else logic
    fires = reduce(lambda a, p: a & body.rlike(p), r.has, F.lit(True))
    fires = reduce(lambda a, p: a & ~body.rlike(p), r.lacks, fires)
    found = F.array(_finding(r.rule, r.severity, F.lit(None), F.lit(r.message)))
    return F.when(fires, found).otherwise(F.array().cast(FINDING))


def _worded(message: str, line: Column, *groups: Column) -> Column:
    out = F.replace(F.lit(message), F.lit("{line}"), line.cast("string"))
    for i, g in enumerate(groups):
        out = F.replace(out, F.lit("{%d}" % i), g)
    return out


def _line_rule(r: LineRule, lines: Column) -> Column:
    def at(line: Column, i: Column) -> Column:
        fires = line.rlike(r.find) & (~line.rlike(r.unless) if r.unless else F.lit(True))
        group = (F.regexp_extract(line, r.find, 1),) if "{0}" in r.message else ()
        return F.when(fires, _finding(r.rule, r.severity, i + 1, _worded(r.message, i + 1, *group)))

    return F.filter(F.transform(lines, at), lambda f: f.isNotNull())


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def _swallowed(lines: Column) -> Column:
    """An except block whose whole body is ``pass``."""

    def at(line: Column, i: Column) -> Column:
        after, later = F.get(lines, i + 1), F.get(lines, i + 2)
        only = F.coalesce(F.trim(later) == "", F.lit(True)) | (_indent(later) < _indent(after))
        block = line.rlike(r"^\s*except\b[^:]*:\s*$") & after.rlike(r"^\s*pass\s*$") & only
        fires = F.coalesce(block, F.lit(False)) | line.rlike(r"^\s*except\b[^:]*:\s*pass\s*$")
        return F.when(fires, _finding("swallowed", "warning", i + 1, _worded(SWALLOWED, i + 1)))

    return F.filter(F.transform(lines, at), lambda f: f.isNotNull())


def _axis(lines: Column, logic: Column) -> Column:
    def at(line: Column, i: Column) -> Column:
        start = F.regexp_extract(line, AXIS, 1)
        fires = (start.try_cast("double") > 0) & logic.rlike(BAR)
        return F.when(fires, _finding("bar-axis", "warning", i + 1, _worded(AXIS_MESSAGE, i + 1, start)))

    return F.filter(F.transform(lines, at), lambda f: f.isNotNull())


def _leaks(lines: Column, first_split: Column) -> Column:
    def at(line: Column, i: Column) -> Column:
        name, call = F.lower(F.regexp_extract(line, FIT_CALL, 1)), F.regexp_extract(line, FIT_CALL, 2)
        message = _worded(LEAK_MESSAGE, i + 1, name, call)
        return F.when(line.rlike(FIT_CALL) & (i < first_split), _finding("leakage", "warning", i + 1, message))

    return F.filter(F.transform(lines, at), lambda f: f.isNotNull())


def balance_problem(logic: Column) -> Column:
    """First bracket that does not match, as a message, or null.  ``logic``: code without strings and comments."""
    lines = F.split(logic, "\n", -1)
    marks = F.flatten(F.transform(lines, lambda line, i: F.transform(
        F.regexp_extract_all(line, F.lit(r"[()\[\]{}]"), F.lit(0)),
        lambda ch: F.struct(ch.alias("ch"), (i + 1).alias("line")))))
    nothing = F.array().cast("array<struct<ch:string,line:int>>")
    start = F.struct(nothing.alias("open"), F.lit(None).cast("string").alias("problem"))

    def read(state: Column, m: Column) -> Column:
        opened, ch = state["open"], m["ch"]
        want = F.translate(ch, ")]}", "([{")
        top = F.get(opened, F.size(opened) - 1)
        fits = F.coalesce(top["ch"] == want, F.lit(False))
        bad = F.concat(F.lit("Unmatched '"), ch, F.lit("' on line "), m["line"].cast("string"), F.lit("."))
        return (
            F.when(state["problem"].isNotNull(), state)
            .when(ch.isin("(", "[", "{"), F.struct(F.array_append(opened, m).alias("open"), state["problem"].alias("problem")))
            .when(fits, F.struct(F.slice(opened, F.lit(1), F.size(opened) - 1).alias("open"),
                                 state["problem"].alias("problem")))
            .otherwise(F.struct(opened.alias("open"), bad.alias("problem")))
        )

    def end(state: Column) -> Column:
        top = F.get(state["open"], F.size(state["open"]) - 1)
        left = F.concat(F.lit("'"), top["ch"], F.lit("' opened on line "), top["line"].cast("string"),
                        F.lit(" is never closed."))
        return F.coalesce(state["problem"], left)

    return F.aggregate(marks, start, read, end)


def _balance(logic: Column) -> Column:
    return F.filter(F.array(balance_problem(logic)), lambda p: p.isNotNull())


def strip_python(c: Column) -> Column:
    return text.strip_literals(c, PYTHON_TEXT)


def _with_logic(snippets: DataFrame) -> DataFrame:
    java = F.col("language").isin("java", "spring")
    logic = F.when(java, text.strip_code(F.col("code"))).otherwise(strip_python(F.col("code")))
    out = snippets.select("snippet_id", "language", "code", logic.alias("logic"))
    out = out.select("*", F.split("logic", "\n", -1).alias("lines"))
    first_split = F.array_min(F.transform("lines", lambda line, i: F.when(line.rlike(SPLIT_CALL), i)))
    return out.select("*", first_split.alias("first_split"))


def _explode(df: DataFrame, found: Column) -> DataFrame:
    return df.select("snippet_id", F.explode(found).alias("f")).select("snippet_id", "f.*")


def lint_java(snippets: DataFrame, spring: bool = False) -> DataFrame:
    """Findings of Java snippets; ``spring`` adds the framework rules."""
    df = _with_logic(snippets)
    rules = JAVA_RULES + (SPRING_RULES if spring else [])
    unbalanced = F.transform(_balance(F.col("logic")), lambda p: _finding(
        "brackets", "error", F.lit(None), F.concat(F.lit("Brackets don't balance: "), p)))
    found = F.concat(unbalanced, *[_code_rule(r, F.col("code"), F.col("logic")) for r in rules])
    return _explode(df, found)


def lint_python(snippets: DataFrame) -> DataFrame:
    df = _with_logic(snippets)
    parts = [_line_rule(r, F.col("lines")) for r in PYTHON_LINE_RULES] + [_swallowed(F.col("lines"))]
    parts += [_code_rule(r, F.col("code"), F.col("logic")) for r in PYTHON_RULES]
    return _explode(df, F.concat(*parts))


# What matters to the rules over spans, in order of preference: line break, head of a function, ``with`` at the start of a statement,
# call, timeout, a list, set or dict as a default, other brackets.
SPAN_TOKEN = (
    r"\n|\bdef\s+\w+\s*\(|\bwith\b|[A-Za-z_][\w.]*\s*\(|\btimeout\s*=(?!=)|(?<![=!<>])=\s*[\[{]|[()\[\]{}]")
SPAN_STATE = (
    "struct<open:array<struct<kind:string,name:string,line:int,timed:boolean>>,line:int,item:boolean,"
    "found:array<struct<rule:string,severity:string,line:int,message:string>>>")


def _span_findings(logic: Column) -> Column:
    """Findings about calls and function heads, over as many lines as their brackets span.

    One fold over the brackets: each open bracket remembers what it belongs to, so a keyword is told to its own call, a
    default to its own function, and ``open`` knows whether it stands as an item of a ``with``.
    """
    rules = {r.rule: r for r in PYTHON_LINE_RULES}

    def finding(rule: str, line: Column, word: Column) -> Column:
        r = rules[rule]
        return F.array(_finding(r.rule, r.severity, line, _worded(r.message, line, word)))

    def read(s: Column, token: Column) -> Column:
        opened, line = s["open"], s["line"]
        top = F.get(opened, F.size(opened) - 1)
        name = F.trim(F.regexp_extract(token, r"^(?:def\s+)?([\w.]+)\s*\($", 1))
        last = F.regexp_extract(name, r"(\w+)$", 1)
        is_def, is_call = token.rlike(r"^def\b"), token.rlike(r"^[A-Za-z_][\w.]*\s*\($")
        default, opens, closes = token.rlike(r"^=\s*[\[{]$"), token.isin("(", "[", "{"), token.isin(")", "]", "}")
        kind = F.when(is_def, "def").when(is_call, "call").otherwise("bracket")
        pushed = F.array_append(opened, F.struct(kind.alias("kind"), name.alias("name"), line.alias("line"), F.lit(False).alias("timed")))
        told = F.concat(F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0))), F.array(F.struct(
            top["kind"].alias("kind"), top["name"].alias("name"), top["line"].alias("line"), F.lit(True).alias("timed"))))
        after = (
            F.when(is_def | is_call | opens | default, pushed)
            .when(closes & (F.size(opened) > 0), F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0))))
            .when(token.startswith("timeout") & (top["kind"] == "call"), told).otherwise(opened))
        # an item of a with: nothing is open around it, or only the with's own parentheses
        bare = (F.size(opened) == 0) | ((F.size(opened) == 1) & (top["kind"] == "bracket"))
        fresh = (
            F.when(is_call & last.isin("eval", "exec"), finding("eval", line, last))
            .when(is_call & (last == "open") & ~(s["item"] & bare), finding("open", line, last))
            .when(default & (top["kind"] == "def"), finding("mutable-default", line, top["name"]))
            .when(closes & (top["kind"] == "call") & ~top["timed"] & top["name"].rlike(r"^requests\.(get|post|put|delete|request)$"),
                  finding("no-timeout", top["line"], F.regexp_extract(top["name"], r"(\w+)$", 1))))
        return F.struct(
            after.alias("open"), (line + (token == "\n").cast("int")).alias("line"),
            F.when(token.rlike("^with$") & (F.size(opened) == 0), True).when((token == "\n") & (F.size(opened) == 0), False).otherwise(s["item"]).alias("item"),
            F.concat(s["found"], F.coalesce(fresh, F.array().cast(FINDING))).alias("found")).cast(SPAN_STATE)

    start = F.struct(F.array().alias("open"), F.lit(1).alias("line"), F.lit(False).alias("item"), F.array().alias("found")).cast(SPAN_STATE)
    return F.aggregate(F.regexp_extract_all(logic, F.lit(SPAN_TOKEN), F.lit(0)), start, read, lambda s: s["found"])


def _silent_blocks(lines: Column) -> Column:
    """An except block of which every line that is not blank is ``pass``: the block is what is indented deeper than its head."""

    def at(line: Column, i: Column) -> Column:
        rest = F.slice(lines, i + 2, F.size(lines))
        rest = F.filter(rest, lambda x: F.trim(x) != "")
        first_out = F.array_min(F.transform(rest, lambda x, j: F.when(_indent(x) <= _indent(line), j)))
        body = F.slice(rest, 1, F.coalesce(first_out, F.size(rest)))
        silent = (F.size(body) > 0) & F.forall(body, lambda x: F.trim(x) == "pass")
        fires = F.when(line.rlike(r"^\s*except\b[^:]*:\s*$"), silent).otherwise(line.rlike(r"^\s*except\b[^:]*:\s*pass\s*$"))
        return F.when(fires, _finding("swallowed", "warning", i + 1, _worded(SWALLOWED, i + 1)))

    return F.filter(F.transform(lines, at), lambda f: f.isNotNull())


def lint_python_spans(snippets: DataFrame) -> DataFrame:
    """Python findings judged over whole calls, function heads and blocks; the rules that need one line only are as they are."""
    df = _with_logic(snippets)
    lines = F.col("lines")
    parts = [_line_rule(r, lines) for r in PYTHON_LINE_RULES if r.rule in ("bare-except", "none-compare")]
    parts += [_silent_blocks(lines), _span_findings(F.col("logic"))]
    parts += [_code_rule(r, F.col("code"), F.col("logic")) for r in PYTHON_RULES]
    return _explode(df, F.concat(*parts))


def lint_data_science(snippets: DataFrame) -> DataFrame:
    """Data-science findings; equal messages show once per snippet."""
    df = _with_logic(snippets)
    lines, logic = F.col("lines"), F.col("logic")
    parts = [_line_rule(r, lines) for r in DATA_LINE_RULES] + [_axis(lines, logic), _leaks(lines, F.col("first_split"))]
    parts += [_code_rule(r, F.col("code"), logic) for r in DATA_RULES]
    return _explode(df, F.array_distinct(F.concat(*parts)))


def lint_leakage(snippets: DataFrame) -> DataFrame:
    return _explode(_with_logic(snippets), _leaks(F.col("lines"), F.col("first_split")))


def bracket_balance(snippets: DataFrame) -> DataFrame:
    return _with_logic(snippets).select("snippet_id", balance_problem(F.col("logic")).alias("problem"))


def lint_code(snippets: DataFrame) -> DataFrame:
    """Findings of every snippet by the rules of its language."""
    by = lambda *names: snippets.where(F.col("language").isin(*names))
    return (
        lint_java(by("java")).unionByName(lint_java(by("spring"), spring=True))
        .unionByName(lint_python(by("python", "datascience"))).unionByName(lint_data_science(by("datascience")))
    )


def lint_summary(findings: DataFrame) -> DataFrame:
    """Findings per rule, one column per severity."""
    return findings.groupBy("rule").pivot("severity", ["error", "warning", "tip"]).agg(F.count(F.lit(1))).na.fill(0)


def code_structure(snippets: DataFrame) -> DataFrame:
    """What a snippet is made of: imports, functions, classes, loops, branches, annotations, methods."""
    df = _with_logic(snippets)
    logic = F.col("logic")

    def names(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract_all(logic, F.lit(pattern), F.lit(group))

    plain = F.transform(F.flatten(F.transform(names(r"(?m)^\s*import\s+([^\n;]+)$"), lambda s: F.split(s, ","))),
                        lambda s: F.regexp_extract(s, r"^\s*(\w+)", 1))
    imports = F.concat(plain, names(r"(?m)^\s*from\s+([\w.]+)\s+import\b"))
    java = F.col("language").isin("java", "spring")
    methods = names(fixed.JAVA_METHOD)
    notes = F.array_sort(F.array_distinct(F.filter(names(r"@(\w+)"), lambda a: a != "Override")))

    def count(pattern: str) -> Column:
        return F.regexp_count(logic, F.lit(pattern))

    return df.select(
        "snippet_id", "language",
        F.when(java, "").otherwise(F.array_join(F.array_sort(F.array_distinct(imports)), ",")).alias("imports"),
        F.when(java, 0).otherwise(count(r"(?m)^\s*(?:async\s+)?def\s+\w+")).alias("functions"),
        F.when(java, count(fixed.JAVA_TYPE))
        .otherwise(count(r"(?m)^\s*class\s+\w+")).alias("classes"),
        F.when(java, 0).otherwise(count(r"(?m)^\s*(?:async\s+for|for|while)\b")).alias("loops"),
        F.when(java, 0).otherwise(count(r"(?m)^\s*(?:if|elif)\b")).alias("branches"),
        F.when(java, F.array_join(notes, ",")).otherwise("").alias("annotations"),
        F.when(java, F.array_join(methods, ",")).otherwise("").alias("methods"),
    )


def code_todos(snippets: DataFrame) -> DataFrame:
    lines = F.filter(F.split("code", "\n", -1), lambda line: line.contains("TODO"))
    clean = F.transform(lines, lambda line: F.trim(F.regexp_replace(F.trim(line), fixed.TODO_LEAD, "")))
    return snippets.select("snippet_id", F.explode(clean).alias("todo"))
