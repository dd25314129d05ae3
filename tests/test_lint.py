import pytest

from tidewell.functions import text
from tidewell.operators import grading, lint


@pytest.fixture
def check(spark):
    def run(code, language):
        df = spark.createDataFrame([(1, language, code)], "snippet_id bigint, language string, code string")
        return {r["rule"]: (r["severity"], r["line"], r["message"]) for r in lint.lint_code(df).collect()}

    return run


TIDY = {
    "java": """
        final class Ledger {
            /* open ( in a note, and } too */
            private static final char QUOTE = '"';
            String frame(int width) { return "[<" + width + "{("; } // tail ]
        }
        """,
    "spring": """
        @RestController
        class LedgerEndpoint {
            private final Ledger ledger;
            LedgerEndpoint(Ledger ledger) { this.ledger = ledger; }
            @DeleteMapping("/ledger/{page}")
            void drop(@PathVariable int page) { ledger.drop(page); }
            @PutMapping("/ledger")
            void store(@Valid @RequestBody Page page) { ledger.store(page); }
        }
        """,
    "python": """
        async def pages(source, kept=None):
            with open(source) as lines:  # eval(x) and open(y) are only named here
                note = "exec(1) != None"
                return [line for line in lines if line is not None], note
        """,
    "datascience": """
        train, test = train_test_split(table, random_state=3)
        encoder.fit(train)
        table.loc[table.weight > 9, "size"] = "large"
        axes.barh(names, weights)
        print(accuracy_score(test, guess), recall_score(test, guess))
        """,
}
# language, rule that must fire (and no other), code
FAULTY = [
    ("java", "brackets", "interface Shape { double area( }"),
    ("java", "brackets", "enum Suit { CLUBS, HEARTS"),
    ("java", "empty-catch", "void stop() { try { line.close(); } catch (IOException gone) {\n } }"),
    ("java", "credential", 'static final String apiKey = "zx81-spectrum-48k";'),
    ("spring", "field-injection", "@Service class Mill {\n  @Autowired\n  protected Grain grain;\n}"),
    ("spring", "entity-without-id", "@Entity class Parcel { String label; }"),
    ("spring", "csrf-off", "security.csrf().disable();"),
    ("spring", "permit-all", "rules.anyRequest() .permitAll();"),
    ("spring", "println", 'void log() { System.out.println("stored"); }'),
    ("spring", "optional-get", "Parcel p = parcels.findById(7).get();"),
    ("spring", "boot-without-run", "@SpringBootApplication class Depot { }"),
    ("spring", "run-without-boot", "SpringApplication.run(Depot.class);"),
    ("spring", "no-mapping", "@Controller class Idle { }"),
    ("python", "bare-except", "try:\n    weigh()\nexcept:\n    raise Heavy()\n"),
    ("python", "mutable-default", "def collect(item, basket={}):\n    basket[item] = 1\n"),
    ("python", "eval", "total = exec(formula)\n"),
    ("python", "open", "rows = list(open(source, newline=''))\n"),
    ("python", "no-timeout", "reply = requests.put(address, json=parcel)\n"),
    ("python", "none-compare", "if weight != None:\n    send(weight)\n"),
    ("python", "credential", "secret = 'correct-horse-battery'\n"),
    ("datascience", "leakage", "filled = imputer.fit_transform(table)\nl, r = train_test_split(filled, random_state=8)\n"),
    ("datascience", "no-seed", "l, r = train_test_split(table, test_size=0.3)\n"),
    ("datascience", "inplace", "table.dropna(inplace=True)\n"),
    ("datascience", "chained", "table['weight'][3] = 0\n"),
    ("datascience", "iterrows", "weights = [w for _, w in table.iterrows()]\n"),
    ("datascience", "frame-append", "df_all = df_all.append(df_new)\n"),
    ("datascience", "star-import", "from seaborn import *\n"),
    ("datascience", "bar-axis", "axes.barh(names, weights)\naxes.set_ylim(40, 60)\n"),
    ("datascience", "accuracy-only", "print(accuracy_score(truth, guess))\n"),
]


@pytest.mark.parametrize("language", TIDY)
def test_tidy_code(check, language):
    import textwrap

    assert check(textwrap.dedent(TIDY[language]), language) == {}


@pytest.mark.parametrize(("language", "rule", "code"), FAULTY)
def test_one_fault(check, language, rule, code):
    assert set(check(code, language)) == {rule}


def test_places_and_messages(check):
    assert check("int f(int a) {\n  return a[0);\n}", "java")["brackets"][2] == "Brackets don't balance: Unmatched ')' on line 2."
    assert "never closed" in check("enum Suit {\n  CLUBS,", "java")["brackets"][2]
    found = check("a = 1\nb = eval(a)\ntry:\n    b()\nexcept ValueError:\n    pass\n", "python")
    assert found["eval"][1] == 2 and found["swallowed"][1] == 5
    # rules of one language stay silent in another
    assert check("@Autowired\nprivate Grain grain;\n", "java") == {}
    assert check("axes.plot(weights)\naxes.set_ylim(40, 60)\n", "datascience") == {}


def test_strip_keeps_lines(column):
    given = ['a = "x // y"; // note\n/* one\n two */ b', "c = 'q' + '\\n'"]
    assert column(given, text.strip_code) == ["a =  ;  \n\n b", "c =   +  "]


def test_rubric(spark):
    rubric = grading.rubric_table(spark, [("r", "must", r"class\s+\w+", True, "Add a class."), ("r", "no-main", r"\bmain\b", False, "Drop main.")])
    rows = [(1, "class A { }", "r"), (2, "// class A\nvoid main() { }", "r"), (3, "x", "none")]
    df = spark.createDataFrame(rows, "snippet_id bigint, code string, rubric string")
    out = {r["snippet_id"]: r for r in grading.grade_rubric(df, rubric).collect()}
    assert set(out) == {1, 2} and out[1]["passed"] and out[1]["score"] == 1.0 and out[1]["advice"] == ""
    assert not out[2]["passed"] and out[2]["score"] == 0.0 and out[2]["advice"] == "Add a class. Drop main."
