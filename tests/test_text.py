"""Text operators against small golden cases and plain Python loops over the whole text."""

import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import contact, text
from tidewell.operators import packing, support

STORY = (
    "Dr. Who came at 5. e.g. this is not the end! Is it? Yes... (really.) ok\n1. First item. 2. second\n\n"
    + "A very long sentence, " * 30 + "ends here. " + "x" * 900 + " tail.\n\n\nNew paragraph\nwith lines.\n" + "word " * 400
)
TEXTS = [STORY, "", "  ", "One.", "a. b. c.", "no end " * 100, "Hi!\n\n" * 300, "é à ü. " * 200]


def test_reasoning_is_removed(column):
    given = ["Hello <think>secret reasoning</think> world!", "a <think>open", "List<String> a < b", "<think>x</think>y<think>z</think>"]
    assert column(given, text.strip_reasoning) == ["Hello  world!", "a ", "List<String> a < b", "y"]


def test_redaction_and_secrets(column):
    given = ["Mail a.b@c.org or call +27 82 345 6789 now", "id 1234567", "é@x.de"]
    assert column(given, text.redact) == ["Mail [EMAIL] or call +[PHONE] now", "id 1234567", "[EMAIL]"]
    assert column(["key gsk_ab12 and Bearer xyz.1"], text.scrub_secrets) == ["key gsk_*** and Bearer ***"]
    assert column(['api_key = "abcd"', "token: x"], text.has_credential) == [True, False]


def test_names(column):
    assert column(["My Report (v2).csv", "a/b/c.csv", ""], text.safe_filename) == ["My_Report__v2_.csv", "c.csv", "data.csv"]
    assert column(["Hello, World!", "***"], text.slug) == ["hello-world", "overview"]
    assert column(["A man, a plan", "Never odd or even", "été"], text.is_palindrome) == [False, True, True]


def test_packing_is_complete_and_greedy(column):
    """Pieces hold all sentences in order; none is over the limit unless it is one sentence; none could take one more."""
    for sentences, pieces in zip(
        column(TEXTS, lambda c: text.split_sentences(text.trim_all(c))),
        column(TEXTS, lambda c: packing.pack(text.split_sentences(text.trim_all(c)), 500)), strict=True,
    ):
        assert " ".join(pieces) == " ".join(s for s in sentences if s)
        rest = [s for s in sentences if s]
        for i, piece in enumerate(pieces):
            held = 0
            while held < len(rest) and piece.startswith(" ".join(rest[: held + 1])):
                held += 1
            assert " ".join(rest[:held]) == piece
            assert held == 1 or len(" ".join(rest[: held - 1])) + len(rest[held - 1]) <= 500
            rest = rest[held:]
            assert i == len(pieces) - 1 or len(piece) + len(rest[0]) > 500
        assert not rest
    assert column(["Tiny. " * 3, "x" * 40], packing.chunks) == [[], ["x" * 40]]


def python_overlap(t, size=800, overlap=100, marks=("\n\n", "\n", " ", "")):
    """Cut at the first mark, recurse into long parts, join neighbours; written apart from the Spark fold."""
    mark, rest = marks[0], marks[1:]
    if mark:
        pieces = t.split(mark)
        parts = [pieces[0]] + [mark + p for p in pieces[1:]]
    else:
        parts = list(t)
    out, run = [], []

    def flush():
        now = []
        for p in run:
            if sum(map(len, now)) + len(p) > size:
                out.append("".join(now).strip())
                while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > size):
                    now.pop(0)
            now.append(p)
        out.append("".join(now).strip())
        run.clear()

    for p in [p for p in parts if p]:
        if len(p) < size:
            run.append(p)
            continue
        flush()
        out.extend(python_overlap(p, size, overlap, rest))
    flush()
    return [c for c in out if c]


def test_overlapping_chunks_equal_a_plain_loop(column):
    assert column(TEXTS, packing.overlapping_chunks) == [python_overlap(t) for t in TEXTS]


def test_read_aloud(column):
    given = ["Dr. Who came. e.g. this stays! Is it? (Yes.) ok\n1. First thing. Then etc. and more", "One\nTwo.", "!?", "a",
             "cats vs. dogs. Done.", "word, " * 60, "word " * 100, "x" * 500]
    out = column(given, packing.read_aloud)
    assert out[0] == ["Dr.", "Who came.", "e.g. this stays!", "Is it?", "(Yes.)", "ok", "1. First thing.", "Then etc. and more"]
    assert out[1:5] == [["One", "Two."], [], [], ["cats vs. dogs.", "Done."]]
    for long, pieces in zip(given[5:7], out[5:7], strict=True):
        assert " ".join(pieces) == long.strip() and all(len(p) <= 221 for p in pieces) and len(pieces) > 1
    assert all(p.endswith(",") for p in out[5])
    assert [len(p) for p in out[7]] == [221, 221, 58]


def test_dialogue(column):
    script = ("# Episode title\n**HOST:** So *this* is [music] important.\nIt carries on here.\n\n- guest : (laughs) Right! \U0001F389\n"
              "HOST: " + " ".join(f"Sentence number {i} is here." for i in range(40)))
    turns = column([script, "Here is your script:\n\nnothing else"], lambda c: packing.dialogue(c, ["host", "guest"]))
    assert [tuple(t) for t in turns[0][:2]] == [("host", "So this is important. It carries on here."), ("guest", "Right!")]
    assert turns[1] == []
    lines = column([turns[0][2]["text"]], packing.spoken_lines)[0]
    assert len(lines) > 1 and all(len(x) <= 420 for x in lines) and " ".join(lines) == turns[0][2]["text"]


@pytest.mark.parametrize(("message", "name", "email"), [
    ("test@example.com", None, "test@example.com"),
    ("just a name no email", None, None),
    ("name : thandi   email : thandi@test.com", "thandi", "thandi@test.com"),
    ("My name is Anna and my email is anna@test.com", "Anna", "anna@test.com"),
    ("email: farah@example.com, name: Farah", "Farah", "farah@example.com"),
    ("I'm Themba, themba@test.com", "Themba", "themba@test.com"),
    ("I am Zane, zane@test.com", "Zane", "zane@test.com"),
    ("This is Naledi naledi@test.com", "Naledi", "naledi@test.com"),
    ("Call me Sam, sam@example.com", "Sam", "sam@example.com"),
    ("Mina here, mina@example.com — billed twice", "Mina", "mina@example.com"),
    ("Mina Pillay mina@example.com", "Mina Pillay", "mina@example.com"),
    ("zane@test.com, Zane Dlomo", "Zane Dlomo", "zane@test.com"),
    ("THEMBA_7@mail.com - I was billed two times, my name is Themba", "Themba", "themba_7@mail.com"),
    ("Hi Naledi, naledi@example.com needs help", "Naledi", "naledi@example.com"),
])
def test_contacts(column, message, name, email):
    assert column([message], contact.contact_email) == [email]
    found = column([message], contact.contact_name)[0]
    assert (found or "").lower().startswith((name or "").lower()) and (found is None) == (name is None)


def test_escalation_reason(column):
    given = ["I want a refund for fraud", "this is illegal", "help!!!", "you are the worst", "all good!!"]
    assert column(given, support.escalation_reason) == [
        "Escalation phrase detected: 'fraud'", "Escalation phrase detected: 'legal'",
        "High frustration detected in message tone", "High frustration detected in message tone", None]
    assert column(["hi"], lambda c: support.escalation_reason(c, F.lit(False))) == ["Account has an unresolved billing issue"]


def test_chunks_of_a_long_text_take_one_walk(spark):
    """Four million letters without a line break: a fold that copied its chunks at every word took minutes."""
    import time

    words = 800_000
    df = spark.createDataFrame([("word " * words,)], "t string")
    start = time.monotonic()
    found = df.select(packing.overlapping_chunks(F.col("t")).alias("c")).first().c
    assert time.monotonic() - start < 40
    assert len(found[0]) == 799 and len(found) == -(-(words - 160) // 140) + 1


def test_chunks_equal_the_fold(column):
    """One walk gives what the fold gives: long sentences, blanks of all kinds at the cuts, letters outside the basic plane."""
    import random

    rnd = random.Random(2)
    blanks = [" ", "  ", "\n", "\u00a0", "\u2003", "\x1c", "\x85", "\u200b", "\ufeff", "\u3000\t"]
    texts = ["", " ", "x", None, "A. " * 400, "y" * 1200 + ". " + "z" * 30 + ". " + "w" * 31]
    for _ in range(60):
        texts.append("".join(rnd.choice(["ab", "\U0001f600", "é"]) * rnd.randrange(0, 90) + rnd.choice([".", "!", "?", ""]) + rnd.choice(blanks)
                             for _ in range(rnd.randrange(1, 60))))
    fold = lambda c: F.filter(packing.pack(text.split_sentences(text.trim_all(c)), 500), lambda p: F.length(p) > 30)
    assert column(texts, packing.chunks) == column(texts, fold)


def test_chunks_of_a_long_text_take_one_walk():
    import time

    cut, start = packing._packed(500, 30), time.time()
    assert len(cut(["A sentence of some words."] * 400_000)) > 20_000
    assert time.time() - start < 20
