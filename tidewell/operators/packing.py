"""Greedy packing of sentences into pieces of limited size, as a fold inside each row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import fixed
from tidewell.functions import text


def pack(sentences: Column, limit: int, joint: int = 0) -> Column:
    """Array of pieces: a sentence starts a new piece when it would take the current one over ``limit``.

    ``joint`` counts the joining space.  A sentence longer than the limit stays whole.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, s: Column) -> Column:
        now = state["open"]
        over = (F.length(now) + F.length(s) + joint > limit) & ((now != "") | F.lit(joint == 0))
        closed = F.when(now != "", F.array_append(state["done"], text.trim_all(now))).otherwise(state["done"])
        return F.when(over, F.struct(closed.alias("done"), s.alias("open"))).otherwise(
            F.struct(state["done"].alias("done"),
                     text.trim_all(F.concat(now, F.lit(" "), s)).alias("open"))
        )

    def finish(state: Column) -> Column:
        return F.when(state["open"] != "", F.array_append(state["done"], text.trim_all(state["open"]))).otherwise(
            state["done"]
        )

    return F.aggregate(sentences, empty, add, finish)


# what ``fixed.WS`` matches
_SPACE = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _packed(limit: int, least: int):
    """``sentences -> pieces`` of more than ``least`` characters: what :func:`pack` does, in one walk."""

    def pieces(sentences):
        if sentences is None:
            return None
        done, now = [], ""
        for s in sentences:
            if len(now) + len(s) > limit:
                done.append(now.strip(_SPACE))
                now = s
            else:
                now = f"{now} {s}".strip(_SPACE)
        done.append(now.strip(_SPACE))
        return [p for p in done if len(p) > least]

    return pieces


def chunks(c: Column, size: int = fixed.CHUNK_SIZE, least: int = fixed.CHUNK_MIN) -> Column:
    """Sentence-aligned chunks of a document; very short ones are left out.

    A fold would copy its finished pieces and trim the open one at every sentence, so a small function walks the sentences.
    """
    return F.udf(_packed(size, least), "array<string>")(text.split_sentences(text.trim_all(c)))


def spoken_lines(c: Column, size: int = fixed.LINE_SIZE) -> Column:
    """A turn as lines of at most ``size`` characters."""
    split = F.transform(pack(text.split_sentences(c), size, joint=1), lambda p: F.substring(p, 1, size))
    return F.when(F.length(c) <= size, F.array(c)).otherwise(split)


def _overlapping(size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ")):
    """``text -> chunks``, not trimmed yet, in one walk over the text.

    Text is cut at the first separator, parts that stay too long at the next, and so on; the last cut is by character.  A part
    keeps the separator before it.  Only neighbours that were cut from the same text may be joined again.
    """
    mark = "\u0002"

    def pieces(whole, level, parent):
        """(part, text it was cut from) in order."""
        if level == len(separators):
            yield from ((letter, parent) for letter in whole)
            return
        cut = whole.replace(separators[level], mark + separators[level]).split(mark)
        for i, part in enumerate(p for p in cut if p):
            if len(part) < size:
                yield part, parent
            else:
                yield from pieces(part, level + 1, (*parent, i))

    def chunks(whole):
        if whole is None:
            return None
        done, now, total, origin = [], [], 0, ()
        for part, parent in pieces(whole, 0, ()):
            n = len(part)
            if parent == origin and total + n <= size:
                now.append(part)
                total += n
                continue
            done.append("".join(now))
            kept, room = len(now), min(overlap, size - n) if parent == origin else -1
            total = 0
            while kept and total + len(now[kept - 1]) <= room:  # the last parts that fit come before the new one
                kept -= 1
                total += len(now[kept])
            now, total, origin = [*now[kept:], part], total + n, parent
        return [*done, "".join(now)]

    return chunks


def overlapping_chunks(c: Column, size: int = 800, overlap: int = 100) -> Column:
    """Chunks of up to ``size`` characters cut at paragraphs, else lines, else words, else characters.

    Neighbouring parts are joined while they fit; a new chunk starts with the last parts of the one before, as many as
    fit into ``overlap``.  A fold with an array as its state would copy that state at every word, so a small function walks the text.
    """
    cut = F.udf(_overlapping(size, overlap), "array<string>")(c)
    return F.filter(F.transform(cut, text.trim_all), lambda x: x != "")


def read_aloud(c: Column, size: int = 220) -> Column:
    """Sentences for reading aloud: list numbers and common abbreviations do not end one; long ones are cut.

    A piece over ``size`` is cut after its last comma, else at its last space, else hard.
    """
    ends = r"[.!?]+[\"')\]]*"
    t = F.regexp_replace(c, rf"({ends})(?=\s|\z)", "$1\u0001")
    t = F.regexp_replace(t, rf"(?i)(?<=^|\s|\x01)((?:e\.g|i\.e|etc|vs|approx){ends})\x01", "$1")
    t = F.regexp_replace(t, rf"(?<=^|\n|\x01)(\s*\d{{1,2}}{ends})\x01", "$1")
    pieces = F.transform(F.split(t, r"[\x01\n]", -1), text.trim_all)
    good = F.filter(pieces, lambda p: (F.length(p) >= 2) & p.rlike(r"[\p{L}\p{N}]"))
    cut = rf"(?s)\G\s*(?:.{{1,{size}}}\z|.{{41,{size}}},(?= )|.{{1,{size}}} |.{{{size + 1}}})"

    def short(p: Column) -> Column:
        return F.when(F.length(p) <= size, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(cut), F.lit(0)))

    return F.filter(F.transform(F.flatten(F.transform(good, short)), text.trim_all), lambda p: p != "")


def dialogue(c: Column, speakers: list[str]) -> Column:
    """Turns of a tagged script: array of (speaker, text); text before the first tag is dropped.

    A tag is the speaker's name at the start of a line, marks around it allowed, followed by a colon.
    """
    names = "|".join(speakers)
    tag = rf"(?i)[^\p{{L}}\p{{N}}_\n]*({names})[^\p{{L}}\p{{N}}_\n]*:"
    lines = F.concat(F.lit("\n"), c)
    parts = F.split(lines, r"\n(?=" + tag + ")")
    tagged = F.filter(parts, lambda p: p.rlike(r"\A" + tag))
    turn = F.transform(
        tagged,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, r"\A" + tag, 1)).alias("speaker"),
            text.strip_markup(F.regexp_replace(p, r"\A" + tag + r"\s*", "")).alias("text"),
        ),
    )
    return F.filter(turn, lambda t: t["text"] != "")


OPEN, CLOSE = "<think>", "</think>"


def think_rule(order: str, piece: str):
    """Drops reasoning from a text that arrives in pieces, tags split anywhere; adds ``kept`` and ``rest``.

    An automaton reads the pieces: it is inside a block or not, and has seen the first letters of the tag it waits for.  That is
    the whole state, at most seven letters.  ``kept`` is what a piece lets out.  ``rest`` is what would follow if the
    text ended there: the letters outside a block that might still become a tag.
    """
    from tidewell.operators.sequences import Rule

    def begun(text: str, tag: str) -> int:
        """How many letters at the end of ``text`` begin the tag."""
        return next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)

    def read(inside: bool, text: str) -> tuple[str, bool, str]:
        if "<" not in text:  # both tags begin with it
            return "" if inside else text, inside, ""
        out = []
        while True:
            before, tag, after = text.partition(CLOSE if inside else OPEN)
            if not tag:
                held = begun(text, CLOSE if inside else OPEN)
                out += [] if inside else [text[:len(text) - held]]
                return "".join(out), inside, text[len(text) - held:]
            out += [] if inside else [before]
            inside, text = not inside, after

    def run(state, rows):
        inside, held = state or (False, "")
        kept, rest = [], []
        for text in rows[piece].tolist():
            out, inside, held = read(inside, held + (text or ""))
            kept.append(out)
            rest.append("" if inside else held)
        return {"kept": kept, "rest": rest}, [inside, held] if inside or held else None

    return Rule(run, "kept string, rest string", (order,))


def joined(pieces, keys: list[str], order: str):
    """Whole texts from the result of :func:`think_rule`; one text is one row, so its pieces fit in a row too."""
    last = F.max_by("rest", order)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "kept"))), lambda x: x["kept"])
    return pieces.groupBy(*keys).agg(F.concat(F.array_join(parts, ""), last).alias("text"))
