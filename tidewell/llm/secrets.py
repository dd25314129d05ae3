"""Secret scans: known credential shapes, and random strings that a tokenizer cannot shorten.

Prose and identifiers cost few tokens for their length, random strings cost many.  Every run of 20 or more token characters
(``A-Z a-z 0-9 + / _ -`` and closing ``=``) is encoded with a public byte-level vocabulary; at ``ratio`` characters a token
or less it is a finding of kind ``token``, unless it is a known digest or identifier: all digits, one hexadecimal digest (the
``hex`` kind or a commit number), a UUID, or words and numbers joined by ``_ - / +``, where every part of letters is itself
over ``ratio`` characters a token.  What a run shares with a finding of a base kind is cut out; the rest of it is scanned.

Base kinds (contract): ``assign``, ``access``, ``hex``, each leftmost without overlap; a match that is too short is dropped.

The vocabulary is read on the driver (its size is checked) and broadcast.

Defined results: a null text is empty; an empty text has no finding; repeated rows give a row each; extra columns are left
alone; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import as_digest, map_rows, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 16 << 20
RATIO = 2.2
LEAST = 20  # characters of a run; no base kind of runs is shorter
PIECE = 256  # longer runs are encoded in pieces
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# fixed values: the base kinds in their order, pattern, group that is measured, least characters
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST
UUID = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
DIGEST = r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
NAME = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+]*"
FOUND = "spans array<struct<kind:string,start:int,end:int>>"


def load_vocabulary(spark, path: str = VOCABULARY):
    """Broadcast the ranks of a tiktoken file (at most ``VOCABULARY_BYTES``)."""
    import base64

    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return spark.sparkContext.broadcast(ranks)


def _finder(vocabulary, ratio: float):
    def merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1])
            else:
                out.append((a, b))
        return out

    def outside(taken: list[tuple[int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
        """The parts of a span between those taken, which are apart and in order."""
        for a, b in taken[bisect_right(taken, start, key=lambda s: s[1]):]:
            if a >= end:
                break
            if a > start:
                yield start, a
            start = b
        if start < end:
            yield start, end

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocabulary.value, special_tokens={})
        kinds = {kind: (order, re.compile(pattern), group, least) for order, (kind, pattern, group, least) in enumerate(BASE)}
        long_piece, run = re.compile(r"\S{%d,}" % LEAST), re.compile(RUN)
        known, name, letters = re.compile(f"(?:{UUID}|{DIGEST})={{0,2}}"), re.compile(NAME + "={0,2}"), re.compile("[A-Za-z]+")

        def tokens(body: str) -> int:
            return sum(len(encoding.encode_ordinary(body[i:i + PIECE])) for i in range(0, len(body), PIECE))

        def is_random(body: str) -> bool:
            if len(body) > ratio * tokens(body) or known.fullmatch(body):
                return False
            # the vocabulary holds most words in small letters after a space
            return not name.fullmatch(body) or any(len(w) <= ratio * tokens(" " + w.lower()) for w in letters.findall(body))

        for *key, text in rows:
            text = text or ""
            low = text.lower()
            found = []

            def look(kind: str, start: int, end: int) -> None:
                order, pattern, group, least = kinds[kind]
                for m in pattern.finditer(text, start, end):
                    if m.end(group) - m.start(group) >= least:
                        found.append((m.start(), order, m.end(), kind))

            if any(cue in low for cue in CUES):
                look("assign", 0, len(text))
            if "AKIA" in text:
                look("access", 0, len(text))
            pieces = [m.span() for m in long_piece.finditer(text)]  # a run holds no white space
            for start, end in pieces:
                look("hex", start, end)
            taken = merged((f[0], f[2]) for f in found)
            for start, end in pieces:
                for m in run.finditer(text, start, end):
                    for a, b in outside(taken, *m.span()):
                        for part in run.finditer(text, a, b):
                            if is_random(part.group()):
                                found.append((part.start(), len(BASE), part.end(), "token"))
            yield (*key, text, [{"kind": k, "start": a, "end": b} for a, _, b, k in sorted(found)])

    return scan


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO
) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end in code points; by start, then kind) for every row."""
    found = _scan(docs, [key], text, vocabulary, ratio).drop("_text").withColumnRenamed("_c0", key)
    return written(found, "secrets")


def _scan(docs: DataFrame, carry: list[str], text: str, vocabulary: str, ratio: float) -> DataFrame:
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_text"))
    kept = ", ".join(f"_c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(carry)))
    return map_rows(rows, f"{kept}, _text string, {FOUND}", _finder(load_vocabulary(docs.sparkSession, vocabulary), ratio))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, **more) -> DataFrame:
    """Counts and digest of the base kinds, and all spans as text."""
    found = find_secrets(docs, **more)
    names = [kind for kind, *_ in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    written = lambda spans: F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in names]
    return found.select(
        "doc_id", *counts, as_digest(written(base)).alias("base_sha256"), F.array_join(written(F.col("spans")), ",").alias("spans"))


def redact(
    docs: DataFrame, text: str = "text", mark: str = "[SECRET]", vocabulary: str = VOCABULARY, ratio: float = RATIO
) -> DataFrame:
    """Every found span replaced by ``mark`` (overlapping spans by one); other columns and null texts stay."""
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("_text"))
    at = docs.columns.index(text)
    kept = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    scan = _finder(load_vocabulary(docs.sparkSession, vocabulary), ratio)

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for *key, body, spans in scan(rows):
            out, reach = [], 0
            for s in spans:
                if s["start"] >= reach:
                    out += [body[reach:s["start"]], mark]
                reach = max(reach, s["end"])
            if spans:
                key[at] = "".join(out) + body[reach:]
            yield tuple(key)

    clean = map_rows(rows, kept, cut)  # one pass, so one Python worker a task
    return clean.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
