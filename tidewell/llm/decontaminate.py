"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Texts and items are normalised alike: A-Z lower-cased, words are runs of digits, letters a-z and anything beyond ASCII.
Every window of ``window`` consecutive item words is a pattern (a shorter item is one pattern).  The automaton works on
word numbers, so a match ends at a word and its place in the original text is the place of that word.

The windows are counted first.  They are broadcast in blocks of at most ``block_windows`` distinct windows (a worker holds
one block's automaton, some 100 bytes a word).  A benchmark of one block needs one pass over the texts; a larger one needs a
pass for every block, whose findings are joined by text.

Defined results: a null or empty text has no words and is clean; a null or empty item has no window; a null item id counts as
the empty id; repeated items count once by id; repeated documents give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import as_digest, map_rows, written

WINDOW = 10
BLOCK_WINDOWS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 1)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids of the items that hold them: ``window`` (words joined by a space), ``items``."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), _words(F.col(text)).alias("w"))
    words = words.where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(window - 1)))
    cut = words.select("item", "w", F.explode(starts).alias("at"))
    cut = cut.select("item", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("window"))
    return cut.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _scanner(patterns, only_hits: bool):
    """Scan rows (..., text) with the automaton of one block."""

    def scan(rows: Iterator[tuple]) -> Iterator[tuple]:
        import ahocorasick

        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for text, items in patterns.value:
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in text.encode().split(b" "))
            automaton.add_word(key, (len(key), items))
        automaton.make_automaton()
        breaks = bytes(32 if i < 0x30 or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))
        number = numbers.get
        place = re.compile(WORD)
        for *key, text in rows:
            words = (text or "").encode("utf-8", "surrogatepass").lower().translate(breaks).split(b" ")
            words = [w for w in words if w]
            found, hit, reach = set(), [], -1
            for end, (size, items) in automaton.iter(tuple([number(w, 0) for w in words])) if numbers and words else ():
                found.update(items)
                hit.append((end - size + 1, end))
            if not hit:
                if not only_hits:
                    yield (*key, len(words), 0, [], [])
                continue
            runs: list[list[int]] = []
            for a, b in sorted(hit):
                if runs and a <= reach + 1:
                    runs[-1][1] = reach = max(reach, b)
                else:
                    runs.append([a, b])
                    reach = b
            at = [m.span() for m in place.finditer(text.translate(str.maketrans(UPPER, LOWER)))]
            spans = [{"start": at[a][0], "end": at[b][1]} for a, b in runs]
            yield (*key, len(words), sum(b - a + 1 for a, b in runs), sorted(found), spans)

    return scan


def _scan(docs: DataFrame, items: DataFrame, carry: list[str], text: str, window: int, block_windows: int) -> DataFrame:
    """Columns ``carry`` as ``_c0``, ``_c1``, ... and what :data:`FOUND` names, a row for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_text"))
    kept = ", ".join(f"_c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(carry)))
    all_windows = written(windows(items, window=window), "windows")
    blocks = max(1, -(-all_windows.count() // block_windows))
    block_of = F.pmod(F.xxhash64("window"), F.lit(blocks))

    def patterns(block: int):
        # about block_windows rows, by the count above
        found = all_windows.where(block_of == block).collect()
        return spark.sparkContext.broadcast([(r[0], r[1]) for r in found])

    if blocks == 1:
        return map_rows(rows, f"{kept}, {FOUND}", _scanner(patterns(0), only_hits=False))
    digest = F.md5(F.coalesce("_text", F.lit("")).cast("binary"))  # what is found depends on the text alone
    texts = rows.select(digest.alias("_digest"), "_text")
    hits = None
    for block in range(blocks):
        part = written(map_rows(texts, f"_digest string, {FOUND}", _scanner(patterns(block), True)), "hits")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy("_digest").agg(*[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("items", "spans")])
    joined = rows.withColumn("_digest", digest).join(hits, "_digest", "left").drop("_digest")

    def merge(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Spans of different blocks may overlap or touch: the union of their words counts."""
        place = re.compile(WORD)
        for *key, text, items, spans in rows:
            at = [m.span() for m in place.finditer((text or "").translate(str.maketrans(UPPER, LOWER)))]
            merged: list[dict] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans or []):
                if merged and not _between(at, merged[-1]["end"], start):
                    merged[-1]["end"] = max(merged[-1]["end"], end)
                else:
                    merged.append({"start": start, "end": end})
            n_hit = sum(len(_between(at, s["start"], s["end"])) for s in merged)
            yield (*key, len(at), n_hit, sorted(items or []), merged)

    return map_rows(joined, f"{kept}, {FOUND}", merge)


def _between(at: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Words whose place lies in [start, end)."""
    import bisect

    return at[bisect.bisect_left(at, (start, 0)):bisect.bisect_left(at, (end, 0))]


def find_overlaps(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_hit``, ``items`` found and ``spans`` of hit words.

    Spans are code points of the original text, end exclusive; neighbouring hit words share a span.
    """
    return written(_scan(docs, items, [key], text, window, block_windows).withColumnRenamed("_c0", key), "overlaps")


def report(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """The digest columns of :func:`find_overlaps`."""
    found = find_overlaps(docs, items, **more)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        as_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **more) -> DataFrame:
    """The documents without a single hit word, with all their columns."""
    more = {"window": WINDOW, "block_windows": BLOCK_WINDOWS} | more
    clean = _scan(docs, items, docs.columns, text, **more).where("n_hit = 0")
    return clean.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
