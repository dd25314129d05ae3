import itertools
import re

import pytest

from tidewell.llm import filter_audit

COLUMNS = "doc_id long, text string, lang string, mask int, part string, rows long"
GOOD = " ".join(f"word{i}" for i in range(210))


def plainly(rows, labels):
    fails = []
    for i, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails.append((lang or "", i, {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)}))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(x[f] for _, x in mine) - len(removed),
                    sum(x[f] and sum(x.values()) == 1 for _, x in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


ROWS = [
    (0, GOOD, "en"), (1, GOOD, "en"), (2, GOOD, "fr"), (3, "SHOUTING " * 250, "en"), (4, GOOD + " 100%", "en"), (5, None, "en"),
    (6, "", None), (7, "few", "de"), (7, "few", "de"), (8, GOOD + "\x85\x1c ü", "de"), (9, "same " * 5_000, "de"), (9, GOOD, "de"),
    (None, GOOD, "en"), (None, "few", "xx"), (10, "few", "xx"), (11, GOOD.upper(), ""), (12, GOOD + " " + "é" * 40 + "ABCDEF", "en"),
]
LABELS = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (3, 0, 1), (4, None, None), (7, 1, 0), (9, 1, None), (99, 1, 1), (None, 1, 1)]


def check(spark, rows, labels, **more):
    docs = spark.createDataFrame([(*r, 7, "own", 1) for r in rows], COLUMNS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks, **more).collect()
    want = plainly(rows, labels)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


@pytest.mark.parametrize("sketch_bytes", [1 << 26, 0])
def test_against_orders_one_by_one(spark, sketch_bytes):
    check(spark, ROWS, LABELS, sketch_bytes=sketch_bytes)


def test_without_labels_and_one_group_of_copies(spark):
    check(spark, [(i, GOOD if i % 3 else f"{GOOD} {i}", "en") for i in range(60)], [])


def test_empty_table(spark):
    check(spark, [], LABELS)


def test_the_prepass_clears_unique_texts_and_no_copy(spark):
    rows = [(i, f"text {i} " * 3 if i % 10 else "copy", "en", 0, "", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    narrow = filter_audit.facts(docs)
    found = filter_audit.possible_repeats(docs, narrow, len(rows))
    ids = {r.key for r in found.select("key").collect()}
    assert ids >= {i for i in range(20_000) if i % 10 == 0}
    assert len(ids) - 2_000 < 18_000 * 0.01
