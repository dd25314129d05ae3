"""The pipeline stage by stage against plain versions, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_neardup import brute
from tests.llm.test_spans import overlaps
from tidewell.llm import mixing, secrets, toxicity

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after every stage, as rows by id."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, FOLDER), "stage")
        seen.append(docs)
    return seen


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[0])


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "MinHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    assert all(s.columns == COLUMNS for s in stages[:-1]) and stages[-1].columns == [*COLUMNS, "copy"]


def test_toxicity(spark, stages):
    found = toxicity.report(stages[0], spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    good = {r.doc_id for r in found if r.score < 0.5}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in good]
    assert len(good) > 150


def test_near_copies(stages):
    before = rows(stages[1])
    kept = [r for r, (_, _, keep) in zip(before, brute([r[1] for r in before], 5)) if keep]
    assert rows(stages[2]) == kept


def test_decontamination(spark, stages):
    before = rows(stages[2])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    hit = [dirty for *_, dirty in overlaps([r[1] for r in before], items)]
    assert rows(stages[3]) == [r for r, h in zip(before, hit) if not h]
    assert any(hit) and not all(hit)


def test_secrets(stages):
    before, after = rows(stages[3]), rows(stages[4])
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(stages[3]).collect()}
    for old, new in zip(before, after, strict=True):
        text, shift = old[1], 0
        marks, reach = [], 0
        for s in sorted(spans[old[0]], key=lambda s: s["start"]):
            if marks and s["start"] < reach:
                marks[-1] = (marks[-1][0], max(reach, s["end"]))
            else:
                marks.append((s["start"], s["end"]))
            reach = max(reach, s["end"])
        for a, b in marks:
            text = text[:a + shift] + "[SECRET]" + text[b + shift:]
            shift += len("[SECRET]") - (b - a)
        assert new == (old[0], text, *old[2:4], len(text))
    assert not any(r.spans for r in secrets.find_secrets(stages[4]).collect())


def test_mixture(stages):
    by_id = {r[0]: r for r in rows(stages[4])}
    steps = {r["source"]: r["steps"] for r in mixing.poisson_steps(mixing.rates(stages[4])).collect()}
    import hashlib

    want = []
    for i, row in by_id.items():
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        want += [(*row, c + 1) for c in range(sum(s <= u for s in steps[row[3]]))]
    assert sorted(tuple(r) for r in stages[5].collect()) == sorted(want)


def test_run(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in stages[-1].collect())
