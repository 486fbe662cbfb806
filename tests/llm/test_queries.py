"""Registered queries of the operators against their twin SQL, and the pipeline stage by stage against plain versions."""
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fairline.llm import op7_language, op10_toxicity
from fairline.llm.common import remainder
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_warc", "op3_decontaminate", "op8_near_duplicates"])
def test_query_equals_twin(spark, con, name):
    status, rows, *_, msg = compare(spark, con, SF, name, entry.queries(), entry.oracle_sql())
    assert status == "ok" and rows > 0, msg


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_kept(rows):
    """Smallest id of each group of texts that are 0.8 alike, over links."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root(k)] = min(low.get(root(k), i), i)
    return {i for k, (i, _) in enumerate(rows) if low[root(k)] == i}


def contaminated(text, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: find((t or "").encode().lower().decode())
    line = " " + " ".join(low(text)) + " "
    return any(" " + " ".join(w[i:i + 10]) + " " in line for w in map(low, items) if w for i in range(max(1, len(w) - 9)))


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = op10_toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    score, items = op10_toxicity.scorer(model), [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in now.collect()]
        if name == "toxicity":
            want = {i for i, t in rows if score(t) < 0.5}
        elif name == "language":
            label = op7_language.labeller(op7_language.fit(now.where(remainder("doc_id", 3) != 1)))
            want = {i for (i, _), (y, s) in zip(rows, label([t for _, t in rows])) if y != "und" and s >= 0.4}
        elif name == "near_duplicates":
            want = near_kept(rows)
        elif name == "decontamination":
            want = {i for i, t in rows if not contaminated(t, items)}
        else:
            want = {i for i, _ in rows}
        after = stage(spark, now, SF).cache()
        assert ids(after) == want and after.count() == len(want), name
        if name != "tokens":
            assert after.columns == docs.columns
            now = after
    assert 0 < now.count() < docs.count()
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, after.collect()))
