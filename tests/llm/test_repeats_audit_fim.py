"""Substring dedup, filter audit and fill-in-middle: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables
and columns with clashing names."""
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fairline.llm import op11_repeats, op12_audit, op13_fim
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
PASSAGE = "all of these words stand in more than one text of this table and so they go from every text but one"
LONG = " ".join(f"word{i * i % 9973} tail{i % 13}" for i in range(150_000))
TEXTS = [None, "", " ", "a b", PASSAGE, PASSAGE, "x " + PASSAGE.replace(" ", "\t\n") + " y", PASSAGE.upper() + " #1", LONG, "before " + LONG[5000:9000], "é🙂 " * 40 + PASSAGE, "<P> of a " + PASSAGE, " \x0b", "the the " * 60]


def clash():
    return {c: F.lit(-1.5) for c in ("id", "part", "rid", "h", "n", "a", "b", "lo", "hi", "at", "docs", "owner", "digest", "mask", "first", "good", "toxic", "quality", "_id", "_text", "_h0", "form", "output")}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(4, PASSAGE, "s1"), (3, "z " + PASSAGE, "s1"), (None, PASSAGE + " again", None), (None, None, "")]
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 30)}" for _ in range(60)]
    for k in range(40):
        a = rng.randint(0, 40)
        rows.append((100 + k, " ".join(base[a:a + rng.randint(5, 30)] + [f"u{k}"] + base[:rng.randint(0, 20)]), f"s{k % 4}"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns(clash()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["op11_repeats", "op12_filter_audit", "op13_fill_in_middle"])
def test_query_equals_twin(spark, con, name):
    status, rows, *_, msg = compare(spark, con, SF, name, entry.queries(), entry.oracle_sql())
    assert status == "ok" and rows > 0, msg


# ---- 11

def removed_by_hand(rows, n=13):
    owner = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k:k + n])
            owner[g] = min(owner.get(g, 1 << 63), i if i is not None else 1 << 63)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if owner[tuple(w[k:k + n])] < (i if i is not None else 1 << 63):
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part, shard", [(8 << 20, 50_000), (3000, 7)])
def test_repeats(spark, docs, none, part, shard):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = op11_repeats.remove_repeats(docs, part_bytes=part, shard=shard).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == removed_by_hand(rows)
    texts = {i: t for i, t in rows if i != 3 and i is not None}
    for r in got:
        spans = list(zip(r["spans"][::2], r["spans"][1::2]))
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        if r["doc_id"] in texts:
            w = words(texts[r["doc_id"]])
            for a, b in reversed(spans):
                del w[a:b]
            assert " ".join(w) == r["kept"]
    assert op11_repeats.remove_repeats(none).count() == 0


def test_short_phrases_and_a_hot_passage(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for k in range(120)] + [(1000 + k, f"q{k} " + PASSAGE) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, gram in ((4, 2), (3, 3), (1, 1)):
        got = op11_repeats.remove_repeats(df, words=n, gram=gram, part_bytes=1500, shard=50).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == removed_by_hand(rows, n)


# ---- 12

def test_positional_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 7, 1000):
        w = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert op12_audit.positional_counts(w).tolist() == [int((w >> k & 1).sum()) for k in range(32)]


def failing(i, t, all_rows):
    t = t or ""
    w = words(t)
    return "".join(x for x, bad in zip("ABCDE", (
        len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
        i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in all_rows))) if bad)


def test_audit(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 1), (13, 1, 1), (None, 1, 1), (101, None, None)], "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(9))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    bad = [failing(i, t, rows) for i, t, _ in rows]
    want = {}
    for part in {s or "" for *_, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, bad) if (s or "") == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                out = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(out)
                want[part, order, step] = [len(left), len(out), sum(x in f for _, f in mine) - len(out), sum(f == x for _, f in mine), sum(i in (4, 13) for i, _ in out), sum(i in (5, 13) for i, _ in out)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in op12_audit.report(docs, labels).collect()}
    assert got == want
    assert op12_audit.report(none, labels).count() == 0
    assert op12_audit.report(docs, labels.where("doc_id < 0")).where("good_lost > 0 OR toxic_lost > 0").count() == 0


# ---- 13

def test_skip_list():
    rng = random.Random(8)
    for n in (0, 1, 2, 8, 9, 63, 64, 65, 700, 5000):
        points = [rng.randint(1, 9) for _ in range(n)]
        lane = op13_fim.SkipList(points)
        assert all(lane.offset(r) == sum(points[:r]) for r in {0, n, n // 2, *(rng.randint(0, n) for _ in range(200))})
        with pytest.raises(IndexError):
            lane.offset(n + 1)


def test_fill_in_middle(spark, docs, none):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for i, t in rows:
        h = [int(sha(f"42:{'' if i is None else i}")[8 * k:8 * k + 8], 16) for k in range(4)]
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        assert p + m + s == t
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want.append((i, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(t)))
    assert sorted(map(tuple, op13_fim.report(docs).collect()), key=str) == sorted(want, key=str)
    assert {"plain", "spm", "psm"} == {x[2] for x in want}
    assert op13_fim.report(none).count() == 0
    back = op13_fim.fill_in_middle(docs, rate=100, spm=50).select("doc_id", op13_fim.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(((r["doc_id"], r["t"]) for r in back.collect()), key=str) == sorted(rows, key=str)
