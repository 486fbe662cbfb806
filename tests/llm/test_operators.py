"""Each operator on nulls, empty and long texts, ties and repeated rows, empty tables and columns with clashing names, against plain
versions of itself."""
import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fairline.llm import op1_chat, op3_decontaminate, op4_lm, op5_winnow, op6_bpe, op7_language, op8_neardup, op9_tokens, op10_toxicity
from fairline.llm.queries import PROBE, tokenizer_path

SHORT = "the cat sat on the mat and the dog sat on the log near the old red barn by the river"
LONG = " ".join(f"word{i % 97} tail{i % 13}" for i in range(60_000))
TEXTS = [None, "", " ", SHORT, SHORT, SHORT.upper() + "!", "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", LONG, "日本語 <|endoftext|> 🙂  x\n\n y", "a"]
#: Names that the operators use inside, of other types.
def clash():
    return {c: F.lit(-1.5) for c in ("id", "digest", "ids", "hits", "items", "_t", "_y", "_id", "h", "i", "k", "score", "part", "n", "word", "rid", "found", "_text", "band")}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(TEXTS)] + [(3, SHORT, "en"), (None, SHORT + " again", None), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(clash()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())


# ---- 1

def test_chat_round_trip(spark):
    rows = [(1, 0, "user", PROBE), (1, 1, "assistant", PROBE), (1, 2, None, None), (1, None, "tool\n:", "### User:\n\\\\</turn>"), (1, 2, "assistant", "\n</turn>\n### Assistant:\nx\\"), (None, 1, "assistant", "a"), (2, 0, "assistant", LONG), (2, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns(clash()).repartition(2)
    parts = op1_chat.render_turns(df)
    got = {r["conv_id"]: r for r in op1_chat.read_back(parts).collect()}
    formatted = {r["conv_id"]: r["formatted"] for r in op1_chat.join_turns(parts).collect()}
    for conv in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, op1_chat.render(r[2], r[3])[0]))
        turns = [(r[2] or "", r[3] or "") for r in mine]
        assert [x[:2] for x in op1_chat.parse(formatted[conv])] == turns
        said = "".join(t for role, t in turns if role == "assistant")
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["formatted_chars"]) == (len(turns), len(said), len(formatted[conv]))
        assert got[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert op1_chat.read_back(op1_chat.render_turns(df.where("conv_id < 0"))).count() == 0


# ---- 3

@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_windows_of_the_benchmark(spark, docs, none, limit):
    items = [(1, SHORT), (2, "on the MAT and"), (3, "dog"), (4, None), (5, ""), (None, "quer über"), (7, "the cat sat on the mat and the dog sat"), (10, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: find((t or "").encode().lower().decode())
    pats = {(tuple(w[i:i + 10]), str(k) if k is not None else "null") for k, t in items for w in [low(t)] if w for i in range(max(1, len(w) - 9))}
    want = []
    for i, t in plain(docs):
        w, hit, names = low(t), set(), set()
        for p, k in pats:
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a:a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    names.add(k)
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in op3_decontaminate.report(docs, bench, limit=limit).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = op3_decontaminate.clean(docs, bench, limit=limit)
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    assert op3_decontaminate.report(none, bench).count() == 0
    assert op3_decontaminate.report(docs, bench.where("item_id < 0")).where("contaminated").count() == 0


# ---- 4

def test_lm_scores(spark, docs, none):
    train = docs.where("doc_id <> 6")
    count = Counter(w for i, t in plain(train) for w in words(t) + ["\n"])
    n, v = sum(count.values()), len(count)
    import math
    model = op4_lm.learn(train)
    got = op4_lm.score_texts(docs, model).collect()
    want = sorted((str(i), len(words(t)) + 1, sum(w in count for w in words(t) + ["\n"]), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t) + ["\n"]), 5)) for i, t in plain(docs))
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    # a bloom filter never forgets; without room for it or for frequent words, tables are joined and say the same but for its errors
    joined = op4_lm.score_texts(docs, op4_lm.learn(train, limit=0, head=3)).collect()
    assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in joined) == want
    a, b = (sorted((str(r["id"]), r["n_tokens"], r["score"]) for r in x) for x in (got, joined))
    assert all(x[2] < 0 and abs(x[2] - y[2]) <= 0.1 * x[1] for x, y in zip(a, b))
    assert op4_lm.report(none).count() == 0
    assert op4_lm.score_texts(docs, op4_lm.learn(none)).where("score > 0 OR n_known > 0").count() == 0


def test_op4_words_are_cut_as_bytes(spark):
    text = "ÀB\u00a0C\x1cD\tE\x0bF\x0cg\r\n  \u3000H \x85I É\u2028j"
    assert op4_lm.Words().tokens(text.encode()) == [w.encode() for w in ["Àb\u00a0c\x1cd", "e", "f", "g", "\u3000h", "\x85i", "É\u2028j", "\n"]]
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "e E É")], "doc_id long, text string")
    near, far = (op4_lm.score_texts(docs, op4_lm.learn(docs.where("doc_id < 4"), head=h)).orderBy("id").collect() for h in (1000, 2))
    assert [(r["n_tokens"], r["n_known"]) for r in near] == [(8, 8), (1, 1), (1, 1), (4, 3)]
    assert [(r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in far] == [(r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in near]


def test_levels_keep_small_counts():
    import numpy as np
    c = np.arange(1, 2000)
    back = op4_lm.middle(op4_lm.level(c))
    assert (back[:3] == c[:3]).all() and (np.abs(back - c) <= 0.25 * c + 0.5).all()


# ---- 5

def winnow(text, k, w):
    """Positions that winnowing chooses, by its definition; hashes are the operator's own."""
    h = text
    if not h:
        return []
    out = []
    for s in range(max(1, len(h) - w + 1)):
        window = h[s:s + w]
        low = min(window)
        p = s + max(j for j, x in enumerate(window) if x == low)
        if p not in out:
            out.append(p)
    return out


def test_fingerprints(spark, docs, none):
    prints = {(r["doc_id"], i): r for i, r in enumerate(op5_winnow.fingerprints(docs, 3, 4).collect())}
    every = op5_winnow.fingerprints(docs, 3, 1).collect()
    for (doc, i), r in prints.items():
        all_hashes = [h for _, h in sorted(zip(every[i]["positions"], every[i]["hashes"]))]
        assert every[i]["doc_id"] == doc and sorted(r["positions"]) == sorted(winnow(all_hashes, 3, 4))
        assert [all_hashes[p] for p in r["positions"]] == list(r["hashes"])
    rows = op5_winnow.report(docs).collect()
    by = {}
    for i, t in plain(docs):
        by.setdefault(i, []).append(t or "")
    ids = sorted((i for i in by if i is not None), reverse=True) + [None]
    want = []
    for at, i in enumerate(ids):
        nxt = min(by[ids[(at + 1) % len(ids)]])
        for t in by[i]:
            half = len(t) // 2
            want.append((i, len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert op5_winnow.report(none).count() == 0


# ---- 6, 9

def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer
    import struct
    t = Tokenizer.from_file(tokenizer_path())
    rows = plain(docs)
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    want = [(i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids]
    assert sorted(map(tuple, op6_bpe.digests(docs, tokenizer_path()).collect()), key=str) == sorted(want, key=str)
    enc = op6_bpe.encode(docs.select("doc_id", "text"), tokenizer_path())
    assert sorted((r["text"] for r in op6_bpe.decode(enc, tokenizer_path()).collect()), key=str) == sorted((x or "" for _, x in rows), key=str)
    back = op9_tokens.round_trip(spark, docs, tokenizer_path(), 2).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in back if r["doc_id"] is not None) == sorted((i, len(x) + 1, zlib.crc32(struct.pack(f"<{len(x) + 1}I", *x, 2))) for i, x in ids if i is not None)
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert op6_bpe.digests(none, tokenizer_path()).count() == 0 and op9_tokens.round_trip(spark, none, tokenizer_path(), 2).count() == 0


def test_backtracking_equals_merging():
    import random
    import struct
    from tokenizers import Tokenizer
    from fairline.llm.bpe import Backtracking
    t, b, rng = Tokenizer.from_file(tokenizer_path()), Backtracking(tokenizer_path()), random.Random(3)
    letters = list("aab  e the\n\t\r'sldvremt.,!?#$%0129éèñüß中文🙂　​\x1c") + ["<|endoftext|>", "  ", "'ll", " the", "ing"]
    for _ in range(4000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = t.encode(x, add_special_tokens=False).ids
        assert b.encode(x) == struct.pack(f"<{len(ids)}I", *ids), x
        assert b.decode(b.encode(x)) == t.decode(ids, skip_special_tokens=False)


def test_records_in_any_order_and_damage(spark, docs, tmp_path):
    folder = str(tmp_path / "records")
    index = op9_tokens.write_tokens(docs, folder, tokenizer_path(), 2).collect()
    from tokenizers import Tokenizer
    t, by = Tokenizer.from_file(tokenizer_path()), dict(plain(docs.where("doc_id <> 3")))
    for r in reversed(index):
        if r["id"] in by and r["id"] is not None:
            assert op9_tokens.read_record(folder, r["file"], r["offset"], r["size"]).tolist() == t.encode(by[r["id"]] or "", add_special_tokens=False).ids + [2]
    r = max(index, key=lambda r: r["size"])
    path = f"{folder}/{r['file']}"
    data = bytearray(open(path, "rb").read())
    data[r["offset"] + 40] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        op9_tokens.read_record(folder, r["file"], r["offset"], r["size"])


# ---- 7

def test_forward_backward_equals_enumeration():
    import itertools
    import numpy as np
    rng = np.random.default_rng(1)
    e, t, begins = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([1, 0, 0, 0, 1, 0, 0], bool)
    p, pair = op7_language.marginals(e, begins, t, True)
    one, two, z = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=7):
        w = np.exp(sum(e[i, y[i]] for i in range(7)) + sum(t[y[i - 1], y[i]] for i in range(1, 7) if not begins[i]))
        z += w
        for i in range(7):
            one[i, y[i]] += w
            if not begins[i]:
                two[y[i - 1], y[i]] += w
    assert np.allclose(p, one / z) and np.allclose(pair, two / z)


def test_language(spark, docs, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in op7_language.report(docs).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= got and len(got) == len(TEXTS) + 2
    assert op7_language.report(none).count() == 0 and {r["lang_pred"] for r in op7_language.predict(docs, None).collect()} == {"und"}
    assert op7_language.drop_unclear(docs).columns == docs.columns
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = op7_language.report(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r["a"] > 0.98


def test_switches_inside_a_text():
    m = op7_language.train([("the cat and the dog of this house with that " * 5, "en"), ("der hund und die katze von dem haus mit der " * 5, "de")], epochs=20)
    import numpy as np
    w = "the dog and the house der hund und die katze".split()
    p, _ = op7_language.marginals(m.emissions(w).astype(float), np.array([True] + [False] * 9), m.trans)
    assert [m.labels[k] for k in p.argmax(1)] == ["en"] * 5 + ["de"] * 5


# ---- 8

def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_by_hand(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, len(sets[k]), low.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates(spark, docs, none, block):
    import random
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    near = []
    for k in range(60):                                                    # a chain and a cloud of near copies
        w = list(near[-1][1].split() if k % 3 and near else base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        near.append((100 + k, " ".join(w)))
    more = spark.createDataFrame([(i, t, "en") for i, t in near], "doc_id bigint, text string, lang string").withColumns(clash())
    both = docs.unionByName(more).repartition(5)
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in op8_neardup.components(both, block=block).collect()), key=str)
    assert got == components_by_hand(plain(both))
    if block > 7:
        kept = op8_neardup.drop_near(both, 85, 100, 0.72)
        assert kept.columns == both.columns
        ids = Counter(r["doc_id"] for r in kept.collect())
        assert ids[3] == 1 and ids[4] == 0 and ids[0] == 1 and all(n == 1 for i, n in ids.items() if i is not None)
        assert op8_neardup.report(none).count() == 0


# ---- 10

def test_restored_words():
    chars = Counter()
    for t in [SHORT, "an idiot and a moron are stupid losers in this house of clowns"] * 50:
        code = [0, 0] + [op10_toxicity.code_of(c) for c in t] + [0]
        for a, b, c in zip(code, code[1:], code[2:]):
            chars[(a * op10_toxicity.SIZE + b) * op10_toxicity.SIZE + c] += 1
    r = op10_toxicity.Restorer(op10_toxicity.CharModel(list(chars.items())))
    for written, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("st*u*p1d", "stupid"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("stupid", "stupid"), ("MORON!", "moron")):
        assert meant in r.chunk(written), (written, r.chunk(written))
    assert "idiot" in r.joined("what an i d i o t here") and r.chunk("192.168.1.1") == [] and r.chunk("") == []


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(3, 0, 1), (3, 1, 0), (None, 1, 1), (4, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = op10_toxicity.report(docs, labels).collect()
    assert len(rows) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert op10_toxicity.report(none, labels).count() == 0 and op10_toxicity.report(docs, labels.where("doc_id < 0")).where("predicted = 1").count() == 0
    assert op10_toxicity.drop_toxic(docs, labels.where("doc_id < 0")).columns == docs.columns
    real, truth = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    seen = {(r["toxic"], r["predicted"]): r["count"] for r in op10_toxicity.report(real, truth).where("held_out").join(truth, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert seen[1, 1] / (seen[1, 1] + seen.get((1, 0), 0)) > 0.8 and seen.get((0, 1), 0) / seen[0, 0] < 0.02
