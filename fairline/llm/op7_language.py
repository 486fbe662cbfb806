"""Language identification by a linear-chain conditional random field over words.

Each word is labelled with a language; features of a word are its beginnings and ends of 1 to 4 letters, its n-grams of 2 and 3 letters and the word itself
(lexicon). Their weights live in a table of 2 ** BITS hashed rows. Transition weights between labels are learned too. Marginal
probabilities come from forward-backward; a text's label is the one with the largest sum of marginals, its score that sum's share.

Many texts are labelled at once as one sequence with cuts at the borders. The sequence is dealt into blocks: all blocks first get
their transfer matrix, the matrices are chained, then all blocks run forward and backward side by side. That is exact and
needs no padding.

A run of letters without a break is read whole: beyond PIECE letters it is cut into consecutive pieces, each a position of the chain like a
word. In scripts that are written without spaces each letter is a position.

Training takes a sample of labelled rows: about `per_class` rows of each label, chosen by a hash of the id. Of a text of more than `longest`
code points it takes a stretch of that length, whose place the hash chooses; both are parameters. Training sequences mix pieces of texts of different labels, so that switches are seen.

A null text or one without letters is `und` with score 0. Repeated rows give a row each. With no labelled row all is `und`. Rows whose
label is null teach nothing.
"""
from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import once, remainder

BITS, FEATURES = 18, 58
#: Most letters of a position of the chain.
PIECE = 24
#: Scripts without spaces: Thai to Tibetan, Myanmar, Khmer, kana, ideographs.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


class Words:
    """Finds words of lower-cased texts. Numerals such as a half or a square count as word characters for patterns but are no letters;
    they are blanked first, since a pattern that leaves them out would compare each letter with hundreds of signs."""
    run = re.compile(rf"[^\W\d_{UNSPACED}]{{1,{PIECE}}}|[^\W\d_]")

    def __init__(self):
        codes = [k for k in range(128, sys.maxunicode + 1) if chr(k).isalnum() and unicodedata.category(chr(k))[0] == "N"]
        first = [k for j, k in enumerate(codes) if not j or codes[j - 1] != k - 1]
        last = [k for j, k in enumerate(codes) if j + 1 == len(codes) or codes[j + 1] != k + 1]
        self.numeral = re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(first, last)) + "]")

    def findall(self, text: str) -> list[str]:
        return self.run.findall(text if text.isascii() else self.numeral.sub(" ", text))


WORD = Words()
#: Words in a forward-backward run; more are done in the next run.
RUN = 200_000


def word_features(words: list[str]):
    """Hashed rows of the words' features, (words, FEATURES); row 2 ** BITS stands for none. Words are of PIECE letters at most, as
    WORD finds them."""
    import numpy as np
    c = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE)
    n = (c != 0).sum(1)
    b = np.zeros((len(words), 27), np.uint32)                 # <word> and an empty place
    b[:, 0] = 60
    b[:, 1:25] = c
    b[np.arange(len(words)), n + 1] = 62
    none = np.uint32(1 << BITS)

    def row(h, salt, there):
        h = (h ^ np.uint32(salt)) * np.uint32(2654435761)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        return np.where(there, (h ^ (h >> np.uint32(13))) & np.uint32((1 << BITS) - 1), none)
    mul = np.uint32(16777619)
    out = np.empty((len(words), FEATURES), np.uint32)
    whole = np.zeros(len(words), np.uint32)
    for k in range(24):
        whole = whole * mul + c[:, k]
    out[:, 0] = row(whole, 1, True)
    head, tail = np.zeros(len(words), np.uint32), np.zeros(len(words), np.uint32)
    rows = np.arange(len(words))
    for k in range(4):
        head = head * mul + c[:, k]
        out[:, 1 + k] = row(head, 11 + k, n > k)
        tail = tail * mul + c[rows, np.maximum(n - 1 - k, 0)]
        out[:, 5 + k] = row(tail, 21 + k, n > k)
    at = np.arange(25)
    out[:, 9:34] = row(b[:, :25] * mul + b[:, 1:26], 31, at[None] < n[:, None] + 1)
    out[:, 34:58] = row((b[:, :24] * mul + b[:, 1:25]) * mul + b[:, 2:26], 41, at[None, :24] < n[:, None])
    return out


def marginals(emit, begins, trans, pairs: bool = False):
    """Label probabilities of each word, given scores emit (n, L), whether each word begins a text, and transition scores (L, L);
    with `pairs` also the sum of pair probabilities within texts (L, L)."""
    import numpy as np
    n, L = emit.shape
    top = emit.max(1)
    e = np.exp(emit - top[:, None])
    A = np.exp(trans - trans.max())
    m = max(1, int(n ** 0.5) // 2)
    B = -(-n // m)
    pad = B * m - n
    if pad:
        e = np.concatenate([e, np.ones((pad, L))])
        begins = np.concatenate([begins, np.ones(pad, bool)])
    # time first: what all blocks need at a step lies together
    e = np.ascontiguousarray(e.reshape(B, m, L).swapaxes(0, 1))
    cut = np.ascontiguousarray(begins.reshape(B, m).T)
    some = cut.any(1)

    # transfer of each block: product over its words of step matrix times emission; over a border nothing is carried but the mass
    M = np.broadcast_to(np.eye(L), (B, L, L)).copy()
    for t in range(m):
        new = (M.reshape(B * L, L) @ A).reshape(B, L, L)
        if some[t]:
            new[cut[t]] = M[cut[t]].sum(2, keepdims=True)
        M = new * e[t][:, None, :]
        if t % 4 == 3:
            M /= M.sum((1, 2), keepdims=True)
    into, out = np.empty((B, L)), np.empty((B, L))
    v = np.full(L, 1 / L)
    for b in range(B):
        into[b] = v
        v = v @ M[b]
        v /= v.sum()
    v = np.ones(L)
    for b in range(B - 1, -1, -1):
        out[b] = v
        v = M[b] @ v
        v /= v.sum()
    # all blocks forward, then backward
    alpha, beta, scale = np.empty((m, B, L)), np.empty((m, B, L)), np.empty((m, B))
    a = into
    for t in range(m):
        new = a @ A
        if some[t]:
            new[cut[t]] = 1
        new *= e[t]
        scale[t] = new.sum(1)
        a = alpha[t] = new / scale[t][:, None]
    z = out
    for t in range(m - 1, -1, -1):
        beta[t] = z / z.sum(1, keepdims=True)
        x = e[t] * beta[t]
        z = x @ A.T
        if some[t]:
            z[cut[t]] = x[cut[t]].sum(1, keepdims=True)
    alpha, beta, e = (np.ascontiguousarray(x.swapaxes(0, 1)).reshape(B * m, L) for x in (alpha, beta, e))
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    if not pairs:
        return p[:n], None
    inner = np.flatnonzero(~begins)
    inner = inner[inner > 0]
    pair = alpha[inner - 1][:, :, None] * A[None] * (e[inner] * beta[inner])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return p[:n], pair.sum(0)


class Model:
    def __init__(self, labels: list[str], weights, trans):
        self.labels, self.weights, self.trans = labels, weights, trans
        self.key = uuid.uuid4().hex

    def emissions(self, words: list[str]):
        """Scores (words, labels)."""
        return self.weights[word_features(words)].sum(1)


def train(texts: list[tuple[str, str]], epochs: int = 6, rate: float = 0.2, batch: int = 20_000) -> Model | None:
    """Fit by AdaGrad on the log-likelihood of training sequences made of pieces of 3 to 40 words."""
    import numpy as np
    labels = sorted({y for _, y in texts})
    if not labels:
        return None
    rng = np.random.default_rng(7)
    index: dict[str, int] = {}
    pieces = []
    for text, y in sorted(texts):
        w = [index.setdefault(x, len(index)) for x in WORD.findall(text.lower())]
        k = 0
        while k < len(w):
            size = int(rng.integers(3, 41))
            pieces.append((labels.index(y), w[k:k + size]))
            k += size
    if not pieces:
        return None
    feats = word_features(list(index)).astype(np.int64)
    L = len(labels)
    W, T = np.zeros(((1 << BITS) + 1, L)), np.zeros((L, L))
    GW, GT = np.full(W.shape, 1e-6), np.full(T.shape, 1e-6)
    for _ in range(epochs):
        rng.shuffle(pieces)
        at = 0
        while at < len(pieces):
            words, y, begins, run = [], [], [], 0
            while at < len(pieces) and len(words) < batch:
                lab, w = pieces[at]
                begins += [run == 0] + [False] * (len(w) - 1)          # four pieces make a sequence
                words += w
                y += [lab] * len(w)
                run, at = (run + 1) % 4, at + 1
            words, y, begins = np.array(words), np.array(y), np.array(begins)
            used, inverse = np.unique(words, return_inverse=True)
            rows = feats[used]
            E = W[rows].sum(1)
            p, pair = marginals(E[inverse], begins, T, True)
            d = -p
            d[np.arange(len(y)), y] += 1
            by_word = np.stack([np.bincount(inverse, d[:, k], len(used)) for k in range(L)], 1)
            flat = rows.ravel()
            g = np.stack([np.bincount(flat, np.repeat(by_word[:, k], FEATURES), len(W)) for k in range(L)], 1) / len(y) * 100
            g = np.where(g != 0, g - 1e-3 * W, 0)
            g[-1] = 0
            GW += g * g
            W += rate * g / np.sqrt(GW)
            inner = np.flatnonzero(~begins)
            real = np.bincount(y[inner - 1] * L + y[inner], minlength=L * L).reshape(L, L)
            g = (real - pair) / len(y) * 100 - 1e-3 * T
            GT += g * g
            T += rate * g / np.sqrt(GT)
    return Model(labels, W.astype(np.float32), T)


def labeller(model: Model | None):
    """A function from texts to (label, score) of each."""
    import numpy as np
    if model is None:
        return lambda texts: [("und", 0.0) for _ in texts]
    L = len(model.labels)
    state = {"table": np.empty((1 << 16, L), np.float32), "slots": {}}

    def learn(words: list[str]) -> None:
        slots, have = state["slots"], len(state["slots"])
        if have + len(words) > len(state["table"]):
            state["table"] = np.concatenate([state["table"], np.empty((max(have, len(words)), L), np.float32)])
        for at in range(0, len(words), 8192):
            part = words[at:at + 8192]
            state["table"][have + at:have + at + len(part)] = model.emissions(part)
        slots.update(zip(words, range(have, have + len(words))))

    def label(texts):
        if len(state["slots"]) > 200_000:
            state["slots"], state["table"] = {}, np.empty((1 << 16, L), np.float32)
        out, todo = [("und", 0.0)] * len(texts), []
        held: list = []

        def close():
            if not todo:
                return
            size = np.array([n for _, n in todo])
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            ids = np.concatenate(held)
            begins = np.zeros(len(ids), bool)
            begins[starts] = True
            p, _ = marginals(state["table"][ids].astype(np.float64), begins, model.trans)
            for (total, _), s in zip(todo, np.add.reduceat(p, starts, axis=0)):
                total += s
            todo.clear()
            held.clear()
        found = [(i, w) for i, w in ((i, WORD.findall(t.lower())) for i, t in enumerate(texts) if t) if w]
        slots = state["slots"]
        if new := set().union(*(w for _, w in found)).difference(slots):
            learn(list(new))
        totals, size = {i: np.zeros(L) for i, _ in found}, 0
        for i, words in found:
            for at in range(0, len(words), RUN):                      # a text of more words is labelled in runs of that many
                part = words[at:at + RUN]
                held.append(np.fromiter(map(slots.__getitem__, part), np.int64, len(part)))
                todo.append((totals[i], len(part)))
                size += len(part)
                if size >= RUN:
                    close()
                    size = 0
        close()
        for i, t in totals.items():
            b = int(t.argmax())
            out[i] = model.labels[b], float(min(1.0, max(0.0, t[b] / t.sum())))
        return out
    return label


def worker_labeller(model: Model | None):
    """The labeller of a model, with the words that it knows, kept for later tasks of the worker."""
    return once(("language", model and model.key), lambda: labeller(model))


def fit(docs: DataFrame, per_class: int = 300, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Train on the driver on a sample of at most about per_class rows of each label."""
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("t"), F.col(label_col).alias("y"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)).alias("h"))
    # by the text alone, so that copies give the same stretch
    start = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - longest, F.lit(0)) + 1).cast("int") + 1
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, per_class / n) * (1 << 30))])
    # copies count once: they say nothing new
    held = rows.where(F.col("h") < share[F.col("y")]).select(F.substring("t", start, F.lit(longest)).alias("t"), "y").distinct()
    return train([(r["t"], r["y"]) for r in held.toLocalIterator()])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.sparkSession.createDataFrame([], f"{id_col} {dict(docs.dtypes)[id_col]}, lang_pred string, score double").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = worker_labeller(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def report(docs: DataFrame, fold: int = 3) -> DataFrame:
    """Learn outside the held-out fold, predict all."""
    out = remainder("doc_id", fold) == 1
    return predict(docs, fit(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def drop_unclear(docs: DataFrame, fold: int = 3, least: float = 0.4) -> DataFrame:
    """Documents with a language: not `und`, and at least that share of one language. All their columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs.where(remainder("doc_id", fold) != 1)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = worker_labeller(held.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array([y != "und" and s >= least for y, s in label(part.column(at).to_pylist())], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
