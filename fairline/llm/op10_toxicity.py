"""Toxicity by noisy-channel deobfuscation.

Channel: a letter may have been written as a digit or sign that looks like it, repeated, or set apart by signs or spaces. A chunk
(what stands between white space) that shows none of this is its own restoration. Any other one is a lattice: for each run of equal
characters the letters it may stand for, once or twice, a word border, or nothing. Viterbi search finds the most probable path under
a trigram model of characters that is counted over the whole corpus. Single characters with spaces between are joined and decoded in
the same way.

Score: a feature says that a restored word, or a beginning of 3 to 9 letters of one, occurs 1, 2, 3 or 5 times at least, or that the
text has so many words. Features are added one after another to a logistic model, each time the one that improves the fit most. So
words that merely stand in copies of a toxic document win no weight once its toxic words have theirs. All features of the sample are
ranked by what they would improve: the best `batch` come to the fit, all others are ranked again under the model so found, and so on
until none outside the fit gains enough to be added.

Fitting takes a sample of labelled rows, `per_class` of each class as expected, chosen by a hash of the id; the bound is that parameter.
Null and empty texts have no features and get the score of documents without any. Repeated ids in labels count once, as toxic if any
is; null labels are left out. A text counts once in the fit, however many rows hold it, as toxic if any of them is. Without labels of both classes no feature is chosen, and the score is the share of toxic rows or 0.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Cache
from .common import forget, keep_rows, remainder, rows_of, rows_pass, settle

#: Signs and the letters that they stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
              "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "µ": "u"}
#: Signs set between letters to hide a word.
BETWEEN = "._-*~^'`#%&="
#: Letters of the character model: a-z, then ß to ÿ; any other letter is one class, everything else the border.
LETTERS = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(223, 256) if c != 247]
OTHER, SIZE = len(LETTERS) + 1, len(LETTERS) + 2
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: log10 costs of the channel: written plainly, as a look-alike, a run shortened, a sign dropped, a sign or a digit as a border.
PLAIN, LOOK, RUN, DROP, BORDER, KEEP = 0.0, -0.7, -0.4, -0.3, -0.7, -6.0


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of character trigrams over all texts: gram (index), n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        forget()
        lut = np.zeros(256, np.int64)
        for c, i in CODE.items():
            lut[ord(c)] = i
        total = np.zeros(SIZE ** 3, np.int64)
        for batch in batches:
            for (text,) in rows_of(batch):
                if not text:
                    continue
                code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
                x = np.where(code < 256, lut[np.minimum(code, 255)], np.where(code < 0x2000, OTHER, 0))
                x = np.concatenate([[0, 0], x, [0]])
                grams = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
                total += np.bincount(grams, minlength=SIZE ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])
    return docs.select(text_col).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """log10 P(c | a, b), interpolated; at most SIZE ** 3 counts."""

    def __init__(self, counts: list[tuple[int, int]]):
        import numpy as np
        c3 = np.zeros(SIZE ** 3)
        for g, n in counts:
            c3[g] = n
        c3 = c3.reshape(SIZE, SIZE, SIZE)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.logp = np.log10(p3).astype(np.float32).ravel().tolist()


def code_of(c: str) -> int:
    return CODE.get(c) or (OTHER if c.isalpha() else 0)


class Restorer:
    """Restored words of chunks and texts."""

    plain = re.compile(r"(.)\1\1", re.S).search
    hard = re.compile(r"[,;:/\\?\"“”„«»()\[\]{}<>]+")
    spaced = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)").finditer
    edge = "".join(BETWEEN) + ".,;:!?…\"“”„«»()[]{}<>/\\|’‘"
    signs = set(LOOKS_LIKE) | set(BETWEEN)

    def __init__(self, model: CharModel):
        self.logp = model.logp

    def chunk(self, chunk: str) -> list[str]:
        """Words restored from a chunk, lower-cased."""
        c = chunk.lower()
        core = c.strip(self.edge)
        if core.isalpha() and not self.plain(core):
            whole = [core]
            # a sign at the border may stand for a letter, as in a$$ or cl0wn!
            return whole if c == core or not any(x in LOOKS_LIKE for x in c.replace(core, "", 1)) else whole + [w for w in self.viterbi(c) if w != core]
        out = []
        for part in self.hard.split(c):
            if part.isalpha() and not self.plain(part):
                out.append(part)
            elif any(x.isalpha() for x in part):
                out += self.viterbi(part)
                out += [w for w in re.findall(r"[^\W\d_]{3,}", part) if w not in out]
        return out

    def viterbi(self, s: str) -> list[str]:
        logp = self.logp
        # states: the last two letters; value: score, index of the path's last node
        states: dict[int, tuple[float, int]] = {0: (0.0, -1)}
        nodes: list[tuple[int, str]] = []
        n, i = len(s), 0
        while i < n:
            c, j = s[i], i + 1
            while j < n and s[j] == c:
                j += 1
            run, i = j - i, j
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, PLAIN if run == 1 else 3 * RUN if run == 2 else RUN))
                if run == 2:
                    options.append((c * 2, PLAIN))
                elif run > 2:
                    options.append((c * 2, RUN))
            else:
                for x in LOOKS_LIKE.get(c, ""):
                    options.append((x, LOOK + RUN * (run > 1)))
                    if run > 1:
                        options.append((x * 2, LOOK + RUN * (run > 2)))
                if c in self.signs and not c.isdigit():
                    options.append(("", DROP))
                options.append((" ", KEEP if c.isdigit() else BORDER))
            after: dict[int, tuple[float, int]] = {}
            for state, (score, at) in states.items():
                for text, cost in options:
                    st, sc = state, score + cost
                    for x in text:
                        k = code_of(x)
                        sc += logp[st * SIZE + k]
                        st = (st % SIZE) * SIZE + k
                    if st not in after or sc > after[st][0]:
                        after[st] = (sc, len(nodes))
                        nodes.append((at, text))
            states = after
        best = max(states, key=lambda st: states[st][0] + logp[st * SIZE])
        at, out = states[best][1], []
        while at >= 0:
            at, text = nodes[at]
            out.append(text)
        return "".join(reversed(out)).split()

    def joined(self, text: str) -> list[str]:
        """Words out of single characters with spaces between."""
        return [w for m in self.spaced(text) for w in self.chunk(re.sub(r"\s", "", m[0])) if len(w) > 2]


def features(word: str) -> list[str]:
    return [word[:k] for k in range(3, min(len(word), 9) + 1)] + ([word + "$"] if len(word) > 2 else [])


def sample_labels(labels: DataFrame, per_class: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """One row an id, about `per_class` ids of each class, chosen by hash."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    sizes = {r["_y"]: r["count"] for r in one.groupBy("_y").count().collect()}
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, per_class / n))]) if sizes else None
    return one.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share[F.col("_y")] * (1 << 30)) if sizes else one


TIMES, WORDS = (1, 2, 3, 5), tuple(2 ** k for k in range(5, 16))


def tally(restorer: Restorer, cache: Cache, text: str | None) -> tuple[Counter, int]:
    """How often each feature occurs, and the number of chunks."""
    n: Counter = Counter()
    chunks = (text or "").split()
    for x in map(cache.__getitem__, chunks):
        if x:
            n.update(x)
    for w in restorer.joined(text or ""):
        n.update(features(w))
    return n, len(chunks)


def said(n: Counter, size: int) -> Iterator[str]:
    """Names of the features of a text: `word>times`, and `>words` for its length."""
    for f, k in n.items():
        for t in TIMES:
            if k >= t:
                yield f"{f}>{t}"
    for t in WORDS:
        if size >= t:
            yield f">{t}"


#: Added to the curvature of a feature; what a feature must gain to be added.
RIDGE, GAIN = 3.0, 8.0


def boost(rows: list[tuple], names: list[str], rounds: int = 1000, ridge: float = RIDGE, gain: float = GAIN) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of a logistic model by feature, "" for the intercept; rows: label and numbers of the features in it. Each round moves the
    weight of the feature that improves the fit most by a small step, so that words which occur together all come in; at last the weights
    of those that are in are fitted. Also gives the weights before that, under which no feature gained enough."""
    import numpy as np
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.concatenate([r[1] for r in rows]).astype(np.int64)
    order = np.argsort(col, kind="stable")
    by_col, edges = row[order], np.searchsorted(col[order], np.arange(len(names) + 1))
    inside: list[int] = []
    moved: Counter = Counter()
    start = float(np.log(y.mean() / (1 - y.mean())))
    z = np.zeros(len(rows))
    for _ in range(rounds):
        for _ in range(2):
            p = 1 / (1 + np.exp(-z - start))
            start += float(np.clip((y - p).sum() / ((p * (1 - p)).sum() + 1e-3), -1, 1))
        p = 1 / (1 + np.exp(-z - start))
        g = np.bincount(col, (y - p)[row], len(names))
        h = np.bincount(col, (p * (1 - p))[row], len(names)) + ridge
        won = g * g / h
        if not len(won) or won.max() < gain:
            break
        # of features that gain alike, the one whose name is longest says most exactly what it stands for
        k = int(max(np.flatnonzero(won >= won.max() * 0.999), key=lambda j: (len(names[j]), names[j])))
        if k not in inside:
            inside.append(k)
        step = float(np.clip(g[k] / h[k], -1, 1))
        moved[k] += step
        z[by_col[edges[k]:edges[k + 1]]] += step
    x = np.zeros((len(rows), len(inside) + 1))
    x[:, 0] = 1
    for j, k in enumerate(inside):
        x[by_col[edges[k]:edges[k + 1]], j + 1] = 1
    w, pull = np.zeros(len(inside) + 1), np.full(len(inside) + 1, 0.05)
    w[0], pull[0] = start, 1e-6
    for _ in range(50):                                                 # Newton steps with a weak pull to zero
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * w), -1, 1)
    return {"": float(w[0])} | {names[k]: float(v) for k, v in zip(inside, w[1:])}, {"": start} | {names[k]: moved[k] for k in inside}


def best_features(rows: DataFrame, chars, stage: dict, known: set):
    """f of all features outside `known` that gain enough under the model `stage`, best first."""
    held, one = rows.sparkSession.sparkContext.broadcast((stage, known)), 1 << 30

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math
        forget()
        restorer = Restorer(CharModel(chars.value))
        cache = Cache(lambda c: [f for w in restorer.chunk(c) for f in features(w)], 40_000)
        weights, inside = held.value
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def send():
            return pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())], names=["f", "g", "h"])
        for batch in batches:
            for text, y in rows_of(batch):
                found = list(said(*tally(restorer, cache, text)))
                z = weights[""] + math.fsum(weights.get(f, 0.0) for f in found)
                p = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
                g, h = round((y - p) * one), round(p * (1 - p) * one)               # whole numbers: sums do not depend on their order
                for f in found:
                    if f not in inside:
                        v = n[f]
                        v[0] += g
                        v[1] += h
                if len(n) > 60_000:
                    yield send()
                    n.clear()
        if n:
            yield send()

    seen = rows.mapInArrow(count, "f string, g bigint, h bigint").groupBy("f").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    g, h = F.col("g") / one, F.col("h") / one
    return seen.select("f", (g * g / (h + RIDGE)).alias("won")).where(F.col("won") >= GAIN).orderBy(F.desc("won"), F.desc(F.length("f")), "f")


def numbered(rows: DataFrame, chars, known: list[str]) -> DataFrame:
    """y, found: label of each row and the numbers of the known features in it."""
    import numpy as np
    names = rows.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(known)})

    def which():
        restorer = Restorer(CharModel(chars.value))
        stems = {f.rsplit(">", 1)[0] for f in names.value}
        cache = Cache(lambda c: [f for w in restorer.chunk(c) for f in features(w) if f in stems], 100_000)
        number = names.value
        return lambda text, y: (y, np.array(sorted(number[f] for f in said(*tally(restorer, cache, text)) if f in number), np.int32).tobytes())
    return rows_pass(rows, ["_t", "_y"], "y int, found binary", which)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, batch: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model: character counts of the corpus and weights of features. `batch`: features that come to the fit at a time."""
    import numpy as np
    spark = docs.sparkSession
    counts = [tuple(r) for r in char_counts(docs, text_col).collect()]          # at most SIZE ** 3 rows
    chars = spark.sparkContext.broadcast(counts)
    picked = sample_labels(labels, per_class, id_col, label_col)
    # the sample is bounded by per_class, so its ids may be broadcast; repeated ids count once
    rows = settle(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
                  .groupBy("_t").agg((F.max("_y") > 0).cast("int").alias("_y")).repartition(4 * spark.sparkContext.defaultParallelism), "labelled")
    totals = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    model = {"chars": counts, "weights": {"": -20.0 if not toxic else 20.0 if not clean else 0.0}}
    if not toxic or not clean:
        return model

    known, stage, fitted = {f">{t}" for t in WORDS}, {"": float(np.log(toxic / clean))}, False
    while True:
        new = {r["f"] for r in best_features(rows, chars, stage, known).limit(batch).select("f").collect()}
        if not new and fitted:
            return model
        known, fitted = known | new, True
        names = sorted(known)
        held = numbered(rows, chars, names).toLocalIterator()                       # 2 * per_class rows as expected
        held = sorted((r["y"], bytes(r["found"])) for r in held)
        model["weights"], stage = boost([(y, np.frombuffer(x, np.int32)) for y, x in held], names)


def scorer(model: dict):
    """The score of a text; built once a task."""
    import math
    forget()
    restorer = Restorer(CharModel(model["chars"]))
    weights = model["weights"]
    stems = {f.rsplit(">", 1)[0] for f in weights if f}
    cache = Cache(lambda c: tuple(f for w in restorer.chunk(c) for f in features(w) if f in stems))

    def score(text: str | None) -> float:
        z = weights[""] + math.fsum(weights.get(f, 0.0) for f in said(*tally(restorer, cache, text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
    return score


def score_rows(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(held.value)
        return lambda i, t: (i, score(t))
    return rows_pass(docs, [id_col, text_col], f"{id_col} {dict(docs.dtypes)[id_col]}, score double", make)


def report(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """Learn from rows outside the held-out fold, score all."""
    model = fit(docs, labels.where(remainder("doc_id", fold) != 0))
    return score_rows(docs, model).select("doc_id", (remainder("doc_id", fold) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fold: int = 5, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold, with all their columns. Learned as in `report`."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(remainder("doc_id", fold) != 0)))

    def make():
        score = scorer(held.value)
        return lambda text: score(text) < threshold
    return keep_rows(docs, "text", make)
