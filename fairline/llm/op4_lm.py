"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and of pairs of neighbouring words over the training texts are quantised to levels, 1 + floor(log_base(count)), and a
key of count level q is put into a Bloom filter q times, as (key, 1) to (key, q). A count is read by probing (key, 1), (key, 2) and so
on until a probe fails; the level gives back the middle of the counts that share it. So a count is never read too low, and too high
by j levels with a probability that falls by the filter's error rate each time.

P(word | previous) mixes the pair's share of the previous word, with weight 1 - `lam`, and the word's own probability, with weight
`lam`; word counts are smoothed by adding one for each of V + 1 words. After an unseen word only its own probability counts. N and V
are exact. A text starts after a border and ends with an end token.

The filter is cut into shards by hash, each built by one task out of the keys dealt to it; it grows with the corpus, PER_KEY bits for
each training token. Up to `limit` bytes it is broadcast. Beyond that the shards stay in the shared folder, and keys go to their shard:
each key that any text asks for is sent once to the task that holds its shard's cells and is probed there, and the levels read go back
to the texts' pairs by key. So scores are the same at every size, the filter's errors included.

The base score needs exact word counts. The most frequent words, at most `head` of them, are broadcast with their counts; all other
words, rare by definition, are joined by key.

Null and empty texts have only their end token. Repeated rows and ids give a row each, and each counts in training. Without training
texts every count is 0. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import once, remainder, settle
from .op8_neardup import mix

END = b"\n"                                   # no word holds white space, so this is none
BASE, PER_KEY, PROBES = 1.5, 8, 4
#: Tokens whose keys a shard is built for.
SHARD = 1 << 20
BEGIN = 0x5851F42D4C957F2D


def level(count):
    """Level of a count: 1 + floor(log_BASE(count))."""
    import numpy as np
    return 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def middle(levels):
    """Count that stands for a level, 0 for level 0."""
    import numpy as np
    q = np.arange(int(levels.max(initial=0)) + 1)
    low, high = np.ceil(BASE ** (q - 1.0) - 1e-9), np.ceil(BASE ** q - 1e-9) - 1
    value = np.where(q > 0, (low + np.maximum(high, low)) / 2, 0.0)
    return value[levels]


def utf8(column) -> list[bytes | None]:
    """Texts of an Arrow column as they lie there."""
    return column.cast(pa.binary()).to_pylist()


class Words:
    """Hashes of words, kept for words that come again. Words are bytes in UTF-8, cut and lower-cased without decoding a text."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[bytes, int] = {END: 0x1234567}
        self.limit = limit

    def tokens(self, text: bytes | None) -> list[bytes]:
        out = text.lower().split() if text else []       # of bytes: A-Z alone, and \x20 and \x09-\x0D alone
        out.append(END)
        return out

    def hashes(self, words: list[bytes]):
        import numpy as np
        import xxhash
        if len(self.known) > self.limit:
            self.known = {END: 0x1234567}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class WordTable(Words):
    """What scoring needs of each word, looked up once: hash, exact count (-1: not among the frequent), count by the filter."""

    def __init__(self, frequent: dict, whole: bool, bloom, limit: int = 500_000):
        super().__init__(limit)
        self.frequent, self.missing, self.bloom = frequent, 0 if whole else -1, bloom
        self.clear()

    def clear(self) -> None:
        import numpy as np
        self.known = {}
        self.hash, self.count, self.alone = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)

    def slots(self, words: list[bytes]):
        import numpy as np
        if len(self.known) > self.limit:
            self.clear()
        new = list(set(words).difference(self.known))
        if new:
            have = len(self.known)
            h = Words().hashes(new)
            if have + len(new) > len(self.hash):
                grow = max(have, len(new), 1 << 16)
                self.hash, self.count, self.alone = (np.concatenate([x, np.empty(grow, x.dtype)]) for x in (self.hash, self.count, self.alone))
            here = slice(have, have + len(new))
            self.hash[here] = h
            self.count[here] = [self.frequent.get(w, self.missing) for w in new]
            self.alone[here] = middle(self.bloom.levels(mix(h))) if self.bloom is not None else 0.0
            self.known.update(zip(new, range(have, have + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def pair_keys(h):
    """Keys of each word with the one before it; the first comes after the border."""
    import numpy as np
    before = np.concatenate([[np.uint64(BEGIN)], h[:-1]])
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(1))


def count_words(train: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all training texts, counted in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        find, n = Words().tokens, Counter()

        def send():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in utf8(batch.column(0)):
                n.update(find(text))
                if len(n) > 400_000:
                    yield send()
                    n.clear()
        if n:
            yield send()
    return train.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def count_keys(train: DataFrame, words: DataFrame, text_col: str) -> DataFrame:
    """(key, n) of pairs, summed up in each task as far as its memory goes, and of words; a key may come more than once."""
    def send(keys):
        import numpy as np
        k, n = np.unique(keys, return_counts=True)
        for at in range(0, len(k), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(k[at:at + (1 << 17)].view(np.int64)), pa.array(n[at:at + (1 << 17)])], names=["key", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        find, held, size = Words(), [], 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                h = find.hashes(find.tokens(text))
                held.append(pair_keys(h))
                size += len(h)
                if size > 4_000_000:
                    yield from send(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from send(np.concatenate(held))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(Words().hashes(utf8(batch.column(0)))).view(np.int64)), batch.column(1)], names=["key", "n"])
    kind = "key bigint, n bigint"
    return train.select(text_col).mapInArrow(pairs, kind).unionByName(words.select("word", "n").mapInArrow(alone, kind))


def shard_of(keys, shards: int):
    """Shard of a key, by its upper bits."""
    import numpy as np
    return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def halves(keys, q: int):
    """Two 32-bit halves of the hash of (key, q)."""
    import numpy as np
    x = mix(keys + np.uint64(q * 0xD6E8FEB86659FD93 % (1 << 64)))
    return x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)


def place(low, high, probe: int, bits: int):
    """Place of a probe in a shard of fewer than 2 ** 32 bits."""
    import numpy as np
    return (((low + np.uint64(probe) * high) & np.uint64(0xFFFFFFFF)) * np.uint64(bits)) >> np.uint64(32)


def filter_shards(keys: DataFrame, shards: int, bits: int) -> DataFrame:
    """shard, cells (bits of the shard) from (key, n), each shard by one task."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        key, of = np.unique(np.concatenate([k for k, _ in held]).view(np.uint64), return_inverse=True)
        q = level(np.bincount(of, np.concatenate([n for _, n in held])))
        where = shard_of(key, shards)
        for shard in np.unique(where):
            mine = where == shard
            cells = np.zeros(bits, np.uint8)
            for j in range(1, int(q[mine].max()) + 1):
                low, high = halves(key[mine & (q >= j)], j)
                for probe in range(PROBES):
                    cells[place(low, high, probe, bits)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int32()), pa.array([np.packbits(cells).tobytes()], pa.binary())], names=["shard", "cells"])
    where = F.pmod(F.shiftrightunsigned("key", 40), F.lit(shards)).cast("int")
    return keys.repartition(shards, where).mapInArrow(build, "shard int, cells binary")


class Filter:
    def __init__(self, shards: int, bits: int, cells):
        self.shards, self.bits, self.width, self.cells = shards, bits, bits // 8, cells

    def levels(self, keys):
        """Level of each key, by probing until a probe fails."""
        import numpy as np
        out = np.zeros(len(keys), np.int64)
        left, q = np.arange(len(keys)), 0
        base = shard_of(keys, self.shards) * self.width
        while len(left):
            q += 1
            low, high = halves(keys[left], q)
            where = base[left]
            for probe in range(PROBES):                                 # most keys that are not there end at the first probe
                at = place(low, high, probe, self.bits).astype(np.int64)
                hit = ((self.cells[where + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)
                left, low, high, where = left[hit], low[hit], high[hit], where[hit]
            out[left] = q
        return out


def probe(asked: DataFrame, cells: DataFrame, shards: int, bits: int) -> DataFrame:
    """(key, q) for each of the keys asked for, read from its shard; a task holds one shard at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        held, of = None, -1
        for batch in batches:
            shard, key = batch.column(0).to_numpy(), batch.column(1)
            border = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() + [len(shard)]
            for begin, end in zip(border, border[1:]):
                if shard[begin] != of:                                  # the cells come before the shard's keys
                    held, of = np.frombuffer(batch.column(2)[begin].as_py(), np.uint8), shard[begin]
                    begin += 1
                if begin < end:
                    k = key.slice(begin, end - begin)
                    q = Filter(1, bits, held).levels(k.to_numpy(zero_copy_only=False).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([k, pa.array(q)], names=["key", "q"])
    where = F.pmod(F.shiftrightunsigned("key", 40), F.lit(shards)).cast("int")
    keys = asked.select(where.alias("shard"), "key", F.lit(None).cast("binary").alias("cells"))
    # a shard whose keys were all empty was not built: its cells are zeros
    empty = F.lit(bytes(bits // 8))
    built = asked.select(where.alias("shard")).distinct().join(cells, "shard", "left").select("shard", F.lit(None).cast("bigint").alias("key"), F.coalesce("cells", empty).alias("cells"))
    return built.unionByName(keys).repartition("shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first()).mapInArrow(run, "key bigint, q bigint")


def log_score(pair, alone, before, n_tokens: int, n_words: int, lam: float):
    """log10 P of each word, from the counts of the pair, of the word and of the word before."""
    import numpy as np
    word = (alone + 1) / (n_tokens + n_words + 1)
    share = np.minimum(pair, before) / np.maximum(before, 1e-9)
    return np.log10(np.where(before > 0, (1 - lam) * share + lam * word, word))


def learn(train: DataFrame, text_col: str = "text", limit: int = 256 << 20, head: int = 500_000) -> dict:
    """What scoring needs: N, V, number of texts, exact counts of the most frequent words and the table of all, and the filter:
    its cells, or beyond `limit` bytes the table of its shards."""
    import numpy as np
    words = settle(count_words(train, text_col), "words")
    step = F.floor(F.log("n") * 20).cast("int")
    sizes = words.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()      # a row for each 5 %
    v, total, least = sum(r["v"] for r in sizes), sum(r["n"] for r in sizes), 0
    have = 0
    for r in sizes:
        have += r["v"]
        if have > head:
            break
        least = r["least"]
    whole = have <= head
    frequent = {r["word"].encode(): r["n"] for r in words.where(F.col("n") >= (least or 1 << 62)).select("word", "n").toLocalIterator()} if sizes else {}
    ends = words.where(F.col("word") == END.decode()).first()
    shards = max(1, -(-total // SHARD))
    bits = -(-PER_KEY * (total + v) // shards // 64) * 64 + 64
    model = {"N": total, "V": v, "starts": ends["n"] if ends else 0, "frequent": frequent, "whole": whole, "least": least, "words": words, "shards": shards, "bits": bits, "cells": None, "filter": None}
    built = filter_shards(count_keys(train, words, text_col), shards, bits)
    if shards * bits // 8 <= limit:
        cells = np.zeros((shards, bits // 8), np.uint8)
        for r in built.toLocalIterator():          # `limit` bytes at most
            cells[r["shard"]] = np.frombuffer(r["cells"], np.uint8)
        model["cells"] = cells.ravel()
    else:
        model["filter"] = settle(built, "filter")
    return model


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", lam: float = 0.8) -> DataFrame:
    """id, n_tokens, n_known, base_score, score for each row."""
    import uuid
    spark, n_all, v_all, starts = docs.sparkSession, model["N"], model["V"], model["starts"]
    held = spark.sparkContext.broadcast({k: model[k] for k in ("frequent", "whole", "shards", "bits", "cells")})
    name, joined = uuid.uuid4().hex, model["cells"] is None
    schema = spark.createDataFrame([], f"rid bigint, id {dict(docs.dtypes)[id_col]}, n_tokens bigint, known bigint, base double, score double, rare array<struct<word: string, n: bigint>>, "
                                       "pairs array<struct<pair: bigint, word: bigint, before: bigint, n: bigint>>").schema
    norm = math.log10(n_all + v_all + 1)

    def tables():
        m = held.value
        return WordTable(m["frequent"], m["whole"], None if joined else Filter(m["shards"], m["bits"], m["cells"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from collections import Counter
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        words = once(("lm", name), tables)
        bloom = words.bloom
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [words.tokens(t) for t in utf8(part.column(2))]
                size = np.array([len(t) for t in texts])
                flat = [w for t in texts for w in t]
                begin = np.concatenate([[0], np.cumsum(size)[:-1]])
                slot = words.slots(flat)
                c, h = words.count[slot], words.hash[slot]
                rare = [[] for _ in texts]
                at_rare = np.flatnonzero(c < 0)
                for k, r in zip(at_rare.tolist(), (np.searchsorted(begin, at_rare, "right") - 1).tolist()):
                    rare[r].append(flat[k])
                base = np.add.reduceat(np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0) - norm, 0), begin)
                known = np.add.reduceat((c > 0).astype(np.int64), begin)
                before = np.concatenate([h[:1], h[:-1]])
                before[begin] = np.uint64(BEGIN)
                pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(1))
                score, pairs = np.zeros(len(texts)), None
                if bloom is not None:
                    alone = words.alone[slot]
                    prev = np.concatenate([[0.0], alone[:-1]])
                    prev[begin] = starts
                    score = np.add.reduceat(log_score(middle(bloom.levels(pair)), alone, prev, n_all, v_all, lam), begin)
                else:
                    pairs, single = [], mix(h)
                    for b, n in zip(begin, size):
                        p, first, times = np.unique(pair[b:b + n], return_index=True, return_counts=True)
                        pairs.append([{"pair": int(x), "word": int(single[b + f].view(np.int64)), "before": int(mix(h[b + f - 1:b + f])[0].view(np.int64)) if f else None, "n": int(t)}
                                      for x, f, t in zip(p.view(np.int64), first, times)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(known), pa.array(base), pa.array(score),
                                                  pa.array([[{"word": w, "n": k} for w, k in Counter(x).items()] for x in rare], arrow.field("rare").type),
                                                  pa.array(pairs if pairs is not None else [None] * len(texts), arrow.field("pairs").type)], schema=arrow)
    rows = settle(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col), F.col(text_col)).mapInArrow(run, schema), "scored")
    out = rows.select("rid", "id", "n_tokens", F.col("known").alias("n_known"), F.col("base").alias("base_score"), "score")
    if not model["whole"]:
        rare = rows.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
        # only words outside the broadcast are in this join
        counts = model["words"].where(F.col("n") < model["least"]) if model["least"] else model["words"]
        found = rare.join(counts, "word", "left").groupBy("rid").agg(
            F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - norm)).alias("add"))
        out = out.join(found, "rid", "left").withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("add", F.lit(0.0)))
    if joined:
        p = rows.select("rid", F.explode("pairs").alias("p")).select("rid", "p.*")
        asked = p.select(F.explode(F.array("pair", "word", "before")).alias("key")).where(F.col("key").isNotNull()).distinct()
        # a key that is not in the table of the levels read has level 0
        read = settle(probe(asked, model["filter"], model["shards"], model["bits"]).where("q > 0"), "read")
        for key in ("pair", "word", "before"):
            # the middle of the counts that a level stands for
            q = F.col("q").cast("double")
            low, high = F.ceil(F.pow(F.lit(BASE), q - 1) - 1e-9), F.ceil(F.pow(F.lit(BASE), q) - 1e-9) - 1
            table = read.select(F.col("key").alias("_key"), ((low + F.greatest(low, high)) / 2).alias(f"c_{key}"))
            p = p.join(table, F.col(key) == F.col("_key"), "left").drop("_key")
        word = (F.coalesce("c_word", F.lit(0.0)) + 1) / (n_all + v_all + 1)
        prev = F.when(F.col("before").isNull(), F.lit(float(starts))).otherwise(F.coalesce("c_before", F.lit(0.0)))
        term = F.log10(F.when(prev > 0, (1 - lam) * F.least(F.coalesce("c_pair", F.lit(0.0)), prev) / prev + lam * word).otherwise(word))
        out = out.drop("score").join(p.groupBy("rid").agg(F.sum(F.col("n") * term).alias("score")), "rid", "left")
    return out.drop("rid")


def report(docs: DataFrame, fold: int = 7) -> DataFrame:
    """Learn from texts outside the held-out fold, score all."""
    out = remainder("doc_id", fold) == 2
    model = learn(docs.where(~out))
    s = score_texts(docs, model)
    return s.select(F.col("id").alias("doc_id"), (remainder("id", fold) == 2).alias("held_out"),
                    "n_tokens", "n_known", F.lit(model["N"]).cast("bigint").alias("train_tokens"), "base_score", "score")
