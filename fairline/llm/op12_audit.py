"""Filter interaction audit by truth-table survival words.

With five filters there are 32 subsets. A document that fails the filters in mask f survives a subset exactly when the two share no
filter, so a 32-bit word with a bit for each subset holds all that can ever happen to it. Bits of many words are counted by position
with carry-save adders: three words of one weight become a sum word of the same weight and a carry word of twice that weight, for all
32 positions at once, until two words of each weight are left. The counts of survivors per part, subset and label give every order of
the filters: what a step keeps and removes, what it finds removed already, and each filter's share over all orders.

Counts leave a task once per part; documents are not shuffled. Whether a text is a copy is decided on digests: the smallest id of each
digest is aggregated map-side, and a document looks itself up by digest and id, so no group of copies meets in one task.

Null texts count as empty, a null part as the empty string. A null id is smaller than none and is no copy. Rows repeated with one id
are no copies of each other, and each counts. Labels that repeat an id count once, a label of a null id not at all. Texts of any length
are read whole, in memory of one text. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import rows_pass, settle

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SUBSETS = 1 << len(FILTERS)
#: The survival word of each mask of failed filters.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = re.compile(rb"[#$%&*|]")
#: Parts that a task holds before it sends their counts on.
PARTS = 20_000


def fails(text: str) -> int:
    """Mask of the filters A to D that the text fails: few words, few distinct words, capitals, signs."""
    data = text.encode()
    words = data.split()                                                   # splits at bytes \x09-\x0D and \x20, no others
    n = len(words)
    return ((n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * (len(data) - len(data.translate(None, CAPITALS))) > 5 * len(text)) << 2
            | (SIGNS.search(data) is not None) << 3)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits."""
    counts, weight, now = np.zeros(SUBSETS, np.int64), 0, words
    while len(now):
        carries = []
        while len(now) > 2:
            k = len(now) // 3
            a, b, c = now[:k], now[k:2 * k], now[2 * k:3 * k]
            half = a ^ b
            carries.append((a & b) | (c & half))
            now = np.concatenate([half ^ c, now[3 * k:]])
        for word in now.tolist():
            counts += (word >> np.arange(SUBSETS) & 1) << weight
        now = np.concatenate(carries) if carries else now[:0]
        weight += 1
    return counts


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (failed filters), good, toxic for each row."""
    def make():
        def row(i, part, text):
            text = text or ""
            return i, part or "", hashlib.blake2b(text.encode(), digest_size=16).digest(), fails(text)
        return row
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(part_col).cast("string").alias("_part"), F.col(text_col).alias("_text"))
    facts = settle(rows_pass(rows, rows.columns, f"id {kind}, part string, digest binary, mask int", make), "audit")
    first = facts.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    no = F.lit(False)
    return facts.join(first, ["id", "digest"], "left").join(marks, "id", "left").select(
        "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).cast("int").alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: documents that survive the subset of filters, of all, of good and of toxic ones."""
    schema = "part string, subset int, n bigint, good bigint, toxic bigint"
    arrow = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("n", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])

    def leave(held: dict) -> pa.RecordBatch:
        counts = np.concatenate(list(held.values()), axis=1)
        names = np.repeat(np.array(list(held), object), SUBSETS)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)))] + [pa.array(c) for c in counts], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            of, words = coded.indices.to_numpy(), WORDS[batch.column(1).to_numpy()]
            good, toxic = (batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))
            for k, part in enumerate(coded.dictionary.to_pylist()):
                at = order[edges[k]:edges[k + 1]]
                counts = np.stack([positional_counts(words[at]), positional_counts(words[at][good[at]]), positional_counts(words[at][toxic[at]])])
                held[part] = held[part] + counts if part in held else counts
            if len(held) > PARTS:
                yield leave(held)
                held = {}
        if held:
            yield leave(held)

    return rows.select("part", "mask", "good", "toxic").mapInArrow(run, schema).groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def orders(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, out of the survivors of each part's subsets."""
    last = len(FILTERS)
    by_subset = F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic")))
    bit = lambda letter: F.element_at(F.array(*(F.lit(1 << k) for k in range(last))), F.ascii(letter) - F.lit(ord("A") - 1))
    mask = lambda text: F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), F.lit(0), lambda m, x: m + bit(x))
    at = lambda c, subset: F.element_at(c, subset + 1)
    every = F.lit(SUBSETS - 1)
    # a set of k filters comes before a given one in k! (4 - k)! of the orders
    ways = [1, 1, 2, 6, 24]
    turns = F.array(*(F.lit(ways[k] * ways[last - 1 - k]) for k in range(last)))

    def share(one: int):
        lost = lambda m: F.element_at(turns, F.bit_count(m) + 1) * (at(F.col("n"), m) - at(F.col("n"), m + one))
        return F.aggregate(F.sequence(F.lit(0), every), F.lit(0).cast("bigint"), lambda s, m: s + F.when(m.bitwiseAND(F.lit(one)) == 0, lost(m)).otherwise(0))

    parts = counts.groupBy("part").agg(by_subset.alias("s")).select("part", *(F.col(f"s.{c}").alias(c) for c in ("n", "good", "toxic")))
    parts = parts.withColumn("shares", F.array(*(share(1 << k) for k in range(last))))
    steps = (parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(last))))
             .withColumn("letter", F.expr("substring(filter_order, step, 1)"))
             .withColumn("bit", bit(F.col("letter"))).withColumn("before", mask(F.expr("substring(filter_order, 1, step - 1)"))))
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("before") + F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", at(F.col("n"), F.col("before") + F.col("bit")).alias("kept"), lost(F.col("n")).alias("removed"),
        (at(F.col("n"), F.lit(0)) - at(F.col("n"), F.col("bit")) - lost(F.col("n"))).alias("redundant"),
        (at(F.col("n"), every - F.col("bit")) - at(F.col("n"), every)).alias("unique_fails"),
        lost(F.col("good")).alias("good_lost"), lost(F.col("toxic")).alias("toxic_lost"), F.element_at("shares", F.ascii("letter") - F.lit(ord("A") - 1)).alias("shapley"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(survivors(verdicts(docs, labels)))
