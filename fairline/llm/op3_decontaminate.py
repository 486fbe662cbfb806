"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of benchmark items: all runs of `window` words, or the whole item where it has fewer. For each pattern
length m there is a shift table over blocks of two words: how far the search may jump when the block ends the current position.
Blocks that no pattern holds jump m - 1 words. Where the shift is zero, the block names a bucket of patterns that end in it; those
whose first word agrees are compared word by word. Patterns of one word are looked up directly.

Patterns are sent to the tasks in groups of items of at most `limit` bytes of text each (an item is not cut); with more than one
group, documents pass once for each, carrying the hits so far. No shuffle in any case.

Null texts and texts without words have no words and no hits. Repeated rows give a row each. Items without words match nothing; a
null item_id counts as the id "null". Empty tables on either side are fine. Other columns are not read.
"""
from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, lower_ascii, rows_pass, settle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LIMIT = 32 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


class WuManber:
    """Patterns of words, each with the items that it comes from."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ones: dict[str, set[str]] = {}
        found: dict[tuple[str, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.classes: dict[int, tuple[dict, dict]] = {}
        for p, of in found.items():
            m = len(p)
            if m == 1:
                self.ones[p[0]] = of
                continue
            shift, bucket = self.classes.setdefault(m, ({}, {}))
            for j in range(2, m + 1):
                block = p[j - 2], p[j - 1]
                shift[block] = min(shift.get(block, m), m - j)
            bucket.setdefault(p[-2:], {}).setdefault(p[0], []).append((list(p), of))

    def search(self, w: list[str], hit: bytearray, items: set[str]) -> None:
        n = len(w)
        if self.ones and not self.ones.keys().isdisjoint(w):
            for i, x in enumerate(w):
                if (of := self.ones.get(x)) is not None:
                    hit[i] = 1
                    items |= of
        for m, (shift, bucket) in self.classes.items():
            jump, i = m - 1, m
            get = shift.get
            while i <= n:
                s = get((w[i - 2], w[i - 1]), jump)
                if s:
                    i += s
                    continue
                for p, of in bucket[w[i - 2], w[i - 1]].get(w[i - m], ()):
                    if w[i - m:i] == p:
                        hit[i - m:i] = b"\1" * m
                        items |= of
                i += 1


def pattern_groups(benchmark: DataFrame, window: int, limit: int, item_col: str, text_col: str) -> list:
    """Broadcasts of (item, text) lists, each of about `limit` bytes of text at most, whatever the size of the benchmark."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit) or 1
    spread = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(spread == g).toLocalIterator()]) for g in range(n)]


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, n_words, hits (one byte a word, 1 where hit), items (sorted ids) for each row."""
    kind, groups = dict(docs.dtypes)[id_col], pattern_groups(benchmark, window, limit, item_col, item_text)
    now = docs.select(id_col, F.col(text_col).alias("_text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for held in groups:
        last = held is groups[-1]

        def make(held=held, last=last):
            patterns = WuManber(held.value, window)

            def row(i, text, hits, names):
                w = words(text)
                hit, found = bytearray(hits) if hits is not None else bytearray(len(w)), set(names or ())
                patterns.search(w, hit, found)
                return i, None if last else text, bytes(hit), sorted(found)
            return row
        now = rows_pass(now, [id_col, "_text", "hits", "items"], f"{id_col} {kind}, _text string, hits binary, items array<string>", make)
        if not last:
            now = settle(now, "windows")
    return now.select(id_col, F.length("hits").cast("bigint").alias("n_words"), "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = LIMIT) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, a digest of their ids, and whether any word is hit."""
    found = find_windows(docs, benchmark, window, limit)
    hit = F.length(F.translate(F.decode("hits", "ISO-8859-1"), "\x00", "")).cast("bigint")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    groups = pattern_groups(benchmark, window, limit, "item_id", "text")
    for held in groups:

        def make(held=held):
            patterns = WuManber(held.value, window)

            def passes(text):
                w = words(text)
                hit: bytearray = bytearray(len(w))
                patterns.search(w, hit, set())
                return 1 not in hit
            return passes
        docs = keep_rows(docs, text_col, make)
        if held is not groups[-1]:
            docs = settle(docs, "clean")
    return docs
