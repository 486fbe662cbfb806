"""Substring dedup by repeated-phrase automata.

A phrase is a run of `words` words that starts in more than one document; its owner is the smallest id among them. Words that a phrase
covers go from every document but the owner.

Documents are dealt into parts of bounded size, by a hash, once. Work that meets across documents is sent per part, not per document,
so a phrase in a third of all documents comes once from each part. Of equal texts only that of the smallest id is searched: its phrases
own or are owned alike, and the others lose all their words.

1. Anchors: of the `gram`-word runs in a phrase, the one with the smallest hash. Equal phrases have equal anchors, and neighbours mostly
   share theirs, so a quarter as many anchors as phrases travel. Those of two documents or more are sent back to their parts.
2. Confirmation: each part digests the words of the phrases over such an anchor (BLAKE2, 128 bits). Phrases met in two documents are
   confirmed; each part that holds one outside its owner gets the owner's id and a place in the part where the words stand.
3. Automata: in each part, confirmed phrases are compiled into Aho-Corasick automata of at most `shard` phrases, and all documents of the
   part are streamed through them, which finds every occurrence. Words are written with a fixed number of digits: a node's links are
   searched one by one, so nodes must have few.

A part's automata hold the phrases of that part alone: the work grows with the text, not with texts times phrases. Memory is that of one
part, or of one document where that is longer, and of one automaton.

Ids are integers. Null ids come after all others and own nothing. Rows that repeat an id take nothing from each other. Null and empty texts, and
texts of fewer words, lose nothing; an empty table gives no rows. Words are split at \\x20 and \\x09-\\x0D; white space is not part of a
phrase. Other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

WORDS, GRAM = 13, 6
PART, SHARD = 8 << 20, 30_000
#: Digits of the automata's words.
BASE = 32
#: Partitions at most; beyond that a partition holds several parts, one after the other.
PARTITIONS = 50_000
LAST = (1 << 63) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose order is unlike that of their arguments."""
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Part:
    """Words of the searched documents of a part, in the order of row keys, which is the same in each pass.

    `lists` are the rows (kind, x, y) sent to the part: 0, the key of a row to search; 1, an anchor; 2, a phrase's place and its owner.
    """

    def __init__(self, rows: pa.Table, lists: pa.Table):
        rows = rows.sort_by("rid")
        kind, self._x, self._y = (lists.column(c).to_numpy() for c in ("kind", "x", "y"))
        self._of = [np.flatnonzero(kind == k) for k in range(3)]
        self.rows = rows
        self.searched = np.isin(rows.column("rid").to_numpy(), self._x[self._of[0]])
        self.ids = rows.column("id").fill_null(LAST).to_numpy()
        counts, self.words = [], []
        for text, searched in zip(rows.column("text"), self.searched.tolist()):
            w = (text.as_py() or "").encode().split() if searched else ()
            counts.append(len(w))
            self.words += w
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def sent(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        at = self._of[kind]
        return self._x[at], self._y[at]

    def anchors(self, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of `words` words starts, and the anchor of each."""
        from xxhash import xxh3_64_intdigest
        n = len(self.words)
        if n < words:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        one = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, n)
        run = one[:n - gram + 1].copy()
        for k in range(1, gram):
            run = run * FACTOR + one[k:n - gram + 1 + k]
        run = mixed(run)
        low = run[:n - words + 1].copy()
        for k in range(1, words - gram + 1):
            np.minimum(low, run[k:n - words + 1 + k], out=low)
        at = np.flatnonzero(self.doc[:n - words + 1] == self.doc[words - 1:])
        return at, low[at]


def groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by the columns, and where in it each group of equal rows starts."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def part_anchors(rows: pa.Table, lists: pa.Table, words: int, gram: int) -> pa.Table:
    """part, h, docs: each anchor of the part once, with the number of documents if that is one, else two."""
    part = Part(rows, lists)
    at, low = part.anchors(words, gram)
    doc = part.doc[at]
    order, first = groups(low)
    docs = (np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)) + 1 if len(first) else first
    number = rows.column("part")[0].as_py()
    return pa.table({"part": pa.array(np.full(len(first), number, np.int32)), "h": pa.array(low[order][first].view(np.int64)), "docs": pa.array(docs.astype(np.int32))})


def part_phrases(rows: pa.Table, lists: pa.Table, words: int, gram: int) -> pa.Table:
    """part, a, b, lo, hi, at: each phrase over a known anchor once, by its digest, with the smallest and largest id and a place."""
    empty = pa.table({"part": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("a", "b", "lo", "hi", "at")}})
    part = Part(rows, lists)
    h = np.sort(part.sent(1)[0].view(np.uint64))
    if not len(h):
        return empty
    at, low = part.anchors(words, gram)
    place = np.minimum(np.searchsorted(h, low), len(h) - 1)
    at = at[h[place] == low]
    if not len(at):
        return empty
    w = part.words
    digests = b"".join([hashlib.blake2b(b" ".join(w[i:i + words]), digest_size=16).digest() for i in at.tolist()])
    a, b = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    ids = part.ids[part.doc[at]]
    order, first = groups(a, b)
    number = rows.column("part")[0].as_py()
    return pa.table({"part": pa.array(np.full(len(first), number, np.int32)), "a": a[order][first], "b": b[order][first],
                     "lo": np.minimum.reduceat(ids[order], first), "hi": np.maximum.reduceat(ids[order], first), "at": at[order][first]})


def automaton(phrases: list[list[bytes]], owners: list[int]):
    """An Aho-Corasick automaton over written words, how each word is written, and the number of signs of a word.

    Each digit has signs of its own, so a match begins and ends with words. The sign 0 is in no word.
    """
    import ahocorasick
    number: dict[bytes, int] = {}
    for phrase in phrases:
        for w in phrase:
            number.setdefault(w, len(number))
    digits = 1
    while BASE ** digits < len(number):
        digits += 1
    written = {w: "".join([chr(1 + j * BASE + k // BASE ** j % BASE) for j in range(digits)]) for w, k in number.items()}
    found = ahocorasick.Automaton()
    for phrase, owner in zip(phrases, owners):
        found.add_word("".join([written[w] for w in phrase]), owner)
    found.make_automaton()
    return found, written, digits


def part_spans(rows: pa.Table, lists: pa.Table, words: int, shard: int) -> pa.Table:
    """The rows of the part with their number of words and the spans of words that a smaller id's phrase covers."""
    part = Part(rows, lists)
    n = len(part.words)
    edge = np.zeros(n + 1, np.int32)
    places, owners = part.sent(2)
    order, doc, ids = np.argsort(places), part.doc, part.ids
    places, owners = places[order].tolist(), owners[order].tolist()
    for k in range(0, len(places), shard):
        found, written, digits = automaton([part.words[i:i + words] for i in places[k:k + shard]], owners[k:k + shard])
        get, none = written.get, "\0" * digits
        hits = np.fromiter((x for hit in found.iter("".join([get(w, none) for w in part.words])) for x in hit), np.int64).reshape(-1, 2)
        end = hits[:, 0] // digits
        start = end - words + 1
        take = (doc[start] == doc[end]) & (hits[:, 1] < ids[doc[end]])
        np.add.at(edge, start[take], 1)
        np.add.at(edge, end[take] + 1, -1)
    covered = np.cumsum(edge[:-1]) > 0
    # a span starts where a covered word follows an uncovered one or another document's
    new_doc = np.zeros(n + 1, bool)
    new_doc[part.starts[part.ends > part.starts]] = True
    before = np.concatenate([[False], covered[:-1]]) if n else covered
    after = np.concatenate([covered[1:], [False]]) if n else covered
    begins = np.flatnonzero(covered & (~before | new_doc[:-1]))
    stops = np.flatnonzero(covered & (~after | new_doc[1:])) + 1
    of = part.doc[begins]
    base = part.starts[of]
    spans = np.stack([begins - base, stops - base], 1).tolist()
    of = np.searchsorted(of, np.arange(rows.num_rows + 1)).tolist()
    out = []
    for k, text in enumerate(part.rows.column("text")):
        if part.searched[k]:
            w, mine = part.words[part.starts[k]:part.ends[k]], spans[of[k]:of[k + 1]]
        else:
            w = (text.as_py() or "").encode().split()
            mine = [[0, len(w)]] if len(w) >= words else []
        kept, at = [], 0
        for first, last in mine:
            kept += w[at:first]
            at = last
        kept += w[at:]
        out.append((len(w), len(w) - len(kept), [x for span in mine for x in span], b" ".join(kept).decode()))
    n_words, n_removed, spans, kept = map(list, zip(*out))
    return pa.table({"id": part.rows.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                     "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, words: int = WORDS, gram: int = GRAM, part_bytes: int = PART, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, spans (start, end, start, end, ...: removed runs of words) and kept (the other words, by one space)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // part_bytes) or 1
    rid = F.xxhash64("id", "text")
    parts = rows.select(F.pmod(rid, F.lit(n)).cast("int").alias("part"), rid.alias("rid"), "id", "text").repartition(min(n, PARTITIONS), "part")

    # of each text the row with the smallest id, by its key; ids and texts are aggregated map-side
    least = F.min(F.struct(F.coalesce("id", F.lit(LAST)).alias("id"), rid.alias("rid"))).getField("rid")
    firsts = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")).agg(least.alias("x")).select(
        F.pmod("x", F.lit(n)).cast("int").alias("part"), F.lit(0).alias("kind"), "x", F.lit(0).cast("bigint").alias("y"))
    by_anchor, by_phrase = Window.partitionBy("h"), Window.partitionBy("a", "b")

    def pass_over(lists: DataFrame, fn, schema: str) -> DataFrame:
        return parts.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(fn, schema)

    anchors = pass_over(firsts, lambda t, k: part_anchors(t, k, words, gram), "part int, h bigint, docs int")
    shared = anchors.withColumn("docs", F.sum("docs").over(by_anchor)).where("docs > 1").selectExpr("part", "1 AS kind", "h AS x", "0L AS y")
    phrases = pass_over(firsts.union(shared), lambda t, k: part_phrases(t, k, words, gram), "part int, a bigint, b bigint, lo bigint, hi bigint, at bigint")
    owned = phrases.withColumn("owner", F.min("lo").over(by_phrase)).where("owner < hi").selectExpr("part", "2 AS kind", "at AS x", "owner AS y")
    return pass_over(firsts.union(owned), lambda t, k: part_spans(t, k, words, shard), "id bigint, n_words bigint, n_removed bigint, spans array<bigint>, kept string").withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
