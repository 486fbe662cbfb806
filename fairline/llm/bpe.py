"""Byte-level BPE by the backtracking method, and decoding by an offset table.

An Aho-Corasick automaton over all tokens gives, for every start in a piece, the longest token there. The encoder takes the longest
token whose neighbour on the left is compatible, falls back to shorter prefixes, and steps back where none fits; each position is
ruled out at most once, so time is linear in the piece. Two neighbouring tokens are compatible if merging them by the rules of
BPE would not join anything across their border; that is decided once a pair and kept in a table.
"""
from __future__ import annotations

import json

#: The white space of the Unicode property, and the split of byte-level BPE into pieces.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % (SPACE, SPACE, SPACE, SPACE)

#: Entries of the caches of a task, and the longest key; a full cache starts again. They change the speed alone.
CACHE, KEY = 100_000, 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Cache(dict):
    """A dictionary that computes what is missing and never holds more than `limit` entries."""

    def __init__(self, compute, limit: int = CACHE):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEY:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def adjacency():
    """A test whether a space touches other white space. Where none does, every space starts a new piece, so what lies between
    spaces can be encoded apart and cached."""
    import re
    rare = re.compile(f"[{SPACE}] | [{SPACE}]").search
    few = [chr(int(x[2:], 16)) for x in "\\x85 \\xa0 \\u1680 \\u2028 \\u2029 \\u202f \\u205f \\u3000".split()] + [chr(x) for x in range(0x2000, 0x200b)]
    common = [x for c in "\n\t\r\v\f" for x in (c + " ", " " + c)]

    def adjacent(text: str) -> bool:
        if "  " in text or any([x in text for x in common]):
            return True
        return not text.isascii() and any([c in text for c in few]) and rare(text) is not None
    return adjacent


class Backtracking:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE):
        import ahocorasick
        import numpy as np
        import regex
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, model = byte_letters(), data["model"]
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        # ranks: bytes first, then the merges in order; a merge makes the token of its rank out of two of lower rank
        rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        pair: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (bytes(letters[c] for c in x) for x in (a, b))
            left, right = rank[a], rank[b]
            if a + b not in rank:
                rank[a + b] = len(halves)
                halves.append((left, right))
            pair.setdefault((left, right), rank[a + b])
        self.halves, self.pair = halves, pair
        self.compatible = Cache(self._compatible, cache)
        tokens = sorted(rank, key=rank.get)
        # a token that BPE does not build out of its own bytes never occurs
        live = [True] * 256
        for t in range(256, len(tokens)):
            a, b = halves[t]
            live.append(live[a] and live[b] and self._compatible((a, b), t))
        self.length = [len(t) for t in tokens]
        self.shorter = [-1] * len(tokens)
        for t, raw in enumerate(tokens):
            for n in range(len(raw) - 1, 0, -1):
                if (p := rank.get(raw[:n])) is not None and live[p]:
                    self.shorter[t] = p
                    break
        self.automaton = ahocorasick.Automaton()
        for raw, t in rank.items():
            if live[t]:
                self.automaton.add_word(raw.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.id = [ids[t] for t in tokens if t in ids]
        assert len(self.id) == len(tokens), "every merge must have an id"
        special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pieces = regex.compile(PIECES).findall
        self.bytes_of = [i.to_bytes(4, "little") for i in self.id]
        self.whole = {raw: self.bytes_of[t] for raw, t in rank.items() if live[t]}
        self.by_piece = Cache(self._piece, cache)
        self.by_word = Cache(lambda word: self._unit(" " + word), cache)
        self.adjacent = adjacency()
        # decoding: all tokens' bytes in one buffer, and where each id begins
        of = {i: raw for raw, i in ids.items()} | {i: x.encode() for x, i in special.items()}
        size = max(of) + 1
        self.starts = np.zeros(size + 1, np.int64)
        self.starts[1:] = np.cumsum([len(of.get(i, b"")) for i in range(size)])
        self.buffer = np.frombuffer(b"".join(of.get(i, b"") for i in range(size)), np.uint8)

    def _compatible(self, key: tuple[int, int], limit: int = 1 << 60) -> bool:
        """Whether BPE leaves the border between two tokens alone: undo both sides' merges, the latest first, and see at each
        step if the pair at the border would have been merged before."""
        left, right = key
        while True:
            made = self.pair.get((left, right))
            if made is not None and made < limit:
                return False
            if left < 256 and right < 256:
                return True
            if left > right:
                # the left token was made last: before that its right half stood at the border, and a merge of the border
                # at the same rank would have come later
                limit, left = left, self.halves[left][1]
            else:
                limit, right = right + 1, self.halves[right][0]

    def _piece(self, raw: bytes) -> bytes:
        if (one := self.whole.get(raw)) is not None:
            return one
        text, length = raw.decode("latin-1"), self.length
        longest = [0] * len(text)
        for end, t in self.automaton.iter(text):
            longest[end + 1 - length[t]] = t                            # later ends are longer
        of = self.bytes_of
        return b"".join([of[t] for t in self._search(text, longest)])

    def _search(self, text: str, longest: list[int]) -> list[int]:
        n, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[pos + length[token]] and (last < 0 or compatible[last, token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                token = longest[pos] if pos < n else -1
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= length[token]
        return out

    def _unit(self, unit: str) -> bytes:
        if self.cut is None or len(parts := self.cut.split(unit)) == 1:
            return self._plain(unit)
        return b"".join([self.special[x].to_bytes(4, "little") if k % 2 else self._plain(x) for k, x in enumerate(parts)])

    def _plain(self, text: str) -> bytes:
        by = self.by_piece
        return b"".join([by[x.encode()] for x in self.pieces(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null and empty text: none."""
        if not text:
            return b""
        if self.adjacent(text):
            return self._unit(text)
        first, *rest = text.split(" ")
        return self._unit(first) + b"".join(map(self.by_word.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        import numpy as np
        a = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(a):
            return ""
        begin = self.starts[a]
        size = self.starts[a + 1] - begin
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(begin - (ends - size), size)
        return self.buffer[at].tobytes().decode("utf-8", errors="replace")
