"""Fill-in-middle transformation with an indexable skip list.

A text is a list of units (a run of white space with the word after it; white space at the end is a unit of its own). Above the
units lie express lanes: every node of a lane carries how many units and how many code points its forward link spans, and where it
stands in the lane below. To reach a rank, the search walks a lane while the next link does not pass the rank, adds up both widths
and descends; the code points added up are the cut. A lane keeps one node in FAN, so a search takes at most FAN steps a lane.

Draws come from the SHA-256 of the seed and the id, so a rerun after a lost executor cuts alike, and repeated ids cut alike.

Null and empty texts, and texts that hold one of the three marks, stay plain. A null id draws as the empty string does. Repeated rows
give a row each. Texts of any length are cut whole, in memory of one text. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import rows_pass

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
FAN = 8
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class SkipList:
    """Units of a sequence, found by rank; `points` are the widths of the units."""

    def __init__(self, points: list[int]):
        self.size = len(points)
        #: Lanes from the units upwards: per node the units and the code points up to the next node of the lane.
        self.lanes: list[tuple[list[int], list[int]]] = [([1] * self.size, points)]
        while len(self.lanes[-1][0]) > FAN:
            units, points = self.lanes[-1]
            starts = range(0, len(units), FAN)
            self.lanes.append(([sum(units[i:i + FAN]) for i in starts], [sum(points[i:i + FAN]) for i in starts]))

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank; rank `size` is the end."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = passed = 0
        for units, points in reversed(self.lanes):
            node *= FAN
            while rank and node < len(units) and units[node] <= rank:
                rank -= units[node]
                passed += points[node]
                node += 1
            if not rank:
                break
        return passed


def transform(text: str | None, draws: tuple[int, int, int, int], rate: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle, output."""
    text = text or ""
    lane = SkipList(list(map(len, UNIT.findall(text))))
    n = lane.size
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (lane.offset(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(df: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output for each row; `rate` and `spm` are percentages."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"_h{k}") for k in range(4)]
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *draws)

    def make():
        return lambda i, t, *h: (i, *transform(t, h, rate, spm))
    kind = dict(df.dtypes)[id_col]
    return rows_pass(rows, rows.columns, f"{id_col} {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string", make)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form come from: texts with marks stay plain, so the marks of an output are its own."""
    parts = F.split(output, "<[PSM]>", -1)
    piece = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(2), piece(4), piece(3))).otherwise(F.concat(piece(3), piece(4), piece(2)))


def report(docs: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                                       sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
