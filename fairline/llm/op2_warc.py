"""WARC archives: written with revisits for equal payloads, read back by boundary chains.

Writing. Each page is a record whose payload is its text in UTF-8. Of records with equal payloads of `least` bytes or more, the
one with the largest id is a response and the others are revisits without a body that name it; smaller ones are all responses.

Reading. A file is cut at every occurrence of the magic `WARC/1.1` + CRLF, also at those inside payloads, so files of any size are read by
many tasks. Each piece whose header parses is a candidate record; its header and Content-Length say where its successor starts. Tasks
follow these links inside their split, so each candidate has a jump out of it; jumps are then doubled over all splits of a file
(pointer jumping), and what is reachable from the start of the file tells at which record the chain enters each split. A second
pass follows the chain from there: candidates inside payloads are not on it, and a body cut by a magic is put together out of the
pieces it covers. Only bodies that go on in the next split meet its first pieces in a join. A chain that does not end at the end of
its file raises. The entries sent to the second pass are one small row a split.

Null texts are empty payloads; a null page_id or url is left out of the header. Repeated rows each give a record (of equal largest ids all
are responses). CR and LF in a url are percent-encoded. Empty tables give no records. Other columns are not read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import scratch, settle

MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"
LEAST = 1000


def marked(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, payload, size, sha (hex), refers (the response's id for revisits, else null)."""
    p = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(text_col, F.lit("")).alias("payload"))
    p = p.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    # only payloads that come again take part in the join; copies shrink to a row a task before the shuffle
    first = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).where(F.octet_length("t") >= least).groupBy(F.sha1(F.col("t").cast("binary")).alias("_sha"), F.octet_length("t").cast("bigint").alias("_size")).agg(
        F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = p.join(first, (F.col("sha") == F.col("_sha")) & (F.col("size") == F.col("_size")), "left")
    return out.select("id", "url", "payload", "size", "sha", F.when(F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("id")), F.col("best")).alias("refers"))


def record(date: str = "1970-01-01T00:00:00Z"):
    """The record of a marked page, without the gap after it, as a column."""
    def line(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(F.lit(MAGIC), F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"), line("WARC-Record-ID", name(F.col("id"))), line("WARC-Target-URI", url),
                    F.lit(f"WARC-Date: {date}\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))), line("WARC-Payload-Length", F.col("size").cast("string")),
                    F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""), line("WARC-Refers-To", name(F.col("refers"))),
                    line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, **names) -> None:
    """Archives of the pages, one or more files a task, through Spark's own writer."""
    marked(pages, least, **names).select(record().alias("value")).write.option("lineSep", GAP).text(folder)


HEADER = re.compile(rb"((?:[A-Za-z-]+: [^\r\n]*\r\n)*)\r\n")
PIECE = "file string, block bigint, at bigint, size bigint, start boolean, succ bigint, exit bigint"


def cut_at_magic(spark: SparkSession, folder: str) -> DataFrame:
    """file, block, piece: what stands between two occurrences of the magic, in order within each split."""
    raw = spark.read.option("lineSep", MAGIC).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each piece: its place in its split (`at`, with the magic before it), its size, whether its header parses, where its
    record ends (`succ`) and where the chain from it leaves the split (`exit`), all from the split's start."""
    schema = spark.createDataFrame([], PIECE).schema
    magic, gap = len(MAGIC), len(GAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)

        def send(split):
            # places are known once the split is read; from the last piece back, each candidate's exit is that of its successor
            place = {r[2]: k for k, r in enumerate(split)}
            end = split[-1][2] + split[-1][3]
            exits = [None] * len(split)
            for k in range(len(split) - 1, -1, -1):
                succ = split[k][5]
                if succ is not None:
                    exits[k] = succ if succ >= end else exits[place[succ]] if succ in place else None
            for a in range(0, len(split), 8192):
                rows = [(*r, x) for r, x in zip(split[a:a + 8192], exits[a:a + 8192])]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        split, key, at = [], None, 0
        for batch in batches:
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != key:
                    if split:
                        yield from send(split)
                    split, key, at = [], (file, block), 0
                    if block == 0:
                        # the first piece of a file stands before the first magic; all others after one
                        if piece:
                            raise ValueError(f"{file} does not start with a record")
                        continue
                m = HEADER.match(piece)
                length = re.search(rb"(?:^|\n)Content-Length: (\d+)\r\n", m[1]) if m else None
                body = int(length[1]) if length else None
                succ = at + magic + m.end() + body + gap if length else None
                split.append((file, block, at, magic + len(piece), length is not None, succ))
                at += magic + len(piece)
        if split:
            yield from send(split)
    return cut_at_magic(spark, folder).mapInArrow(run, schema)


def places(links: DataFrame) -> DataFrame:
    """file, block, base, total of each split: what lies before it, and the size of its file."""
    sizes = links.groupBy("file", "block").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("file")).alias("total"))


def entered(links: DataFrame) -> DataFrame:
    """file, at of the candidates at which the chain of a file enters a split; links: file, at, exit, total.

    Jumps out of splits are doubled until none is left, and the set reached grows twice as far each time: as many rounds as the logarithm
    of the splits of a file.
    """
    seen = links.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("at"))
    now = settle(links.where(F.col("exit") < F.col("total")).select("file", "at", F.col("exit").alias("to")), "jumps")
    while now.limit(1).count():
        seen = settle(seen.union(seen.join(now, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "entries")
        now = settle(now.join(now.select("file", F.col("at").alias("to"), F.col("to").alias("to2")), ["file", "to"]).select("file", "at", F.col("to2").alias("to")), "jumps")
    return seen


FOUND = "kind string, file string, offset bigint, end bigint, headers string, body binary"


def records(spark: SparkSession, folder: str, splits: dict) -> DataFrame:
    """Rows of the chain, given (base, total, entry) of each split: `whole` records, `open` ones that go on in the next split, and
    `part`s, the pieces before a split's entry."""
    schema = spark.createDataFrame([], FOUND).schema
    held = spark.sparkContext.broadcast(splits)
    gap, magic = len(GAP), MAGIC.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        key, rows, size = None, [], 0
        base = total = at = nxt = 0
        now = None                                      # the open record: offset, end, headers, body so far with what follows

        def send():
            out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return out

        def close():
            if now is not None:
                rows.append(("open", key[0], now[0], now[1], now[2], b"".join(now[3])))
            elif nxt is not None and at == total and nxt != total:
                raise ValueError(f"the chain of records breaks off in {key[0]}")
        for batch in batches:
            for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != key:
                    if key is not None:
                        close()
                    key, now = (file, block), None
                    base, total, nxt = held.value.get(key, (0, 0, None))
                    at = base
                    if block == 0:
                        continue                        # the empty piece before the first magic
                here, at = at, at + len(magic) + len(piece)
                if now is not None:
                    now[3].extend((magic, piece))
                elif nxt is None or here < nxt:
                    rows.append(("part", file, here, None, None, magic + piece))
                else:
                    m = HEADER.match(piece)
                    length = re.search(rb"(?:^|\n)Content-Length: (\d+)\r\n", m[1]) if m else None
                    if here != nxt or length is None:
                        raise ValueError(f"no record at {nxt} of {file}")
                    now = (here, here + len(magic) + m.end() + int(length[1]) + gap, m[1].decode(), [piece[m.end():]])
                if now is not None and at >= now[1]:
                    if at != now[1]:
                        raise ValueError(f"no record at {now[1]} of {file}")
                    body = b"".join(now[3])
                    rows.append(("whole", file, now[0], now[1], now[2], body[:len(body) - gap]))
                    nxt, now = now[1], None
                size += len(piece)
                if size > 4 << 20 and rows:
                    yield send()
                    size = 0
        if key is not None:
            close()
        if rows:
            yield send()
    return cut_at_magic(spark, folder).mapInArrow(run, schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """file, offset, headers (as text), body of each record of the archives."""
    found = settle(pieces(spark, folder), "pieces")
    splits = settle(places(found), "splits")
    near = found.join(splits, ["file", "block"])
    links = settle(near.where("start").select("file", "block", (F.col("at") + F.col("base")).alias("at"), (F.col("exit") + F.col("base")).alias("exit"), "total"), "links")
    first = entered(links).join(links.select("file", "at", "block"), ["file", "at"]).groupBy("file", "block").agg(F.min("at").alias("entry"))
    known = {(r["file"], r["block"]): (r["base"], r["total"], r["entry"]) for r in splits.join(first, ["file", "block"], "left").toLocalIterator()}   # a row a split
    r = records(spark, folder, known)
    done = r.where("kind = 'whole'").select("file", "offset", "headers", "body")
    # bodies that go on and the pieces that they may cover meet by ranges of 1 MiB
    over = settle(r.where("kind <> 'whole'"), "over")
    mib = 1 << 20
    opened = over.where("kind = 'open'").select("file", "offset", "end", "headers", "body", F.explode(F.sequence(F.floor(F.col("offset") / mib), F.floor((F.col("end") - 1) / mib))).alias("bin"))
    parts = over.where("kind = 'part'").select("file", F.col("offset").alias("at"), F.col("body").alias("piece"), F.floor(F.col("offset") / mib).alias("bin"))
    met = opened.drop("body").join(parts, ["file", "bin"]).where((F.col("at") > F.col("offset")) & (F.col("at") < F.col("end"))).groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("ps"))
    tail = F.aggregate("ps", F.lit(b""), lambda a, x: F.concat(a, x["piece"]))
    mended = over.where("kind = 'open'").join(met, ["file", "offset"], "left").withColumn("all", F.concat("body", F.coalesce(tail, F.lit(b""))))
    size = F.length("all") - len(GAP)
    mended = mended.select("file", "offset", "headers", F.when(size < 0, F.raise_error(F.lit("a record breaks off"))).otherwise(F.expr(f"substring(all, 1, length(all) - {len(GAP)})")).alias("body"))
    return done.unionByName(mended)


def header(name: str) -> F.Column:
    return F.nullif(F.regexp_extract("headers", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def round_trip(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages, read the archives back, and say what each record is. A response's size and digest are those of what was read."""
    folder = scratch(spark, "warc")
    write_archives(pages, folder, least)
    r = read_archives(spark, folder)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("bigint"))
    response = header("WARC-Type") == "response"
    return r.select(number(header("WARC-Record-ID")).alias("page_id"), F.when(response, F.length("body").cast("bigint")).otherwise(header("WARC-Payload-Length").cast("bigint")).alias("payload_bytes"),
                    F.when(response, F.sha1("body")).otherwise(F.replace(header("WARC-Payload-Digest"), F.lit("sha1:"))).alias("payload_digest"), header("WARC-Type").alias("record_type"),
                    number(F.coalesce(header("WARC-Refers-To"), F.lit(""))).alias("refers_to"))
