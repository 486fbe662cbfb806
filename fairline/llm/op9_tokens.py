"""Token ids in length-delimited binary records, with a separate index of offsets.

One file a partition, in ascending order of id. A record: length of the payload (u64), masked checksum of these eight bytes (u32),
payload, masked checksum of the payload (u32), all little-endian. A payload: bytes an id takes (u8: 2 or 4), 1 if the document has
an id of its own (u8), that id (i64, 0 without), the token ids. Checksums are CRC-32, masked as
rotate-right(crc, 15) + 0xa282ead8. The index holds for each record its file, offset and size, so records can be read in any order.

A task writes to a file of a name of its own, and the index is a table that Spark commits; a file that a lost or repeated attempt
leaves is in no index and is never read.

Null and empty texts give a record with the end id alone. Rows of equal id, and repeated rows, each give a record, ordered by a hash
of the text; a null id comes first. Empty tables give an empty index. Other columns are not read. Ids are dealt by range of (id,
hash, salt), so that an id which many rows share is dealt to many tasks.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import PIECES, adjacency, byte_letters
from .common import once, scratch, settle

#: Entries of the caches of a task; a full cache starts again. It changes the speed alone.
CACHE = 500_000
#: Fixed value of the mask.
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(read) -> Iterator[bytes]:
    """Payloads of a file, given its read(n); a wrong checksum or a cut file raises."""
    while size := read(8):
        crc = read(4)
        if len(size) < 8 or len(crc) < 4 or struct.unpack("<I", crc)[0] != masked(size):
            raise ValueError("damaged record length")
        n = struct.unpack("<Q", size)[0]
        payload, crc = read(n), read(4)
        if len(payload) < n or len(crc) < 4 or struct.unpack("<I", crc)[0] != masked(payload):
            raise ValueError("damaged record")
        yield payload


def file_system(path: str):
    """pyarrow's file system of a path, and the path in it."""
    from pyarrow import fs
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class WordEncoder:
    """The tokenizers library for a byte-level BPE file, called once for each new piece of text where that is exact."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.by_word: dict[str, bytes] = {}
        self.by_piece: dict[str, bytes] = {}
        self.pieces = regex.compile(PIECES).findall
        self.letters = {b: c for c, b in byte_letters().items()}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, added))).search if added else None
        self.adjacent = adjacency()

    def bytes_of(self, ids: list[int]) -> bytes:
        import array
        return array.array("H" if self.width == 2 else "I", ids).tobytes()

    def learn(self, words: list[str]) -> None:
        """Ids of words with a space before them: cut into pieces as the tokenizer does, each new piece through the library's model."""
        by_piece, by_word, tokenize, letters = self.by_piece, self.by_word, self.tokenizer.model.tokenize, self.letters
        if len(by_piece) > CACHE:
            by_piece.clear()
        for w in words:
            if self.special is not None and self.special(w):
                by_word[w] = self.bytes_of(self.tokenizer.encode(" " + w, add_special_tokens=False).ids)
                continue
            # most words are Latin letters, some with a stop or comma after them: one piece, or two
            core = w[:-1] if w[-1:] in (".", ",") else w
            if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
                cut = (" " + core,) if core is w or core == w else (" " + core, w[-1])
            else:
                cut = self.pieces(" " + w)
            out = []
            for x in cut:
                if (ids := by_piece.get(x)) is None:
                    ids = by_piece[x] = self.bytes_of([t.id for t in tokenize(x.encode().decode("latin-1").translate(letters))])
                out.append(ids)
            by_word[w] = b"".join(out) if len(out) > 1 else out[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text. First words have no space before them, and texts with adjacent white space are encoded whole."""
        cut = [[] if not t or self.adjacent(t) else t.split(" ") for t in texts]
        rest = [c.pop(0) if c else t or "" for c, t in zip(cut, texts)]
        by = self.by_word
        if len(by) > CACHE:
            by.clear()
        self.learn(list(set().union(*cut).difference(by)))
        heads = [self.bytes_of(e.ids) for e in self.batch(rest, add_special_tokens=False)]
        get = by.__getitem__
        return [h + b"".join(map(get, c)) for h, c in zip(heads, cut)]


INDEX = "part int, file string, record bigint, offset bigint, size bigint, id bigint, n_tokens bigint"


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the index: part, file, record, offset, size, id, n_tokens (with the end id)."""
    schema = df.sparkSession.createDataFrame([], INDEX).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        coder, part = once(("words", tokenizer), lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId()
        end = end_id.to_bytes(coder.width, "little")
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        out, offset, record = None, 0, 0
        for batch in batches:
            out = out or fs.open_output_stream(f"{base}/{name}", buffer_size=1 << 20)
            rows = []
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, ids in ((names[k + j], x + end) for k in range(0, len(texts), 256) for j, x in enumerate(coder.encode_all(texts[k:k + 256]))):
                data = frame(struct.pack("<BBq", coder.width, i is not None, i or 0) + ids)
                out.write(data)
                rows.append((part, name, record, offset, len(data), i, len(ids) // coder.width))
                offset, record = offset + len(data), record + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if out is not None:
            out.close()

    keyed = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"), F.rand(9).alias("s"))
    keys = [F.col(c).asc_nulls_first() for c in "ihs"]
    return settle(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("i", "t").mapInArrow(run, schema), "token-index")


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """Records read back from the files of an index: part, record, id, n_tokens, first (ids before it in its file), crc32 of the
    ids as unsigned 32-bit integers. Checksums are verified."""
    files = settle(index.groupBy("part", "file").agg(F.count("*").alias("n")), "token-files")
    schema = index.sparkSession.createDataFrame([], "part int, record bigint, id bigint, n_tokens bigint, first bigint, ids_crc32 bigint").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        fs, base = file_system(folder)

        def send(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        for batch in batches:
            for part, name, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows, first, seen = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", buffer_size=1 << 20) as f:
                    for payload in unframe(f.read):
                        width, has, i = struct.unpack_from("<BBq", payload)
                        ids = np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")
                        rows.append((part, seen, i if has else None, len(ids), first, zlib.crc32(ids)))
                        first, seen = first + len(ids), seen + 1
                        if len(rows) == 4096:
                            yield send(rows)
                            rows = []
                if seen != n:
                    raise ValueError(f"{name}: {seen} records, {n} in the index")
                if rows:
                    yield send(rows)

    # the rows are tiny, so adaptive execution would merge them into one task: as many tasks as files are named here, up to 10,000
    return files.repartition(max(1, min(files.count(), 10_000)), "file").select("part", "file", "n").mapInArrow(run, schema)


def read_record(folder: str, file: str, offset: int, size: int):
    """Ids of one record by its place in the index, for reads in any order."""
    import numpy as np
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/{file}") as f:
        f.seek(offset)
        payload = next(unframe(f.read))
    if len(payload) + 16 != size:
        raise ValueError("record size differs from the index")
    return np.frombuffer(payload, f"<u{payload[0]}", offset=10)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents, read the files back, and say where each one's ids are in the whole sequence."""
    folder = scratch(spark, "tokens")
    index = write_tokens(docs, folder, tokenizer, end_id)
    # one row a file, so the running sum is over as many rows as tasks wrote
    per_file = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per_file.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    back = read_tokens(index, folder)
    return back.join(before, F.col("part") == F.col("p")).select(F.col("id").alias("doc_id"), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
