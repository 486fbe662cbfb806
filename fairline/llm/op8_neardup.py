"""MinHash near-duplicates with odd sketches.

A document's set: hashes of its distinct runs of `k` words; of all its words if it has fewer; nothing without words. Equal sets form
a class, and from there on work is on classes. K minimum hashes of each set are folded into an odd sketch: each one flips a bit, so
the number of ones in the XOR of two sketches tells how many of the K differ, most precisely where few do. Bands of `rows` minimum
hashes are the keys under which classes meet.

1. In each band bucket a search from class to class by sketches joins those whose estimate is at least `near` to candidate
   groups. It gives one link for each class found, not all pairs.
2. Links of all buckets are joined to candidate groups (connected components), so that all sets of a group can meet once.
3. In each candidate group a search from class to class counts common hashes of the full sets, exactly. A class found is not compared
   again with those found before, which changes no component.
4. Components of these links are the result.

Buckets and groups larger than `block` classes are dealt into blocks, and each pair of blocks is a task of its own, so no task holds
more than two blocks and no candidate is dropped. Copies meet nowhere: they are one class. Estimates only choose what is compared;
`near` lies six standard deviations below the limit: 0.62 for 0.85, 0.57 for 0.80. Two sets at the limit share no band with a probability of
4e-7 at 0.85 and 5e-5 at 0.80; such a pair is lost unless a third set brings both into one group.

Null texts and texts without words have an empty set, are linked with nothing, and are their own component. Repeated rows are in one
class. component_id is the smallest id of a component; a null id counts for nothing unless all are null. Empty tables give no rows.
Other columns are not read.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import forget, lower_ascii, rows_of, settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HASHES, ROWS, BITS = 128, 5, 1024


def seeds():
    """Multipliers and shifts of the minimum hashes, by a fixed rule."""
    import numpy as np
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def word_hashes(words: list[str], cache: dict):
    import numpy as np
    import xxhash
    if len(cache) > 150_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x):
    """A good spread of 64 bits."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, cache: dict):
    """Sorted distinct hashes of the runs of k words."""
    import numpy as np
    words = WORD.findall(lower_ascii(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, cache)
    n = max(1, len(h) - k + 1)
    out = np.full(n, len(h) if len(h) < k else k, np.uint64)
    for j in range(min(k, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(out)


def signature(s, mul, add):
    """The minimum hashes of a set."""
    import numpy as np
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):                       # long texts in parts, so that memory stays small
        x = s[at:at + 2048, None] * mul[None] + add[None]
        np.minimum(low, x.min(0), out=low)
    return mix(low)


def odd_sketch(sig):
    """Each minimum hash flips a bit."""
    import numpy as np
    bit = mix(sig + np.arange(HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def likeness(ones):
    """Estimate of the similarity from the ones in the XOR of two sketches."""
    import numpy as np
    return 1 + BITS / (4 * HASHES) * np.log(np.maximum(1 - 2 * np.asarray(ones, float) / BITS, 1e-9))


def profiles(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest (16 bytes, null if empty), bands, sketch for each row."""
    schema = docs.sparkSession.createDataFrame([], f"id {dict(docs.dtypes)[id_col]}, n_shingles bigint, digest binary, bands array<bigint>, sketch binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        forget()
        mul, add = seeds()
        cache: dict = {}
        n_bands = HASHES // ROWS
        salt = np.arange(n_bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, digest, bands, sketch = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text, k, cache)
                    n.append(len(s))
                    if not len(s):
                        digest.append(None), bands.append(None), sketch.append(None)
                        continue
                    digest.append(hashlib.blake2b(s, digest_size=16).digest())
                    sig = signature(s, mul, add)
                    b = salt.copy()
                    for r in sig[:n_bands * ROWS].reshape(n_bands, ROWS).T:
                        b = mix(b * np.uint64(0x9E3779B97F4A7C15) + r)
                    bands.append(b.view(np.int64).tolist())
                    sketch.append(odd_sketch(sig))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def in_blocks(df: DataFrame, key: str, block: int) -> DataFrame:
    """Rows of each key dealt to tasks (key, a, b): keys of at most `block` rows to one, others to all pairs of their blocks."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    own = df.join(sizes, F.col(key) == F.col("_key")).drop("_key").withColumn("_own", F.pmod(F.xxhash64("digest"), F.col("_parts")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.least(F.col("_own"), j).alias("a"), F.greatest(F.col("_own"), j).alias("b")))
    return own.withColumn("_pair", F.explode(pair)).withColumn("_a", F.col("_pair.a")).withColumn("_b", F.col("_pair.b")).drop("_pair", "_parts")


LINKS = "a binary, b binary"


def search(n: int, reach) -> list[tuple[int, int]]:
    """Breadth-first search; `reach(x, open)` says which of the open nodes are linked with x. One link for each node found."""
    import numpy as np
    todo, links = np.arange(n), []
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            hit = reach(x, todo)
            for y in todo[hit]:
                links.append((x, int(y)))
                queue.append(int(y))
            todo = todo[~hit]
    return links


def by_group(df: DataFrame, keys: list[str], value: str, links_of) -> DataFrame:
    """Links that `links_of(digests, values)` finds in each group of rows with equal keys. Rows come sorted by key, so a task holds one
    group at a time; there are very many small ones."""
    schema = df.sparkSession.createDataFrame([], LINKS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, out = to_arrow_schema(schema), []
        key, digests, values = None, [], []

        def close():
            if len(digests) > 1:
                order = sorted(range(len(digests)), key=digests.__getitem__)
                d = [digests[k] for k in order]
                out.extend((d[x], d[y]) for x, y in links_of([values[k] for k in order]))
        for batch in batches:
            for *k, digest, v in rows_of(batch):
                if k != key:
                    close()
                    key, digests, values = k, [], []
                digests.append(digest)
                values.append(v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=arrow)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=arrow)
    return df.select(*keys, "digest", value).repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sketch_links(near: float):
    #: the ones in the XOR that an estimate of `near` allows
    most = max(k for k in range(BITS // 2) if likeness(k) >= near)

    def links(sketches: list[bytes]):
        import numpy as np
        s = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), BITS // 64)
        return search(len(s), lambda x, open_: np.bitwise_count(s[open_] ^ s[x]).sum(1) <= most)
    return links


def exact_links(num: int, den: int):
    """Links of sets with den * intersection >= num * union."""
    def links(sets: list[bytes]):
        import numpy as np
        size = np.array([len(x) // 8 for x in sets])
        edges = np.concatenate([[0], np.cumsum(size)])
        # hashes as numbers of a common dictionary, and for each number the sets that hold it
        number = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1].ravel()
        by = np.argsort(number, kind="stable")
        first = np.searchsorted(number[by], np.arange(number.max() + 2))
        holders = np.repeat(np.arange(len(sets)), size)[by]

        def reach(x, open_):
            mine = number[edges[x]:edges[x + 1]]
            lengths = first[mine + 1] - first[mine]
            at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            both = np.bincount(holders[at], minlength=len(sets))[open_]
            return den * both >= num * (size[open_] + size[x] - both)
        return search(len(sets), reach)
    return links


def connected(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node that has a link.

    Rounds of hooking and pointer jumping: each node takes the smallest label of its neighbours, and then the label of its label; each
    round is written, and what a round sends is a row for each link.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        # the smallest label around a node
        around = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        low = label.join(around, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("low", "root")).alias("low"))
        # hand it to the old root too, so that whole trees hook at once, and jump
        hook = low.groupBy(F.col("old").alias("h")).agg(F.min("low").alias("hooked"))
        new = low.join(hook, F.col("low") == F.col("h"), "left").select("node", "old", F.least("low", F.coalesce("hooked", "low")).alias("root"))
        new = settle(new, "labels")
        done = new.where("root <> old").limit(1).count() == 0
        label = new.select("node", "root")
        if done:
            return label


def needed_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """digest, hashes of the wanted classes, computed again from one row each: the text of the id that stands for the class."""
    schema = docs.sparkSession.createDataFrame([], "digest binary, hashes binary").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        cache: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t, k, cache) for t in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=to_arrow_schema(schema))
    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    mine = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(ids, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
    # an id that several rows share may stand for one class and bring others; repeated ones are one row again here
    sets = mine.select("_t").distinct().mapInArrow(run, schema)
    return sets.join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


def components(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, near: float = 0.62, block: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, n_shingles, component_id for each row."""
    rows = settle(profiles(docs, k, id_col, text_col), "profiles")
    full = rows.where("digest IS NOT NULL")
    # hot copies shrink to a row a task before the shuffle; what follows from the set is the same in all of them
    one = full.groupBy("digest").agg(F.min("id").alias("rep"), F.first(F.struct("bands", "sketch")).alias("s")).select("digest", "rep", "s.bands", "s.sketch")
    one = settle(one, "classes")
    classes = one.select("digest", "rep")
    met = one.select(F.explode("bands").alias("band"), "digest")
    met = settle(met.join(met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "band", "left_semi"), "met")
    tasks = in_blocks(met, "band", block).join(one.select("digest", "sketch"), "digest")
    rough = by_group(tasks, ["band", "_a", "_b"], "sketch", sketch_links(near))
    group = connected(rough)
    wanted = settle(group.join(one.select(F.col("digest").alias("node"), "rep"), "node").select(F.col("node").alias("digest"), F.col("root").alias("grp"), "rep"), "wanted")
    sets = needed_sets(docs, wanted, k, id_col, text_col)
    tasks = in_blocks(wanted.select("digest", "grp").join(sets, "digest"), "grp", block)
    exact = by_group(tasks, ["grp", "_a", "_b"], "hashes", exact_links(num, den))
    comp = connected(exact)
    least = comp.join(classes, F.col("node") == F.col("digest")).groupBy("root").agg(F.min("rep").alias("component_id"))
    of = comp.join(least, "root").select(F.col("node").alias("_d"), "component_id")
    of = classes.join(of, F.col("digest") == F.col("_d"), "left").select(F.col("digest").alias("_d"), F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(of, F.col("digest") == F.col("_d"), "left").select("id", "digest", "n_shingles", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: size of its set, smallest id of its component, and whether that is its own."""
    c = components(docs)
    return c.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, num: int = 80, den: int = 100, near: float = 0.57) -> DataFrame:
    """One document of each component, with all its columns; of rows alike in id and text one stays. Documents without words all stay."""
    import uuid
    from pyspark.sql import Window
    from pyspark.sql.types import BinaryType, StructType
    tag = "_" + uuid.uuid4().hex                            # columns of the input may have any names
    i, d, n, mark = (f"{tag}_{x}" for x in "idnm")
    keep = components(docs, num, den, near=near).where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(i), F.col("digest").alias(d)).distinct()
    schema = StructType(list(docs.schema.fields)).add(mark, BinaryType())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            sets = (shingles(t, 5, cache) for (t,) in rows_of(batch.select([at])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary())], names=[*batch.schema.names, mark])
    here = docs.mapInArrow(run, schema).join(keep, F.col("doc_id").eqNullSafe(F.col(i)) & F.col(mark).eqNullSafe(F.col(d)), "left_semi")
    first = Window.partitionBy("doc_id", mark).orderBy("text")
    return here.withColumn(n, F.when(F.col(mark).isNull(), 1).otherwise(F.row_number().over(first))).where(F.col(n) == 1).select(docs.columns)
