"""Document fingerprints by winnowing, in DataFrame functions alone.

A text is lower-cased and cut into tokens: runs of at most 16 letters and digits, and single signs of scripts written without spaces. Every run of `k` tokens has a hash. Of each window of `w` runs in a row the smallest hash is chosen, of equal
ones the rightmost; runs chosen by several windows count once. Any passage of w + k - 1 tokens that two texts share gives them
a common hash. Chosen runs keep their position, the index of their first token.

A hash and its position are packed into one number, hash above, distance from the far end below, so that the smallest number is the
smallest hash with the rightmost position. Texts with fewer than k tokens have one run of all; texts without tokens have none (null
and empty texts among them). Equal texts have equal fingerprints. Likeness is the share of common hashes among all of both;
two texts without any are alike (1) if neither has one, else 0.

Other columns are not read. Rows of equal id each give a row; the next document of an id is that of the next smaller id (with several
texts the smallest), after the smallest id, the largest; null ids count as one id after all others. A single document is its own next.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Tokens, of lower-cased text: a sign of a script without spaces (South-East Asian, kana, Han), or up to 16 letters and digits.
TOKEN = (r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
         r"|[0-9a-z\u00C0-\u0DFF\u0F00-\u0FFF\u10A0-\u167F\u1681-\u177F\u1800-\u1FFF\u2C00-\u2DFF\uA000-\uD7FF\uFB00-\uFFFD\x{10000}-\x{1FFFF}]{1,16}")
FAR = 2 ** 31 - 1


def chosen(text: Column, k: int, w: int) -> Column:
    """Packed numbers of the runs that winnowing chooses, in order of their windows."""
    def with_hashes(t: Column) -> Column:
        return F.transform(t, lambda x: F.xxhash64(x))

    def runs(h: Column) -> Column:
        # the hash of a run is that of its tokens' hashes; 32 bits of it stand above 31 bits for the position
        def run(i: Column) -> Column:
            return F.xxhash64(*[F.get(h, i + j) for j in range(k)]) if k > 1 else F.get(h, i)
        last = F.greatest(F.size(h) - k, F.lit(0))
        return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.shiftrightunsigned(run(i), 32), 31) + (F.lit(FAR).cast("long") - i.cast("long"))))

    def windows(p: Column) -> Column:
        last = F.greatest(F.size(p) - w, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.least(*[F.get(p, i + j) for j in range(w)]) if w > 1 else F.get(p, i)))
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    # a one-row transform holds each step, so that none is computed once more for each mention
    step = F.transform(F.array(tokens), with_hashes)
    step = F.transform(step, lambda h: F.coalesce(runs(h), F.array().cast("array<bigint>")))
    return F.get(F.transform(step, lambda p: F.when(F.size(p) > 0, windows(p)).otherwise(p)), F.lit(0))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, 31)


def written(packed: Column) -> Column:
    """hash@position of each chosen run, with spaces between."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit("@"), (F.lit(FAR).cast("long") - x.bitwiseAND(F.lit(FAR).cast("long"))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes of two columns of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)).cast("double"))


def fingerprints(df: DataFrame, k: int = 5, w: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, hashes (array of chosen hashes), positions (of the same length), fingerprint (written) for each row."""
    p = df.select(F.col(id_col), chosen(F.col(text_col), k, w).alias("p"))
    return p.select(id_col, F.transform("p", hash_of).alias("hashes"), F.transform("p", lambda x: F.lit(FAR).cast("long") - x.bitwiseAND(F.lit(FAR).cast("long"))).alias("positions"), written(F.col("p")).alias("fingerprint"))


def next_ids(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """i, j: each distinct id and the one after it in descending order, the first after the last.

    Ids are dealt by range and ordered within a part; only the largest id of each part meets in one place.
    """
    ids = df.select(F.col(id_col).alias("i")).distinct()
    parts = ids.repartitionByRange(F.col("i").desc_nulls_last()).withColumn("part", F.spark_partition_id())
    from .common import settle
    parts = settle(parts, "ids")
    order = F.col("i").desc_nulls_last()
    inside = parts.withColumn("j", F.lead("i").over(Window.partitionBy("part").orderBy(order))).withColumn("last", F.row_number().over(Window.partitionBy("part").orderBy(F.col("i").asc_nulls_first())) == 1)
    # one row a part
    heads = parts.groupBy("part").agg(F.max("i").alias("head"))
    line = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    return inside.join(after, "part").select("i", F.when(F.col("last"), F.col("after")).otherwise(F.col("j")).alias("j"))


def report(docs: DataFrame, k: int = 5, w: int = 8) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and how alike they are.

    Texts are dealt by id once, for both uses. To the document before it a text sends only its chosen hashes and as many code points
    as the longest text of that id replaces.
    """
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    base = docs.select(key("doc_id").alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    longest = docs.groupBy(key("doc_id").alias("k")).agg(F.floor(F.max(F.length(F.coalesce("text", F.lit("")))) / 2).cast("int").alias("most"))
    pairs = next_ids(docs).select(key("i").alias("before"), key("j").alias("at"))
    pairs = pairs.join(longest, F.col("before") == F.col("k")).drop("k")
    # one text an id: the smallest. A count, not row_number(): Spark would cut down that one before its shuffle, which then is another
    # than that of the join below
    order = Window.partitionBy("k").orderBy("text", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    heads = base.withColumn("n", F.count("*").over(order)).where("n = 1")
    sent = heads.join(pairs, F.col("k") == F.col("at")).select("before", F.substring(F.col("text"), F.lit(1), F.col("most")).alias("start"), F.array_distinct(F.transform(chosen(F.col("text"), k, w), hash_of)).alias("c"))
    here = base.join(sent, F.col("k") == F.col("before")).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")), F.substring(F.col("start"), F.lit(1), F.col("half")))
    # transforms of one-row arrays hold each step, so that none is computed once more for each mention
    row = here.select("doc_id", "n_chars", F.transform(F.array(F.struct(F.col("text").alias("a"), edited.alias("b"), F.col("c"))), lambda s: F.struct(
        F.sha2(s["b"].cast("binary"), 256).alias("edited_sha256"), chosen(s["a"], k, w).alias("a"), chosen(s["b"], k, w).alias("b"), s["c"].alias("c"))).alias("s"))
    out = row.select("doc_id", "n_chars", F.transform("s", lambda s: F.struct(
        s["edited_sha256"].alias("edited_sha256"), written(s["a"]).alias("fingerprint"), written(s["b"]).alias("edited_fingerprint"),
        F.array_distinct(F.transform(s["a"], hash_of)).alias("a"), F.array_distinct(F.transform(s["b"], hash_of)).alias("b"), s["c"].alias("c"))).alias("s"))
    out = out.select("doc_id", "n_chars", F.transform("s", lambda s: F.struct(
        s["edited_sha256"].alias("edited_sha256"), s["fingerprint"].alias("fingerprint"), s["edited_fingerprint"].alias("edited_fingerprint"),
        likeness(s["a"], s["b"]).alias("near_edited"), likeness(s["a"], s["c"]).alias("near_next"))).alias("s"))
    # not inline(): from that Spark would infer a filter, and compute all once more for it
    return out.select("doc_id", "n_chars", F.inline_outer("s"))
