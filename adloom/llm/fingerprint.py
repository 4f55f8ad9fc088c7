"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Shingles are five consecutive words. Each shingle is hashed once; the high bits of the
hash name one of ``BINS`` bins, and every bin keeps its least hash. An empty bin takes the
value of a bin that is not empty, found along a pseudo-random sequence of its own (optimal
densification), so that two texts agree in it as often as in any other bin. Of each bin's
value the low ``BITS`` bits are stored, packed as hexadecimal digits. Two values agree by
chance once in ``2 ** BITS``; the estimate of the Jaccard similarity is corrected for it.

Defined results: a text of one to four words has its whole sequence as its only shingle;
null, empty and wordless texts have a fingerprint of zeros. The next document is the one
with the next lower id, rows without an id coming last; rows with the same id follow by a
hash of their text, and rows that are equal in both share one place in the order, so all
get the same result. The only document of a table is followed by itself. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm import common as C

SHINGLE = 5
BINS_LOG, BITS = 8, 4
BINS = 1 << BINS_LOG
#: Random probes of an empty bin, before the bins that are left are ranked at once.
PROBES = 10
#: Fixed value: the bytes between words, space and tab to carriage return.
GAP = "[\\x20\\x09-\\x0D]+"
EDGE = " \t\n\x0b\f\r"
KEYS = ("_k1", "_k2")
#: Stands for a missing id; the smallest long is read as one.
NO_ID = -(1 << 63)
#: A bin's largest hash, which stands for "empty" until it is filled.
_SHIFT = 64 - BINS_LOG
_LAST = (1 << _SHIFT) - 1


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of a text column; helper columns are dropped again."""
    a, b = f"_{name}_a", f"_{name}_b"
    words = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(EDGE)), GAP)
    rows = rows.withColumn(a, F.transform(words, lambda w: F.xxhash64(w)))
    some = F.col(text).isNotNull() & (F.btrim(text, F.lit(EDGE)) != "")
    short = F.when(some, F.array(F.xxhash64(F.array_join(F.transform(a, lambda h: F.hex(h)), " "))))
    shingles = F.when(
        F.size(a) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(0), F.size(a) - SHINGLE),
            lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(SHINGLE))),
        ),
    ).otherwise(F.coalesce(short, F.array().cast("array<bigint>")))
    # With the last hash of every bin added and all sorted, a bin's first is its least.
    ordered = F.sort_array(F.concat(shingles, F.array(*(last_of(i) for i in range(BINS)))))
    rows = rows.withColumn(b, ordered).drop(a)
    firsts = F.filter(
        b, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(b, i - 1), _SHIFT))
    )
    rows = rows.withColumn(a, firsts).drop(b)
    rows = rows.withColumn(b, F.transform(a, lambda x, i: densified(a, x, i))).drop(a)
    low = (1 << BITS) - 1
    digit = F.substring(F.hex(F.lit(1 << BITS)), 2, BITS // 4)
    packed = F.array_join(
        F.transform(
            b,
            # Mixed with the bin's number: a value that fills many bins agrees by chance in
            # each of them independently.
            lambda x, i: F.when(x.isNull(), digit).otherwise(
                F.substring(
                    F.hex(F.xxhash64(x, i).bitwiseAND(F.lit(low)) + (1 << BITS)), 2, BITS // 4
                )
            ),
        ),
        "",
    )
    return rows.withColumn(name, packed).drop(b)


def last_of(bin_number: int) -> Column:
    return F.lit(((bin_number - BINS // 2) << _SHIFT) | _LAST)


def filled(bins: str, at: Column) -> Column:
    """The value of a bin, or null if it is empty."""
    value = F.get(bins, at)
    return F.when(value.bitwiseAND(F.lit(_LAST)) != _LAST, value)


def densified(bins: str, value: Column, at: Column) -> Column:
    """A bin's own value or a borrowed one; null if all bins are empty."""
    own = F.when(value.bitwiseAND(F.lit(_LAST)) != _LAST, value)
    probes = [filled(bins, F.pmod(F.xxhash64(at, F.lit(t)), F.lit(BINS)).cast("int"))
              for t in range(PROBES)]
    # What is left of the sequence: the filled bin with the least rank for this bin.
    ranked = F.filter(
        F.transform(
            bins, lambda x, j: F.struct(F.xxhash64(at, j, F.lit(-1)).alias("r"), x.alias("v"))
        ),
        lambda s: s["v"].bitwiseAND(F.lit(_LAST)) != _LAST,
    )
    return F.coalesce(own, *probes, F.array_min(ranked)["v"])


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints."""
    width = BITS // 4
    at = F.sequence(F.lit(1), F.lit(BINS * width), F.lit(width))
    equal = F.size(F.filter(at, lambda i: F.col(a).substr(i, F.lit(width)) == F.col(b).substr(i, F.lit(width))))
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (equal / BINS - chance) / (1.0 - chance))


def key_columns() -> tuple[Column, Column]:
    return (
        F.coalesce("doc_id", F.lit(NO_ID)).alias(KEYS[0]),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(KEYS[1]),
    )


def successors(keys: DataFrame) -> DataFrame:
    """For each key the next lower one (``_n1``, ``_n2``), and for the last the first.

    Keys are cut into ranges; the first key of each range, one per range, is all that the
    driver sees.
    """
    falling = [F.desc(k) for k in KEYS]
    ranges = C.staged(
        keys.distinct().repartitionByRange(*falling).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    heads = {r["_range"]: r["head"] for r in
             ranges.groupBy("_range").agg(F.max(F.struct(*KEYS)).alias("head")).collect()}
    order = sorted(heads)
    following = [(r, *heads[after]) for r, after in zip(order, order[1:] + order[:1])]
    after = keys.sparkSession.createDataFrame(following, "_range int, _h1 long, _h2 long")
    inside = Window.partitionBy("_range").orderBy(*falling)
    return (
        ranges.withColumns({"_l1": F.lead(KEYS[0]).over(inside), "_l2": F.lead(KEYS[1]).over(inside)})
        .join(F.broadcast(after), "_range")
        .select(
            *KEYS,
            F.when(F.col("_l2").isNull(), F.col("_h1")).otherwise(F.col("_l1")).alias("_n1"),
            F.when(F.col("_l2").isNull(), F.col("_h2")).otherwise(F.col("_l2")).alias("_n2"),
        )
    )


def edited(docs: DataFrame, following: DataFrame) -> DataFrame:
    """Each text with its last third replaced by the start of the next document.

    Both joins need the texts by their own key, so they are shuffled once.
    """
    rows = docs.select(C.text_or_empty(), *key_columns())
    sizes = rows.select(*KEYS, F.char_length("text").alias("_n")).distinct()
    wanted = following.join(sizes, list(KEYS)).select(
        F.col(KEYS[0]).alias("_for1"), F.col(KEYS[1]).alias("_for2"), "_n", "_n1", "_n2"
    )
    third = F.floor(F.col("_n") / 3).cast("int")
    heads = (
        rows.join(wanted, (F.col(KEYS[0]) == F.col("_n1")) & (F.col(KEYS[1]) == F.col("_n2")))
        .select("_for1", "_for2", F.substring("text", F.lit(1), third).alias("_head"))
        .groupBy(F.col("_for1").alias(KEYS[0]), F.col("_for2").alias(KEYS[1]))
        .agg(F.first("_head").alias("_head"))
    )
    size = F.char_length("text")
    kept = F.substring("text", F.lit(1), (size - F.floor(size / 3)).cast("int"))
    return rows.join(heads, list(KEYS)).withColumn("_edited", F.concat(kept, "_head"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and how alike they look."""
    following = C.staged(successors(docs.select(*key_columns())), "following")
    rows = edited(docs, following).select(
        *KEYS,
        "text",
        "_edited",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
    )
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint")
    made = C.staged(rows.drop("text", "_edited"), "minhash")
    own = made.groupBy(*(F.col(k).alias(n) for k, n in zip(KEYS, ("_n1", "_n2")))).agg(
        F.max("fingerprint").alias("_next")
    )
    after = following.join(own, ["_n1", "_n2"]).select(*KEYS, "_next")
    return made.join(after, list(KEYS)).select(
        F.nullif(F.col(KEYS[0]), F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_next").alias("near_next"),
    )
