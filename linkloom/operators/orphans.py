"""References to records that do not exist, or not at the time of the reference.

A blocked Bloom filter of all parent keys, four bits of one 64-bit word a key, is built by one partial aggregation and
packed into slices of at most SLICE_WORDS words, one row each; its size follows the number of keys. Packed, it takes 8
bytes a word and BITS_PER_KEY bits a key. Up to BROADCAST_BYTES it is broadcast; a larger one stays partitioned by slice
and the references go to the slice of their key. A reference that misses a bit has no parent whatsoever. Only references
the filter lets pass take part in the exact join, which also checks order or validity in time.

A parent or a reference key that a third of all rows share is one row on the parent side (intervals are merged first),
and the reference side of a join is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS_PER_KEY = 12
#: Words of one slice: 512 KB in one row.
SLICE_WORDS = 1 << 16
#: The largest filter that is broadcast; it holds the bits of 89 million keys.
BROADCAST_BYTES = 1 << 27


def _word(words: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(words))


def _mask(*key: Column) -> Column:
    """Four bits of one word, from a second hash."""
    h = F.xxhash64(*key, F.lit(7))
    out = F.lit(0).cast("long")
    for k in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k * 8).bitwiseAND(F.lit(63)).cast("int")))
    return out


def words_for(n_keys: int, bits_per_key: float = BITS_PER_KEY) -> int:
    return max(64, -(-int(n_keys * bits_per_key) // 64))


def bloom_slices(parents: DataFrame, key: list[str], words: int) -> DataFrame:
    """The filter as rows ``slice, bits``, bits an array with every word of the slice."""
    cols = [F.col(c) for c in key]
    filled = parents.select(_word(words, *cols).alias("word"), _mask(*cols).alias("bits"))
    # Words without a key are rows as well, so that a word's place in the sorted array is its number.
    empty = parents.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    by_word = filled.unionAll(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    placed = by_word.select(F.floor(F.col("word") / SLICE_WORDS).alias("slice"), F.struct(F.pmod("word", F.lit(SLICE_WORDS)).alias("at"), "bits").alias("w"))
    return placed.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bits"))


def probe(references: DataFrame, slices: DataFrame, key: list[str], words: int, *, broadcast: bool) -> DataFrame:
    """The references with ``maybe``: false where the filter proves that no parent has the key."""
    cols = [F.col(c) for c in key]
    at = references.withColumn("_w", _word(words, *cols)).withColumn("_s", F.floor(F.col("_w") / SLICE_WORDS))
    filter_ = slices.select(F.col("slice").alias("_s"), F.col("bits").alias("_bits"))
    probed = at.join(F.broadcast(filter_) if broadcast else filter_, "_s", "left")
    bits = F.coalesce(F.get("_bits", F.pmod("_w", F.lit(SLICE_WORDS)).cast("int")), F.lit(0).cast("long"))
    return probed.select(*references.columns, (bits.bitwiseAND(_mask(*cols)) == _mask(*cols)).alias("maybe"))


def merged_validity(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Disjoint periods ``k, since, until`` in which at least one row of a key holds; until null: for ever.

    Rows with a null key or start hold never. Periods that end before they begin hold never.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    r = rows.select(F.col(key).alias("k"), F.col(start).cast("timestamp_ntz").alias("since"), F.coalesce(F.col(end).cast("timestamp_ntz"), far).alias("until"))
    r = r.filter("k is not null and since is not null and until > since").distinct()
    before = Window.partitionBy("k").orderBy("since", "until").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("k").orderBy("since", "until")
    marked = r.withColumn("fresh", (F.col("since") > F.coalesce(F.max("until").over(before), F.lit("0001-01-01").cast("timestamp_ntz"))).cast("int"))
    islands = marked.withColumn("island", F.sum("fresh").over(order))
    return islands.groupBy("k", "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")


def find_orphans(references: DataFrame, parents: DataFrame, *, n_parents: int, bits_per_key: float = BITS_PER_KEY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """References that find no parent.

    references: ``field, record_id, ref_id, seq, at, period``; ``parents``: ``field, k, seq, since, until``. A parent
    with a seq is found by a reference with a larger seq; one with a period by a reference whose ``at`` lies in it. A
    null ``ref_id`` names nothing and is no reference; a null ``at`` or ``seq`` finds nothing. Parents without a key are
    left out. Result: the reference rows with these six columns; repeated ones stay repeated, further columns are dropped.

    n_parents only sizes the filter; the result is the same whatever the size.
    """
    cols = ["field", "record_id", "ref_id", "seq", "at", "period"]
    parents = parents.filter("k is not null")
    words = words_for(n_parents, bits_per_key)
    slices = bloom_slices(parents.select(F.col("field"), F.col("k").alias("ref_id")), ["field", "ref_id"], words)
    probed = probe(references.select(*cols).filter("ref_id is not null"), slices, ["field", "ref_id"], words, broadcast=8 * words <= broadcast_bytes)
    absent = probed.filter(~F.col("maybe")).select(*cols)
    maybe = probed.filter("maybe").select(*cols)
    p = parents.select(*[F.col(c).alias(f"p_{c}") for c in ("field", "k", "seq", "since", "until")])
    valid = F.when(F.col("p_seq").isNotNull(), F.col("p_seq") < F.col("seq")).otherwise((F.col("p_since") <= F.col("at")) & (F.col("at") < F.col("p_until")))
    dangling = maybe.join(p, (F.col("field") == F.col("p_field")) & (F.col("ref_id") == F.col("p_k")) & valid, "left_anti")
    return absent.unionByName(dangling)


def orphan_report(references: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans by field and period: ``field, period, n_refs, n_orphans``."""
    by = ["field", "period"]
    both = references.filter("ref_id is not null").select(*by, F.lit(0).alias("o")).unionAll(orphans.select(*by, F.lit(1).alias("o")))
    return both.groupBy(*by).agg(F.count_if(F.col("o") == 0).alias("n_refs"), F.count_if(F.col("o") == 1).alias("n_orphans"))
