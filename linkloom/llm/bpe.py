"""Encoding of a corpus with a public byte-level BPE vocabulary.

Short texts are encoded as they are. Long ones are cut into blocks of equal length wherever that falls, the blocks are
encoded over the cluster, and neighbours are put together as a tree, level by level. At each join the text around the
cut is encoded again, in a window that grows until both its ends agree with what the sides have:

* The tokenizer first splits a text into pieces. Some places end a piece whatever stands around them (a change between
  letters, digits and other signs, white space after a character). The window reaches from the last such place on the
  left to the first one on the right; beyond them both sides are what they are in the whole.
* A stretch without such a place (a long run of letters, as Chinese prose is) is one piece. There the window is a number
  of tokens on either side and doubles until its outer tokens are those of the sides. A sequence of BPE tokens is the
  encoding of its bytes if every two neighbours are, so agreement at both ends makes the whole exact.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split pattern of the vocabulary; white space by its Unicode property, as in the encoder's own engine. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a file of ranks; the same bytes in every Python worker, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_piece(enc, data: bytes) -> list[int]:
    """BPE of bytes that are not split any further."""
    return enc._encode_single_piece(data) if data else []


def glue(enc, left: list[int], right: list[int], start: int = 8) -> list[int]:
    """The encoding of the bytes of both sides, each the encoding of its own."""
    if not left or not right:
        return left + right
    k = start
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = encode_piece(enc, enc.decode_bytes(left[-a:]) + enc.decode_bytes(right[:b]))
        if (a == len(left) or window[:2] == left[-a:][:2]) and (b == len(right) or window[-2:] == right[:b][-2:]):
            return left[: len(left) - a] + window + right[b:]
        k *= 2


_L, _N = r"\p{L}", r"\p{N}"
#: Places that end a piece in any context: no letter follows an apostrophe there, as "'s" is a piece of its own.
_SURE = rf"(?<=\P{{White_Space}})(?=\p{{White_Space}})|(?<={_L})(?=[^\p{{White_Space}}{_L}])|(?<={_N})(?=[^\p{{White_Space}}{_N}])|(?<=[^\p{{White_Space}}{_L}{_N}'])(?=[{_L}{_N}])"
#: One piece, or a part of one.
_ONE = rf" ?(?:{_L}+|{_N}+|[^\p{{White_Space}}{_L}{_N}]+)"
#: A window of so many characters is encoded as a whole.
WINDOW = 512


@functools.lru_cache(maxsize=1)
def _places():
    import regex

    return regex.compile(_SURE), regex.compile(f"(?r){_SURE}"), regex.compile(_ONE)


class Part(NamedTuple):
    """A stretch of a text: its ids, and the text and number of tokens before its first and after its last sure place.
    Without such a place all of it is head and tail."""

    ids: list[int]
    head: str
    n_head: int
    tail: str
    n_tail: int
    solid: bool


def leaf(enc, text: str) -> Part:
    ids = enc.encode_ordinary(text)
    first, last, _ = _places()
    a = first.search(text, 1)
    if a is None:
        return Part(ids, text, len(ids), text, len(ids), True)
    b = last.search(text)
    head, tail = text[: a.start()], text[b.start() :]
    return Part(ids, head, len(enc.encode_ordinary(head)), tail, len(enc.encode_ordinary(tail)), False)


def join(enc, left: Part, right: Part) -> Part:
    """The encoding of both texts together."""
    if _places()[0].match(left.tail[-1] + right.head[0], 1):
        return Part(left.ids + right.ids, left.head, left.n_head, right.tail, right.n_tail, False)
    tail, head = left.ids[len(left.ids) - left.n_tail :], right.ids[: right.n_head]
    text = left.tail + right.head
    if len(text) > WINDOW and _places()[2].fullmatch(text):
        middle = glue(enc, tail, head)
    else:
        middle = enc.encode_ordinary(text)
    ids = left.ids[: len(left.ids) - left.n_tail] + middle + right.ids[right.n_head :]
    n = len(middle)
    return Part(
        ids,
        text if left.solid else left.head,
        n if left.solid else left.n_head,
        text if right.solid else right.tail,
        n if right.solid else right.n_tail,
        left.solid and right.solid,
    )


def join_all(enc, parts: list[Part]) -> Part:
    """Neighbouring parts put together pairwise, as a tree."""
    while len(parts) > 1:
        parts = [join(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode_text(enc, text: str, size: int) -> list[int]:
    """The same path on one machine: cut, encode, put together."""
    return join_all(enc, [leaf(enc, text[i : i + size]) for i in range(0, len(text), size)]).ids if text else []


#: Neighbours that one task puts together at a level.
FAN = 32


def encode_corpus(documents: DataFrame, key: str, text: str, ranks: str, *, long_chars: int = 2048, block_chars: int = 1024, fan: int = FAN) -> DataFrame:
    """Token ids of every document: ``key, ids``; null and empty texts have an empty list.

    ranks: path of the vocabulary file on every executor. Texts above long_chars characters go through the tree: blocks
    of block_chars, of which a task joins ``fan`` neighbours at each level. The result depends on none of the three.
    Repeated rows stay repeated; further columns are ignored.
    """
    kind = documents.schema[key].dataType
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    is_long = F.length("t") > long_chars

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        enc = encoder(ranks)
        return pd.Series([enc.encode_ordinary(t) if t else [] for t in texts])

    short = rows.filter(~F.coalesce(is_long, F.lit(False))).select("k", encode("t").alias("ids"))
    # Equal rows are encoded once and repeated at the end.
    long = rows.filter(is_long).groupBy("k", F.xxhash64("t").alias("h")).agg(F.any_value("t").alias("t"), F.count(F.lit(1)).alias("n"))
    longest = rows.agg(F.max(F.length("t"))).head()[0] or 0
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / block_chars).cast("int"))
    blocks = long.select("k", "h", "n", "t", F.explode(starts).alias("at"))
    blocks = blocks.select("k", "h", "n", "at", F.expr(f"substring(t, at * {block_chars} + 1, {block_chars})").alias("t"))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks)
        for batch in batches:
            parts = [leaf(enc, t) for t in batch["t"]]
            yield pd.concat([batch[["k", "h", "n", "at"]].reset_index(drop=True), pd.DataFrame(parts, columns=Part._fields)], axis=1)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        enc = encoder(ranks)
        part = join_all(enc, [Part(list(map(int, r.ids)), r.head, int(r.n_head), r.tail, int(r.n_tail), bool(r.solid)) for r in group.itertuples()])
        first = group.iloc[:1][["k", "h", "n", "at"]].reset_index(drop=True)
        return pd.concat([first.assign(at=first["at"] // fan), pd.DataFrame([part], columns=Part._fields)], axis=1)

    k = T.StructField("k", kind)
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    fields = [k, T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("at", T.IntegerType()), ids]
    fields += [T.StructField(name, t()) for name, t in (("head", T.StringType), ("n_head", T.IntegerType), ("tail", T.StringType), ("n_tail", T.IntegerType), ("solid", T.BooleanType))]
    schema = T.StructType(fields)
    if longest <= long_chars:
        return short.select(F.col("k").alias(key), "ids")
    level = blocks.repartition("k", "h", "at").mapInPandas(leaves, schema)
    left = -(-longest // block_chars)
    while left > 1:
        level = level.withColumn("up", F.floor(F.col("at") / fan)).groupBy("k", "h", "up").applyInPandas(lambda pdf: joined(pdf.drop(columns="up")), schema)
        left = -(-left // fan)
    back = level.select("k", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("k", "ids")
    return short.unionByName(back).select(F.col("k").alias(key), "ids")
