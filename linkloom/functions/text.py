"""Forms of labels and tolerant reading of answers."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unicode_form(c: Column) -> Column:
    """Lower case; everything but letters, marks and digits of any script is one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition and case folding, which the engine doesn't have; Arrow batches."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def anchor_form(c: Column) -> Column:
    """Compatibility form, case folded; runs of anything but word characters are one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(nfkc(c), r"[^\p{L}\p{M}\p{N}_]+", "_"), F.lit("_"))


def slug(c: Column, length: int = 40) -> Column:
    """ASCII letters and digits with underscores, cut; a label without any becomes ``anchor_`` and ten digits of its hash."""
    plain = F.substring(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), 1, length)
    return F.when(plain != "", plain).otherwise(F.concat(F.lit("anchor_"), F.substring(F.sha2(c, 256), 1, 10)))


def keywords(c: Column, keys: list[str]) -> Column:
    """All keys in a text from left to right, the longest that fits at each place, none overlapping another."""
    ordered = sorted(keys, key=lambda k: (-len(k), k))
    return F.regexp_extract_all(c, F.lit("(" + "|".join(re.escape(k) for k in ordered) + ")"), F.lit(1))


def slot_form(c: Column, suffixes: list[str], aliases: dict[str, str]) -> Column:
    """A slot's value without punctuation, blanks and one of the suffixes at its end, aliases resolved."""
    bare = F.regexp_replace(nfkc(c), r"[\p{P}\p{S}\s]+", "")
    cut = F.regexp_replace(bare, "(?<=.)(?:" + "|".join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True)) + ")$", "") if suffixes else bare
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return F.coalesce(F.try_element_at(known, cut), cut) if known is not None else cut


def json_array(c: Column, element: str) -> tuple[Column, Column]:
    """The array in an answer, and what is wrong with it: null, ``surrounding text``, ``no array`` or ``damaged``.

    A code fence around the array is no fault; other text is, but the array is read all the same.
    """
    fenced = F.regexp_replace(F.trim(c), r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", "$1")
    body = F.regexp_extract(fenced, r"(?s)\[.*\]", 0)
    rows = F.from_json(F.nullif(body, F.lit("")), f"array<{element}>")
    wrong = F.when(c.isNull() | (body == ""), "no array").when(rows.isNull(), "damaged").when(F.trim(fenced) != body, "surrounding text")
    return rows, wrong


def enum_or_unknown(c: Column, known: list[str]) -> Column:
    """The value in lower case if it is one of the known ones, else ``unknown``."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*known), low).otherwise("unknown")


def word_runs(c: Column, most: int) -> Column:
    """All distinct runs of one to ``most`` words of a text whose words are parted by single blanks."""
    words = F.split(c, " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
    return F.when(c != "", F.array_distinct(runs))


def scored_choice(c: Column) -> tuple[Column, Column]:
    """The scores in an answer ``{"label": score, ...}`` within 0 to 100, and the label that alone has the highest."""
    scores = F.transform_values(F.map_filter(F.from_json(c, "map<string, double>"), lambda k, v: v.isNotNull()), lambda k, v: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)))
    top = F.map_keys(F.map_filter(scores, lambda k, v: v == F.array_max(F.map_values(scores))))
    return scores, F.when(F.size(top) == 1, F.get(top, 0))
