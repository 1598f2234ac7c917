"""Word and text similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters stripped from the ends of a word; confusable letters.
EDGES = ".,!?;:\"'"
MIRROR = {"b": "d", "d": "b", "p": "q", "q": "p", "m": "w", "w": "m"}


def normalise(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(EDGES))


def alnum(word: Column) -> Column:
    """Letters and digits of a token."""
    return F.regexp_replace(word, r"[^\p{L}\p{N}]", "")


def _chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence, row by row over an array of lengths."""
    left, right = _chars(a), _chars(b)
    zeros = F.array_repeat(F.lit(0), F.size(right) + 1)

    def next_row(row: Column, c: Column) -> Column:
        # The new row grows from the left; its length says which cell comes next.
        def cell(new: Column, d: Column) -> Column:
            j = F.size(new)
            best = F.when(c == d, F.get(row, j - 1) + 1).otherwise(
                F.greatest(F.get(row, j), F.element_at(new, -1)))
            return F.concat(new, F.array(best))

        return F.aggregate(right, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(left, zeros, next_row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the common subsequence over both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.try_divide(200.0 * lcs_length(a, b), total))


def prefix_score(a: Column, b: Column) -> Column:
    """100 equal, 80 one starts the other, else 0."""
    return (F.when(a == b, 100.0).when(F.startswith(a, b) | F.startswith(b, a), 80.0).otherwise(0.0))


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks (longest block first, then left and right of it)."""
    return pd.Series([SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


OPCODES = T.ArrayType(T.StructType([
    T.StructField("tag", T.StringType()), T.StructField("i1", T.IntegerType()),
    T.StructField("i2", T.IntegerType()), T.StructField("j1", T.IntegerType()),
    T.StructField("j2", T.IntegerType())]))


@F.pandas_udf(OPCODES)
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits that turn ``a`` into ``b``."""
    return pd.Series([
        [dict(zip(("tag", "i1", "i2", "j1", "j2"), op))
         for op in SequenceMatcher(None, x, y, autojunk=False).get_opcodes()]
        for x, y in zip(a, b)])


def accepts(clean: Column, target: Column, ratio: Column) -> Column:
    """Length-aware rule: short words must be equal, longer ones similar."""
    shorter = F.least(F.length(clean), F.length(target))
    prefix = F.startswith(target, clean) | F.startswith(clean, target)
    return (F.when(shorter <= 3, clean == target)
            .when(prefix, True)
            .when(shorter <= 5, ratio >= 0.80)
            .otherwise(ratio >= 0.70))


def ratio_of(ops: Column, a: Column, b: Column) -> Column:
    equal = F.aggregate(F.filter(ops, lambda o: o["tag"] == "equal"), F.lit(0),
                        lambda n, o: n + o["i2"] - o["i1"])
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(F.try_divide(2.0 * equal, total))


def _replaced(ops: Column, a: Column, b: Column) -> Column:
    """Both sides of every replaced block."""
    return F.transform(F.filter(ops, lambda o: o["tag"] == "replace"), lambda o: F.struct(
        F.substring(a, o["i1"] + 1, o["i2"] - o["i1"]).alias("was"),
        F.substring(b, o["j1"] + 1, o["j2"] - o["j1"]).alias("now")))


def transpositions(ops: Column, a: Column, b: Column) -> Column:
    """Replaced blocks made of the same letters in another order."""
    def same_letters(p: Column) -> Column:
        return ((p["was"] != p["now"]) & (F.length(p["was"]) == F.length(p["now"]))
                & (F.array_sort(F.split(p["was"], "")) == F.array_sort(F.split(p["now"], ""))))

    return F.size(F.filter(_replaced(ops, a, b), same_letters))


def mirrored(ops: Column, a: Column, b: Column) -> Column:
    """Single letters replaced by their mirror image."""
    pairs = F.array(*[F.lit(x + y) for x, y in MIRROR.items()])
    return F.size(F.filter(_replaced(ops, a, b),
                           lambda p: F.array_contains(pairs, F.concat(p["was"], p["now"]))))


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def typing_errors(reference: Column, typed: Column, ops: Column) -> dict[str, Column]:
    """Error profile of a typed text; ``ops`` are the opcodes of the pair."""
    error = 1.0 - ratio_of(ops, reference, typed)
    return {
        "simulation_error_rate": error,
        "words_modified_count": F.abs(_word_count(reference) - _word_count(typed)),
        "transposition_count": transpositions(ops, reference, typed),
        "mirror_error_count": mirrored(ops, reference, typed),
        "phonetic_error_count": F.lit(0),
        "modification_proportion": error,
    }
