"""Licence expressions: parsed once per distinct string, evaluated natively.

``parse`` gives postfix order (ids, AND, OR). The exception of a WITH is dropped: it never changes a verdict.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lixora.functions.licenses import is_compound

BINDING = {"OR": 1, "AND": 2}
TOKEN = re.compile(r"[()]|[^ \t()]+")


def postfix(text: str, strict: bool = False) -> list[str] | None:
    """Postfix form of an expression. Lenient: what follows the first misplaced word is left out, and a text that
    is no expression at all is one id. Strict: null unless every word has its place. ( may stay open."""
    words, out, held = TOKEN.findall(text.strip(" \t\r\n")), [], []
    at, operand, with_done = 0, True, False
    while at < len(words):
        w = words[at]
        if operand:
            if w == "(":
                held.append(w)
            elif w in (")", "AND", "OR", "WITH"):
                break
            else:
                out.append(w)
                operand, with_done = False, False
        elif w == ")":
            if "(" not in held:
                break
            while (top := held.pop()) != "(":
                out.append(top)
            with_done = False
        elif w in BINDING:
            while held and BINDING.get(held[-1], 0) >= BINDING[w]:
                out.append(held.pop())
            held.append(w)
            operand = True
        elif w == "WITH" and not with_done:
            with_done = True
            if at + 1 < len(words) and words[at + 1] not in ("(", ")", "AND", "OR", "WITH"):
                at += 1
        else:
            break
        at += 1
    if operand or (strict and at < len(words)):
        return None if strict else [text]
    return out + [h for h in reversed(held) if h != "("]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else postfix(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parse_strict(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else postfix(t, strict=True))


def parse_expr(licenses: DataFrame, column: str = "license", strict: bool = False) -> DataFrame:
    """(column, rpn) of the distinct non-null values; a value that isn't compound is one leaf."""
    distinct = licenses.select(column).where(F.col(column).isNotNull()).distinct()
    if strict:
        return distinct.withColumn("rpn", _parse_strict(column))
    return distinct.withColumn("parsed", parse(column)).select(column, F.when(is_compound(F.col(column)), F.col("parsed")).otherwise(F.array(column)).alias("rpn"))


def is_operator(word: Column) -> Column:
    return word.isin("AND", "OR")


def expr_leaves(parsed: DataFrame, column: str = "license") -> DataFrame:
    """(column, leaf): the distinct ids of each parsed expression."""
    return parsed.select(column, F.explode(F.array_distinct(F.filter("rpn", lambda w: ~is_operator(w)))).alias("leaf"))


def fold(steps: Column, of: str = "boolean") -> Column:
    """Value of a postfix array of struct(op, value) over a stack. Booleans: three-valued OR and AND, null for
    unknown. Arrays: union and intersection."""
    sets = of.startswith("array")
    both, either = (F.array_intersect, F.array_union) if sets else (lambda a, b: a & b, lambda a, b: a | b)

    def step(stack: Column, s: Column) -> Column:
        n = F.size(stack)
        a, b = F.get(stack, n - 2), F.get(stack, n - 1)
        two = F.when(s["op"] == "AND", both(a, b)).otherwise(either(a, b))
        return F.when(s["op"].isNull(), F.concat(stack, F.array(s["value"]))).otherwise(F.concat(F.slice(stack, 1, F.greatest(n - 2, F.lit(0))), F.array(two)))

    return F.get(F.aggregate(steps, F.array().cast(f"array<{of}>"), step), F.lit(0))


def fold_expr(parsed: DataFrame, verdicts: DataFrame, columns: list[str], column: str = "license", keys: list[str] | None = None) -> DataFrame:
    """Fold leaf verdicts (leaf, *keys, *columns as booleans or arrays) over parsed (column, rpn, *keys): one row per
    expression."""
    keys = keys or []
    words = parsed.select(column, *keys, F.posexplode("rpn").alias("pos", "leaf"))
    words = words.join(verdicts, ["leaf", *keys], "left")
    op = F.when(is_operator(F.col("leaf")), F.col("leaf")).alias("op")
    whole = F.sort_array(F.collect_list(F.struct("pos", op, *columns))).alias("steps")
    value = lambda c: F.transform("steps", lambda s: F.struct(s["op"].alias("op"), s[c].alias("value")))
    folded = [fold(value(c), verdicts.schema[c].dataType.simpleString()).alias(c) for c in columns]
    return words.groupBy(column, *keys).agg(whole).select(column, *keys, *folded)
