"""Numeric value of arithmetic text, from a white list of operators."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from evalspark.functions import text as T

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
        return float(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        value = _value(node.operand)
        return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp):
        left, right = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow):
            return float(left**right)
        return _BINARY[type(node.op)](left, right)
    raise ValueError("not an arithmetic expression")


def _evaluate(text: str | None) -> float | None:
    if text is None or not any(ch.isdigit() for ch in text):
        return None
    try:
        return _value(ast.parse(text, mode="eval").body)
    except (ValueError, SyntaxError, KeyError, TypeError, ArithmeticError, RecursionError, MemoryError):
        return None


@F.pandas_udf(ST.DoubleType())
def evaluate(texts: pd.Series) -> pd.Series:
    """Value of a text made of numbers, ``+ - * / **`` and parentheses; NULL for anything else."""
    return texts.map(_evaluate).astype("Float64")


def same_maths(a: Column, b: Column, a_value: Column, b_value: Column) -> Column:
    """Equal text ignoring case and outer space, or values less than 1e-6 apart."""
    same_text = T.strip(F.lower(a)) == T.strip(F.lower(b))
    return same_text | F.coalesce(F.abs(a_value - b_value) < 1e-6, F.lit(False))
