"""The derived-column expression language: a whitelisted grammar turned into Column expressions.

Arithmetic, comparisons, & | ~, the functions below, column names and numbers; `^` and `**` are powers. max and min take
two arguments, element by element; mean and std (population) are taken over the whole table. Sums, differences and
products are DOUBLE, so whole numbers don't overflow. Nothing is ever evaluated as Python.
"""

from __future__ import annotations

import ast

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


class ExpressionError(ValueError):
    """The text isn't an expression of the language, or names a column that isn't there."""


_UNARY = {"sqrt": F.sqrt, "log10": F.log10, "log": F.ln, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "abs": F.abs}
#: Where the logarithm and the root have no value the result is NULL.
_DOMAIN = {"sqrt": lambda c: c >= 0, "log10": lambda c: c > 0, "log": lambda c: c > 0}
_WHOLE = {"mean": F.avg, "std": F.stddev_pop}
_POWER = "**"


def _parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.replace("^", _POWER).strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e


def _both(a: Column, b: Column, pick) -> Column:
    """pick of a and b, NULL if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


class _Compiler:
    """Walks a parsed expression; aggregates over the whole table are gathered and named on the way."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.whole: dict[str, Column] = {}

    def column(self, n: ast.expr, inside: bool = False) -> Column:
        match n:
            case ast.Constant(value=bool() | int() | float() as v):
                return F.lit(v)
            case ast.Name(id=name):
                if name not in self.columns:
                    raise ExpressionError(f"no column {name!r}")
                return F.col(f"`{name}`")
            case ast.UnaryOp(op=op, operand=x):
                return self.signed(op, self.column(x, inside))
            case ast.BinOp(left=a, op=op, right=b):
                return self.binary(op, self.column(a, inside), self.column(b, inside))
            case ast.Compare(left=a, ops=ops, comparators=rest):
                return self.chain(a, ops, rest, inside)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self.call(name, args, inside)
        raise ExpressionError(f"{type(n).__name__} isn't allowed")

    def signed(self, op: ast.unaryop, x: Column) -> Column:
        match op:
            case ast.USub():
                return -x.cast("double")
            case ast.UAdd():
                return x
            case ast.Invert() | ast.Not():
                return ~x
        raise ExpressionError("unknown sign")

    def binary(self, op: ast.operator, a: Column, b: Column) -> Column:
        zero = F.nullif(b, F.lit(0))
        match op:
            case ast.Add():
                return a.cast("double") + b
            case ast.Sub():
                return a.cast("double") - b
            case ast.Mult():
                return a.cast("double") * b
            case ast.Div():
                return a / zero
            case ast.FloorDiv():
                return F.floor(a / zero)
            case ast.Mod():
                return a % zero
            case ast.Pow():
                return F.pow(a, b)
            case ast.BitAnd():
                return a & b
            case ast.BitOr():
                return a | b
        raise ExpressionError(f"{type(op).__name__} isn't allowed")

    def chain(self, first: ast.expr, ops: list, rest: list, inside: bool) -> Column:
        out, a = None, self.column(first, inside)
        for op, node in zip(ops, rest, strict=True):
            b = self.column(node, inside)
            match op:
                case ast.Gt():
                    now = a > b
                case ast.GtE():
                    now = a >= b
                case ast.Lt():
                    now = a < b
                case ast.LtE():
                    now = a <= b
                case ast.Eq():
                    now = a == b
                case ast.NotEq():
                    now = a != b
                case _:
                    raise ExpressionError(f"{type(op).__name__} isn't allowed")
            out, a = now if out is None else out & now, b
        return out

    def call(self, name: str, args: list[ast.expr], inside: bool) -> Column:
        if name in _UNARY and len(args) == 1:
            x = self.column(args[0], inside)
            return F.when(_DOMAIN[name](x), _UNARY[name](x)) if name in _DOMAIN else _UNARY[name](x)
        if name in ("max", "min") and len(args) == 2:
            return _both(self.column(args[0], inside), self.column(args[1], inside), F.greatest if name == "max" else F.least)
        if name in _WHOLE and len(args) == 1:
            if inside:
                raise ExpressionError(f"{name} inside another mean or std")
            key = f"__whole_{len(self.whole)}"
            self.whole[key] = _WHOLE[name](self.column(args[0], True))
            return F.col(key)
        raise ExpressionError(f"no function {name} of {len(args)} argument(s)")


def derive(df: DataFrame, name: str, text: str, replace: bool = True) -> DataFrame:
    """df with the column name computed by the expression."""
    if not replace and name in df.columns:
        raise ExpressionError(f"column {name!r} is there already")
    compiler = _Compiler(df.columns)
    column = compiler.column(_parse(text))
    if not compiler.whole:
        return df.withColumn(name, column)
    # one row of aggregates, joined to every row
    whole = df.agg(*(c.alias(k) for k, c in compiler.whole.items()))
    return df.crossJoin(F.broadcast(whole)).withColumn(name, column).drop(*compiler.whole)


def derive_all(df: DataFrame, steps: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Applies the steps in order, later ones may use earlier columns; those that fail are skipped and reported."""
    skipped = []
    for name, text in steps:
        try:
            df = derive(df, name, text)
            df.schema  # noqa: B018  analysis finds wrong types
        except Exception as e:  # noqa: BLE001
            skipped.append(f"{name}: {e}")
    return df, skipped
