"""The closed expression language, compiled to columns.

Arithmetic, comparisons, and/or, and the functions min, max, exp, log, sqrt, abs,
tanh, clip and where over an allow-list of names.  Parsing is Python's; nothing
else of Python is reachable.  Faults raise where the session runs in ANSI mode.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

def _power(a, b):
    low, whole = (a == 0) & (b < 0), b == F.floor(b)
    ok = F.abs(b) <= MOST_POWER
    return F.when(~ok, F.raise_error(F.lit("an exponent out of bounds")).cast("double")).when((a < 0) & ~whole, F.raise_error(F.lit("a fractional power of a negative number")).cast("double")).when(low, F.raise_error(F.lit("a negative power of zero")).cast("double")).otherwise(F.pow(a, b))


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: _power}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


MOST_POWER = 64  # Fixed value: largest size of an exponent


def _checked(ok: Column, value: Column, fault: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(fault)).cast("double"))


_CALLS = {
    "min": ((2, 8), lambda *a: F.least(*a)),
    "max": ((2, 8), lambda *a: F.greatest(*a)),
    "exp": ((1, 1), lambda x: _checked(x <= 700, F.exp(x), "exp overflows")),
    "log": ((1, 2), lambda x, b=None: _checked(x > 0, F.log(x) if b is None else _checked((b > 0) & (b != 1), F.log(x) / F.log(b), "a base of log that is not positive, or 1"), "log of a number that is not positive")),
    "sqrt": ((1, 1), lambda x: _checked(x >= 0, F.sqrt(x), "square root of a negative number")),
    "abs": ((1, 1), F.abs),
    "tanh": ((1, 1), F.tanh),
    "clip": ((3, 3), lambda x, a, b: _checked(a <= b, F.least(F.greatest(x, a), b), "clip with its bounds the wrong way round")),
    "where": ((3, 3), lambda c, a, b: F.when(c, a).otherwise(b)),
}


def compile_expression(text: str, names: Mapping[str, Column]) -> Column:
    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return build(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            x = build(node.operand)
            return -x if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [build(x) for x in (node.left, *node.comparators)]
            parts = [_COMPARE[type(o)](a, b) for o, a, b in zip(node.ops, sides, sides[1:])]
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out
        if isinstance(node, ast.BoolOp):
            out, *rest = (build(v) for v in node.values)
            for v in rest:
                out = out & v if isinstance(node.op, ast.And) else out | v
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            (low, high), f = _CALLS[node.func.id]
            if not low <= len(node.args) <= high:
                raise ValueError(f"{node.func.id} takes {low} to {high} arguments")
            return f(*map(build, node.args))
        raise ValueError(f"not part of the expression language: {ast.dump(node)[:80]}")

    return build(ast.parse(text, mode="eval"))
