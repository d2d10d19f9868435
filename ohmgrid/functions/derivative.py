"""Symbolic derivatives of formula terms in + - * / ^ exp log sqrt, as column expressions."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE, _ZERO = ast.Constant(1.0), ast.Constant(0.0)
_FUNCTIONS = {"exp": F.exp, "log": F.log, "sqrt": F.sqrt}


def parse(term: str) -> ast.expr:
    """The term's tree; ``I(...)`` counts as brackets, ``x:z`` as a product."""
    return ast.parse(term.replace("^", "**").replace(":", "*"), mode="eval").body


def _is(node: ast.expr, value: float) -> bool:
    return isinstance(node, ast.Constant) and node.value == value


def _add(a: ast.expr, b: ast.expr) -> ast.expr:
    return b if _is(a, 0) else a if _is(b, 0) else ast.BinOp(a, ast.Add(), b)


def _sub(a: ast.expr, b: ast.expr) -> ast.expr:
    return a if _is(b, 0) else ast.BinOp(a, ast.Sub(), b)


def _mul(a: ast.expr, b: ast.expr) -> ast.expr:
    if _is(a, 0) or _is(b, 0):
        return _ZERO
    return b if _is(a, 1) else a if _is(b, 1) else ast.BinOp(a, ast.Mult(), b)


def _div(a: ast.expr, b: ast.expr) -> ast.expr:
    return _ZERO if _is(a, 0) else a if _is(b, 1) else ast.BinOp(a, ast.Div(), b)


def _pow(a: ast.expr, b: ast.expr) -> ast.expr:
    return _ONE if _is(b, 0) else a if _is(b, 1) else ast.BinOp(a, ast.Pow(), b)


def _call(name: str, a: ast.expr) -> ast.expr:
    return ast.Call(ast.Name(name), [a], [])


def derive(node: ast.expr, v: str) -> ast.expr:
    """The derivative by the layer ``v``; a form that isn't supported raises ``ValueError``."""
    match node:
        case ast.Constant():
            return _ZERO
        case ast.Name(id=name):
            return _ONE if name == v else _ZERO
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return _sub(_ZERO, derive(a, v))
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return _add(derive(a, v), derive(b, v))
        case ast.BinOp(left=a, op=ast.Sub(), right=b):
            return _sub(derive(a, v), derive(b, v))
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return _add(_mul(derive(a, v), b), _mul(a, derive(b, v)))
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return _sub(_div(derive(a, v), b), _div(_mul(a, derive(b, v)), _pow(b, ast.Constant(2.0))))
        case ast.BinOp(left=a, op=ast.Pow(), right=ast.Constant(value=k)):
            return _mul(_mul(ast.Constant(float(k)), _pow(a, ast.Constant(float(k) - 1))), derive(a, v))
        case ast.BinOp(op=ast.Pow(), left=a, right=b):
            return _mul(node, _add(_mul(derive(b, v), _call("log", a)), _div(_mul(b, derive(a, v)), a)))
        case ast.Call(func=ast.Name(id="I"), args=[a]):
            return derive(a, v)
        case ast.Call(func=ast.Name(id="exp"), args=[a]):
            return _mul(node, derive(a, v))
        case ast.Call(func=ast.Name(id="log"), args=[a]):
            return _div(derive(a, v), a)
        case ast.Call(func=ast.Name(id="sqrt"), args=[a]):
            return _div(derive(a, v), _mul(ast.Constant(2.0), node))
    raise ValueError(f"no analytic derivative of {ast.unparse(node)}")


def as_column(node: ast.expr) -> Column:
    match node:
        case ast.Constant(value=k):
            return F.lit(float(k))
        case ast.Name(id=name):
            return F.col(name).cast("double")
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -as_column(a)
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return as_column(a) + as_column(b)
        case ast.BinOp(left=a, op=ast.Sub(), right=b):
            return as_column(a) - as_column(b)
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return as_column(a) * as_column(b)
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return as_column(a) / as_column(b)
        case ast.BinOp(left=a, op=ast.Pow(), right=b):
            return F.pow(as_column(a), as_column(b))
        case ast.Call(func=ast.Name(id="I"), args=[a]):
            return as_column(a)
        case ast.Call(func=ast.Name(id=name), args=[a]) if name in _FUNCTIONS:
            return _FUNCTIONS[name](as_column(a))
    raise ValueError(f"no column for {ast.unparse(node)}")


def derivatives(term: str, layers: list[str]) -> tuple[dict[str, Column], dict[tuple[str, str], Column]]:
    """First derivatives by layer, and second ones by pair of layers."""
    tree = parse(term)
    first = {v: derive(tree, v) for v in layers}
    second = {(v, w): as_column(derive(first[v], w)) for v in layers for w in layers}
    return {v: as_column(t) for v, t in first.items()}, second
