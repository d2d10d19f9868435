"""A small formula grammar over layers, as column expressions.

Terms joined by ``+``: ``x``, ``x:z``, ``x*z`` (both and their product),
``I(x^2)``, ``s(x, df=4)`` and ``1``. Text layers become indicators of all
levels but the first in alphabetical order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    name: str
    column: Column


def split_terms(formula: str) -> list[str]:
    right = formula.split("~")[-1]
    terms: list[str] = []
    for t in re.split(r"\+(?![^(]*\))", right):
        t = re.sub(r"\s+", "", t)
        if "*" in t and "(" not in t:
            a, b = t.split("*")
            new = [a, b, f"{a}:{b}"]
        else:
            new = [t]
        terms += [x for x in new if x and x not in terms]
    return terms


def knots(df: DataFrame, layer: str, df_terms: int, degree: int = 3) -> list[float]:
    """Boundary and interior knots at exact quantiles."""
    inner = max(0, df_terms - degree)
    probs = [0.0, *[(k + 1) / (inner + 1) for k in range(inner)], 1.0]
    return list(df.agg(F.percentile(layer, F.array(*map(F.lit, probs)))).first()[0])


def b_spline(x: Column, at: list[float], degree: int = 3) -> list[Column]:
    """B-spline basis on the boundary and interior knots, without the first function.

    Cox-de Boor recursion as expressions; the right boundary belongs to the last interval.
    """
    t = [at[0]] * degree + at + [at[-1]] * degree
    n = len(t) - 1
    last = max(k for k in range(n) if t[k] < t[k + 1])
    basis = [F.when((x >= t[k]) & ((x < t[k + 1]) if k != last else (x <= t[k + 1])), 1.0).otherwise(0.0) if t[k] < t[k + 1] else F.lit(0.0) for k in range(n)]
    for d in range(1, degree + 1):
        new = []
        for k in range(n - d):
            left = (x - t[k]) / (t[k + d] - t[k]) * basis[k] if t[k + d] > t[k] else F.lit(0.0)
            right = (t[k + d + 1] - x) / (t[k + d + 1] - t[k + 1]) * basis[k + 1] if t[k + d + 1] > t[k + 1] else F.lit(0.0)
            new.append(left + right)
        basis = new
    return basis[1:]


def terms(df: DataFrame, formula: str) -> list[Term]:
    """The design's columns over ``df``; ``~1`` gives the intercept alone, other formulas drop it."""
    found: list[Term] = []
    for t in split_terms(formula):
        if t == "1" or t == "0":
            continue
        if m := re.fullmatch(r"I\((\w+)\^(\d+)\)", t):
            found.append(Term(t, F.col(m[1]) ** int(m[2])))
        elif m := re.fullmatch(r"s\((\w+)(?:,df=(\d+))?\)", t):
            at = knots(df, m[1], int(m[2] or 4))
            found += [Term(f"s({m[1]}){k + 1}", c) for k, c in enumerate(b_spline(F.col(m[1]), at))]
        elif ":" in t:
            a, b = t.split(":")
            found.append(Term(t, F.col(a) * F.col(b)))
        elif df.schema[t].dataType.typeName() == "string":
            levels = sorted(r[0] for r in df.select(t).where(F.col(t).isNotNull()).distinct().collect())
            found += [Term(f"{t}{v}", (F.col(t) == v).cast("double")) for v in levels[1:]]
        else:
            found.append(Term(t, F.col(t).cast("double")))
    return found or [Term("(Intercept)", F.lit(1.0))]


def design(df: DataFrame, formula: str, keys: tuple[str, ...] = ("cell",)) -> tuple[DataFrame, list[str]]:
    """Keys and columns x0, x1, ...; and the columns' names. A rank below the number of columns is refused."""
    made = terms(df, formula)
    out = df.select(*keys, *[t.column.alias(f"x{k}") for k, t in enumerate(made)])
    check_rank(out, len(made))
    return out, [t.name for t in made]


def check_rank(out: DataFrame, p: int) -> None:
    """By the Gram matrix with an intercept; p^2 sums, whatever the number of rows."""
    x = [F.lit(1.0), *[F.col(f"x{k}") for k in range(p)]]
    sums = out.agg(*[F.sum(a * b) for a in x for b in x]).first()
    gram = np.array([0.0 if v is None else v for v in sums]).reshape(p + 1, p + 1)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    constant = p == 1 and np.isclose(gram[0, 0] * gram[1, 1], gram[0, 1] ** 2)
    if np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-9) < p + 1 and not constant:
        raise ValueError("the design's columns are linearly dependent")
