"""Constants: closed forms proposed by integer relations and checked by another evaluation.

The search works on integers scaled by a power of ten (lattice reduction), the check on decimals with
other series and more digits, so that one method's mistake is not confirmed by itself.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation, localcontext
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS, CHECK_DIGITS, MIN_DIGITS = 30, 50, 20


@lru_cache(256)
def constant(name: str, digits: int, other: bool = False) -> Decimal:
    """pi, e, euler, catalan, apery to so many digits; other: by another series."""
    with localcontext() as c:
        c.prec = digits + 15
        one, eps = Decimal(1), Decimal(10) ** -(digits + 12)

        def arctan_inverse(n: int) -> Decimal:
            t, k, s = one / n, 1, Decimal(0)
            while abs(t) > eps:
                s += t / k if k % 4 == 1 else -t / k
                t /= n * n
                k += 2
            return s

        if name == "pi":
            if other:
                return 24 * arctan_inverse(8) + 8 * arctan_inverse(57) + 4 * arctan_inverse(239)
            return 16 * arctan_inverse(5) - 4 * arctan_inverse(239)
        if name == "e":
            if other:
                return 1 / sum_series(lambda k, t: -t / k, digits)
            return sum_series(lambda k, t: t / k, digits)
        if name == "apery":
            # alternating central-binomial series, or one with faster terms
            t, s, k = one / 2, Decimal(0), 1
            if not other:
                while abs(t) > eps:
                    s += t / (k**3)
                    t *= -Decimal((k + 1) ** 2) / ((2 * k + 1) * (2 * k + 2))
                    k += 1
                return s * 5 / 2
            s, f = Decimal(0), Fraction(1)
            for k in range(digits // 3 + 12):
                num = (205 * k * k + 250 * k + 77) * (-1) ** k * _fact(k) ** 10
                s += Decimal(num) / (64 * _fact(2 * k + 1) ** 5)
            return s
        if name == "catalan":
            if other:
                s, k = Decimal(0), 0
                pi, r3 = constant("pi", digits + 5), Decimal(3).sqrt()
                while True:
                    t = Decimal(_fact(k) ** 2) / (_fact(2 * k) * (2 * k + 1) ** 2)
                    if t < eps:
                        break
                    s += t
                    k += 1
                return pi / 8 * (2 + r3).ln() + s * 3 / 8
            # Cohen, Villegas and Zagier's acceleration of the alternating series
            n = int(1.32 * (digits + 15))
            d = (3 + Decimal(8).sqrt()) ** n
            d = (d + 1 / d) / 2
            b, cc, s = Decimal(-1), -d, Decimal(0)
            for k in range(n):
                cc = b - cc
                s += cc / (2 * k + 1) ** 2
                b = b * (k + n) * (k - n) / ((k + Decimal("0.5")) * (k + 1))
            return s / d
        if name == "euler":
            # Brent and McMillan
            n = int((digits + 15) * 0.6) + (5 if other else 2)
            a, b, s_a, s_b, k, h = Decimal(1), Decimal(0), Decimal(0), Decimal(0), 0, Decimal(0)
            t = one
            while k < 5 * n + 20:
                s_b += t
                s_a += t * h
                k += 1
                t *= Decimal(n * n) / (k * k)
                h += one / k
            return s_a / s_b - Decimal(n).ln()
    raise KeyError(name)


@lru_cache(4096)
def _fact(n: int) -> int:
    return 1 if n < 2 else n * _fact(n - 1)


def sum_series(step, digits: int) -> Decimal:
    t, k, s = Decimal(1), 1, Decimal(0)
    while abs(t) > Decimal(10) ** -(digits + 14):
        s += t
        t = step(k, t)
        k += 1
    return s


NAMES = {"pi": "pi", "e": "e", "E": "e", "euler": "euler", "EulerGamma": "euler", "catalan": "catalan", "Catalan": "catalan", "apery": "apery"}


def evaluate(expr: str, digits: int, other: bool = False) -> Decimal:
    """The value of an expression in numbers, constants, + - * / **, sqrt, log and exp."""
    with localcontext() as c:
        c.prec = digits + 15

        def go(n: ast.AST) -> Decimal:
            if isinstance(n, ast.Expression):
                return go(n.body)
            if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
                return Decimal(ast.get_source_segment(expr, n) or str(n.value))
            if isinstance(n, ast.Name) and n.id in NAMES:
                return +constant(NAMES[n.id], digits, other)
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
                return -go(n.operand) if isinstance(n.op, ast.USub) else go(n.operand)
            if isinstance(n, ast.BinOp):
                a, b = go(n.left), go(n.right)
                if isinstance(n.op, ast.Pow):
                    if abs(b) > 1000:
                        raise ValueError("exponent too large")
                    return a**b
                return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b}[type(n.op)]()
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and len(n.args) == 1 and n.func.id in ("sqrt", "log", "ln", "exp"):
                x = go(n.args[0])
                return x.sqrt() if n.func.id == "sqrt" else x.exp() if n.func.id == "exp" else x.ln()
            raise ValueError(f"not understood: {ast.dump(n)[:80]}")

        return go(ast.parse(expr.strip(), mode="eval"))


def verify(value: str, expr: str, min_digits: int = MIN_DIGITS) -> tuple[bool, int, str | None, str | None]:
    """(verified, digits agreed, value of the expression, error): by the other series and more digits (V3)."""
    try:
        with localcontext() as c:
            c.prec = CHECK_DIGITS + 5
            v, x = Decimal(value), evaluate(expr, CHECK_DIGITS + 5, other=True)
            diff = abs(v - x) / (abs(v) if abs(v) > 1 else 1)
            given = len(value.strip().lstrip("+-").replace(".", "").split("e")[0])
            digits = CHECK_DIGITS if diff == 0 else max(0, int(-diff.log10()))
            return digits >= min(min_digits, max(1, given - 1)), digits, str(+x), None
    except (ArithmeticError, InvalidOperation, ValueError, KeyError, SyntaxError) as e:
        return False, 0, None, f"{type(e).__name__}: {e}"[:200]


def lattice_relation(values: list[Decimal], digits: int, most: int = 10**6) -> list[int] | None:
    """Small integers a with sum a_i * values_i = 0 to so many digits, by LLL on scaled integers; null if there are none."""
    n, scale = len(values), 10**digits
    b = [[int(i == j) for j in range(n)] + [int((v * scale).to_integral_value())] for i, v in enumerate(values)]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))

    def gram_schmidt():
        q, mu = [], [[Fraction(0)] * n for _ in range(n)]
        norm = []
        for i in range(n):
            v = [Fraction(x) for x in b[i]]
            for j in range(i):
                mu[i][j] = Fraction(dot(b[i], q[j])) / norm[j] if norm[j] else Fraction(0)
                v = [x - mu[i][j] * y for x, y in zip(v, q[j])]
            q.append(v)
            norm.append(dot(v, v))
        return mu, norm

    mu, norm = gram_schmidt()
    k, steps = 1, 0
    while k < n and steps < 20_000:
        steps += 1
        for j in range(k - 1, -1, -1):
            r = round(mu[k][j])
            if r:
                b[k] = [x - r * y for x, y in zip(b[k], b[j])]
                for i in range(j):
                    mu[k][i] -= r * mu[j][i]
                mu[k][j] -= r
        if norm[k] >= (Fraction(3, 4) - mu[k][k - 1] ** 2) * norm[k - 1]:
            k += 1
        else:
            b[k], b[k - 1] = b[k - 1], b[k]
            m, old = mu[k][k - 1], norm[k - 1]
            norm[k - 1] = norm[k] + m * m * old
            mu[k][k - 1] = m * old / norm[k - 1]
            norm[k] = old * norm[k] / norm[k - 1]
            for j in range(k - 1):
                mu[k - 1][j], mu[k][j] = mu[k][j], mu[k - 1][j]
            for i in range(k + 1, n):
                t = mu[i][k]
                mu[i][k] = mu[i][k - 1] - m * t
                mu[i][k - 1] = t + mu[k][k - 1] * mu[i][k]
            k = max(1, k - 1)
    best = min(b, key=lambda r: dot(r, r))
    a = best[:n]
    size = max(map(abs, a))
    # chance finds relations of about digits / n digits each: a true one is far smaller
    return a if size and size <= most and abs(best[n]) <= 10 ** (digits // 3) and n * len(str(size)) < digits - 4 else None


BASES = (("1",), ("1", "sqrt(2)"), ("1", "sqrt(3)"), ("1", "sqrt(5)"), ("1", "pi"), ("1", "pi**2"), ("1", "e"), ("1", "log(2)"), ("1", "log(3)"), ("1", "euler"), ("1", "catalan"), ("1", "apery"), ("1", "pi", "e"), ("1", "pi", "log(2)"), ("1", "sqrt(2)", "sqrt(3)"))


def propose(value: str) -> list[str]:
    """Closed forms that fit to DIGITS digits: linear in a small basis, or a root of a small polynomial (V2)."""
    digits = min(DIGITS, len(value.strip().lstrip("+-").replace(".", "")) - 1)
    if digits < 12:
        return []
    out = []
    with localcontext() as c:
        c.prec = digits + 20
        try:
            v = Decimal(value)
        except InvalidOperation:
            return []
        if not v.is_finite():
            return []
        for basis in BASES:
            a = lattice_relation([v, *[evaluate(x, digits + 5) for x in basis]], digits)
            if a and a[0]:
                terms = [f"{Fraction(-x, a[0])}*{t}" if t != "1" else f"{Fraction(-x, a[0])}" for x, t in zip(a[1:], basis) if x]
                out.append(" + ".join(f"({t})" if "/" not in t or "*" not in t else f"({t.split('*', 1)[0]})*{t.split('*', 1)[1]}" for t in terms) or "0")
                break
        if not out:
            a = lattice_relation([v**0, v, v**2, v**3, v**4], digits)
            if a and not a[1] and not a[3] and a[4]:  # biquadratic: nested square roots
                for s in ("+", "-"):
                    out.append(f"sqrt((({-a[2]}) {s} sqrt({a[2] ** 2 - 4 * a[0] * a[4]}))/({2 * a[4]}))")
            elif a and not a[3] and not a[4] and a[2]:
                for s in ("+", "-"):
                    out.append(f"(({-a[1]}) {s} sqrt({a[1] ** 2 - 4 * a[0] * a[2]}))/({2 * a[2]})")
    return out


def identify(values: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """(key, expr, verified, digits): for every value its best verified closed form, or a null expr (V4)."""
    base = values.select(F.col(key), F.col(value).cast("string").alias("value"))
    kind = dict(base.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, v in zip(f[key], f["value"]):
                best = (None, False, 0)
                for expr in propose(v) if isinstance(v, str) else []:
                    ok, digits, _, _ = verify(v, expr)
                    if ok and digits > best[2]:
                        best = (expr, True, digits)
                rows.append((k, *best))
            yield pd.DataFrame(rows, columns=[key, "expr", "verified", "digits"])

    return base.mapInPandas(run, f"{key} {kind}, expr string, verified boolean, digits int")


def checked(claims: DataFrame, min_digits: int = 20) -> DataFrame:
    """(value, expr) to (value, expr, verified, digits, reeval, error): every claim is evaluated anew in the task that holds it (M5).

    A null value or expression is not verified, with the reason in error.
    """
    base = claims.select(F.col("value").cast("string").alias("value"), F.col("expr").cast("string").alias("expr"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for v, e in zip(f["value"], f["expr"]):
                known = isinstance(v, str) and isinstance(e, str)
                rows.append((v, e, *(verify(v, e, min_digits) if known else (False, 0, None, "missing value or expression"))))
            yield pd.DataFrame(rows, columns=["value", "expr", "verified", "digits", "reeval", "error"])

    return base.mapInPandas(run, "value string, expr string, verified boolean, digits int, reeval string, error string")


def continued_fraction(a: tuple[int, int, int], b: tuple[int, int, int], depth: int) -> Fraction | None:
    """a(0) + b(1) / (a(1) + b(2) / ...) with quadratic a and b, backwards in whole numbers; null if a denominator is zero."""
    num, den = 1, 0
    p = lambda c, n: c[0] + c[1] * n + c[2] * n * n
    num, den = p(a, depth), 1
    for n in range(depth, 0, -1):
        if num == 0:
            return None
        num, den = p(a, n - 1) * num + p(b, n) * den, num
    return Fraction(num, den) if den else None


def images(x: Decimal) -> dict[str, Decimal]:
    """The simple images of a constant that a continued fraction may have as its value; none is zero."""
    out = {"x": x, "x-1": x - 1, "x+1": x + 1, "2*x": 2 * x, "x/2": x / 2}
    if x:
        out |= {"1/x": 1 / x, "2/x": 2 / x, "4/x": 4 / x}
    if x != -1:
        out["x/(x+1)"] = x / (x + 1)
    return {k: v for k, v in out.items() if v}


def conjecture(spark, value: str, reach: int = 4, depth: int = 200, min_digits: int = 25, parts: int = 16) -> DataFrame:
    """(a, b, image, digits): continued fractions with small polynomials whose value, or an image of it, is the constant (D3).

    a is linear, with a slope of reach at most (2 at least), b quadratic with b2 from 0 to reach; all other
    coefficients are from -reach to reach, and b is not zero. At reach 4 this holds the reference's 7,272 pairs
    (slopes 1 and 2), and those of the slopes -4 to 0, 3 and 4. The grid is spread over tasks; what fits to
    min_digits is evaluated again twice as deep and must fit again. All hits are given.
    """
    side, slope = 2 * reach + 1, max(2, reach)
    sizes = (2 * slope + 1, side, reach + 1, side, side)  # of a1, a0, b2, b1, b0
    grid = spark.range(0, math.prod(sizes), 1, parts)

    def agree(x: Fraction, goal: Decimal, prec: int) -> int:
        diff = abs(Decimal(x.numerator) / x.denominator - goal) / max(abs(goal), Decimal(1))
        return prec if not diff else max(0, int(-diff.log10()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with localcontext() as c:
            c.prec = max(depth // 3, 60)
            goals = images(Decimal(value))
            for f in frames:
                rows = []
                for g in f["id"]:
                    d, g = [], int(g)
                    for n in sizes:
                        g, r = divmod(g, n)
                        d.append(r)
                    a, b = (d[1] - reach, d[0] - slope, 0), (d[4] - reach, d[3] - reach, d[2])
                    if not any(b):
                        continue
                    first = continued_fraction(a, b, depth)
                    if first is None:
                        continue
                    for image, goal in goals.items():
                        if agree(first, goal, c.prec) < min_digits:
                            continue
                        again = continued_fraction(a, b, 2 * depth)
                        digits = 0 if again is None else agree(again, goal, c.prec)
                        if digits >= min_digits:
                            rows.append((str(a), str(b), image, min(digits, min_digits + 40)))
                yield pd.DataFrame(rows, columns=["a", "b", "image", "digits"])

    return grid.mapInPandas(run, "a string, b string, image string, digits int")


#: Atoms of the wider relation search: powers, products and logarithms beside the constants.
WIDE = ("pi", "pi**2", "pi**3", "e", "euler", "catalan", "apery", "log(2)", "log(3)", "sqrt(2)", "sqrt(3)", "sqrt(5)", "pi*sqrt(2)", "pi*sqrt(3)", "pi*log(2)", "log(2)**2")


def relations(value: str, check: int = 25) -> list[str]:
    """Closed forms in one or two atoms of the wider basis beside 1, or of the value's square root; each verified to check digits or all given."""
    digits = len(value.strip().lstrip("+-").replace(".", "")) - 1
    if digits < 20:
        return []
    out = []
    with localcontext() as c:
        c.prec = digits + 20
        v = Decimal(value)
        values = {t: evaluate(t, digits + 5) for t in WIDE}
        groups = [("1", a) for a in WIDE] + [("1", a, b) for i, a in enumerate(WIDE) for b in WIDE[:i]]
        for power in (1, 2):
            for g in groups if power == 1 else groups[: len(WIDE)]:
                a = lattice_relation([v**power, *[Decimal(1) if t == "1" else values[t] for t in g]], min(digits, 30), 10**4)
                if a and a[0] and any(a[2:]):
                    body = " + ".join(f"({-x})*({t})" for x, t in zip(a[1:], g) if x)
                    expr = f"({body})/({a[0]})" if power == 1 else f"sqrt(({body})/({a[0]}))"
                    if verify(value, expr, min(check, digits - 2))[0]:
                        out.append(expr)
                        return out
    return out


def simple_fraction(value: str, terms: int = 40) -> list[int]:
    """The terms of the regular continued fraction that the given digits settle: both ends of their interval agree."""
    v = value.strip()
    exact = Fraction(v)
    half = Fraction(1, 2 * 10 ** len(v.partition(".")[2])) if "." in v else Fraction(0)
    low, high, out = exact - half, exact + half, []
    for _ in range(terms):
        a, b = low.numerator // low.denominator, high.numerator // high.denominator
        if a != b:
            break
        out.append(a)
        low, high = low - a, high - a
        if not low or not high:
            break
        low, high = 1 / high, 1 / low
    return out


def convergent(terms: list[int]) -> Fraction:
    x = Fraction(terms[-1])
    for t in reversed(terms[:-1]):
        x = t + 1 / x
    return x


def pattern(terms: list[int]) -> str | None:
    """period-1, period-2 or e-type, by lags of the terms after the first; null if fewer than six terms settle it."""
    t = terms[1:]
    if len(t) < 6:
        return None
    if all(x == t[0] for x in t):
        return "period-1"
    if all(x == y for x, y in zip(t, t[2:])):
        return "period-2"
    for s in range(3):
        rest = [x for i, x in enumerate(t) if i % 3 != s]
        steps = [x for i, x in enumerate(t) if i % 3 == s]
        if len(steps) >= 3 and all(x == 1 for x in rest) and len({b - a for a, b in zip(steps, steps[1:])}) == 1:
            return "e-type"
    return None


def fractions(values: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """(key, terms, pattern, digits): regular continued fractions, their pattern, and the digits that the convergent gives back."""
    base = values.select(F.col(key), F.col(value).cast("string").alias("value")).filter("value IS NOT NULL")
    kind = dict(base.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, v in zip(f[key], f["value"]):
                try:
                    t = simple_fraction(v)
                    diff = abs(convergent(t) - Fraction(v)) if t else None
                except (ValueError, ZeroDivisionError):
                    t, diff = [], None
                with localcontext() as c:
                    c.prec = 60
                    digits = 0 if diff is None else 50 if not diff else max(0, int(-(Decimal(diff.numerator) / diff.denominator).log10()))
                rows.append((k, t, pattern(t), digits))
            yield pd.DataFrame(rows, columns=[key, "terms", "pattern", "digits"])

    return base.mapInPandas(run, f"{key} {kind}, terms array<bigint>, pattern string, digits int")
