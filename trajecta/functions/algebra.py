"""Maths answers compared as expressions: a parser to a tree, and identity by evaluation at random points modulo primes.

Two expressions that agree at random points modulo large primes are the same
function but for odds of about degree / 2**61 for each point (Schwartz and
Zippel).  Numbers stay exact fractions.  A root of a rational number is the
product of the roots of its prime factors, each fixed for a point, and primes
are chosen so that these roots exist; a root of anything else is one of its two
square roots, always the same one.  Other functions are taken as unknown ones:
equal arguments give equal values.
"""

from __future__ import annotations

import math
import random
import re
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from trajecta.functions.scoring import last_boxed, normal_math, same_math

POINTS = 4
MOST_CHARS, MOST_EXPONENT = 1000, 1 << 20
TOLERANCE = 1e-4
#: Factors of a radicand are sought up to here; a larger rest counts as one prime.
MOST_FACTOR = 100_000
# Spellings and names in answers.
_SPELT = [("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\left", ""), ("\\right", ""), ("\\cdot", "*"), ("\\times", "*"), ("\\div", "/"), ("\\,", " "), ("\\!", ""), ("\\ ", " "), ("$", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\%", "%"), ("**", "^"), ("√", "\\sqrt"), ("π", "\\pi"), ("·", "*"), ("×", "*"), ("−", "-")]
_NAMES = ("sqrt", "pi", "sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "exp")
PI_VALUES = (None, Fraction(157, 50))
_TOKEN = re.compile(r"\s*(\d+(?:\.\d*)?|\.\d+|\\[A-Za-z]+|" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r"|[A-Za-z]|[-+*/^(){}\[\]%|])")


class Unknown(ValueError):
    """The expression, or its value, is outside of what can be compared."""


class Undefined(ValueError):
    """No value at this point; another one may have one."""


class _Parser:
    """Sums of products of powers; factors that stand side by side are multiplied."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unknown(text)
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def need(self, token: str) -> None:
        if self.next() != token:
            raise Unknown(token)

    def whole(self):
        tree = self.sum()
        if self.peek():
            raise Unknown(self.peek())
        return tree

    def sum(self):
        tree = self.product()
        while self.peek() in ("+", "-"):
            op = self.next()
            right = self.product()
            tree = ("+", tree, right if op == "+" else ("*", ("n", Fraction(-1)), right))
        return tree

    def product(self):
        tree = self.signed()
        while (t := self.peek()) and t not in ("+", "-", ")", "}", "]", "|"):
            if t in ("*", "/"):
                self.next()
                tree = (t, tree, self.signed())
            else:
                tree = ("*", tree, self.power())
        return tree

    def signed(self):
        if self.peek() in ("+", "-"):
            return ("*", ("n", Fraction(-1)), self.signed()) if self.next() == "-" else self.signed()
        return self.power()

    def power(self):
        tree = self.atom()
        while self.peek() == "%":
            self.next()
            tree = ("/", tree, ("n", Fraction(100)))
        if self.peek() == "^":
            self.next()
            return ("^", tree, self.signed())
        return tree

    def argument(self):
        """What follows \\frac or \\sqrt: a group, or one digit or letter."""
        t = self.peek()
        if t == "{" or t == "(" or t.startswith("\\"):
            return self.atom()
        if t[:1].isdigit() and len(t) > 1:
            self.tokens[self.at] = t[1:]
            return ("n", Fraction(t[0]))
        return self.atom()

    def atom(self):
        t = self.next()
        if t[:1].isdigit() or t[:1] == ".":
            return ("n", Fraction(t.rstrip(".") if t != "." else "0"))
        if t in ("(", "{", "["):
            tree = self.sum()
            self.need({"(": ")", "{": "}", "[": "]"}[t])
            return tree
        if t == "|":
            tree = self.sum()
            self.need("|")
            return ("f", "abs", tree)
        name = t.removeprefix("\\")
        if name == "frac":
            top = self.argument()
            return ("/", top, self.argument())
        if name == "sqrt":
            k = ("n", Fraction(2))
            if self.peek() == "[":
                k = self.atom()
            return ("^", self.argument(), ("/", ("n", Fraction(1)), k))
        if name == "pi":
            return ("v", "\\pi")
        if name in _NAMES:
            return ("f", name, self.power())
        if len(name) == 1 and name.isalpha():
            return ("v", name)
        if t.startswith("\\") and name.isalpha() and name not in ("text", "mbox", "begin", "end", "mathrm"):
            return ("v", t)
        raise Unknown(t)


@lru_cache(maxsize=20_000)
def parse(text: str):
    """Tree of an answer; raises ``Unknown`` for what is no expression."""
    for a, b in _SPELT:
        text = text.replace(a, b)
    if len(text) > MOST_CHARS:
        raise Unknown("too long")
    text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
    text = re.sub(r"(\d) +(?=\d|\\frac)", r"\1+", text)
    try:
        return _Parser(text).whole()
    except RecursionError:
        raise Unknown("too deep") from None


def leaves(tree, kind: str) -> set:
    return {tree[1]} if tree[0] == kind else set().union(*(leaves(x, kind) for x in tree[1:] if isinstance(x, tuple)), set())


def _is_prime(n: int) -> bool:
    if any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
        return n < 38 and n > 1 and n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


@lru_cache(maxsize=None)
def modulus(number: int) -> int:
    """A prime of 61 bits; all machines draw the same ones."""
    r = random.Random(f"modulus {number}")
    while not _is_prime(p := r.getrandbits(60) | (1 << 60) | 1):
        pass
    return p


@lru_cache(maxsize=None)
def _non_residue(p: int) -> tuple[int, int, int]:
    """What square roots modulo p need: p - 1 as an odd number and a power of two, and the odd power of a number without a root."""
    q, s = p - 1, 0
    while q % 2 == 0:
        q, s = q // 2, s + 1
    z = next(z for z in range(2, p) if pow(z, (p - 1) // 2, p) == p - 1)
    return q, s, pow(z, q, p)


@lru_cache(maxsize=50_000)
def _root(a: int, p: int) -> int | None:
    """The lesser square root modulo a prime, by Tonelli and Shanks; None where there is none."""
    if a == 0:
        return 0
    q, m, c = _non_residue(p)
    half = pow(a, (q - 1) // 2, p)
    r = half * a % p
    t = half * r % p
    while t != 1:
        i, x = 0, t
        while x != 1:
            x, i = x * x % p, i + 1
            if i == m:
                return None
        b = pow(c, 1 << (m - i - 1), p)
        m, c, t, r = i, b * b % p, t * b * b % p, r * b % p
    return min(r, p - r)


def square_root(a: int, p: int) -> int:
    """The lesser square root modulo a prime."""
    r = _root(a % p, p)
    if r is None:
        raise Undefined("no square root")
    return r


@lru_cache(maxsize=1 << 12)
def point(number: int, letters: int) -> tuple[tuple[Fraction, ...], int]:
    """Values of so many letters at a point, and of pi; all machines draw the same ones."""
    r = random.Random(f"point {number}")
    return tuple(Fraction(r.randrange(2, MOST_EXPONENT)) for _ in range(letters)), r.getrandbits(60)


@lru_cache(maxsize=50_000)
def factors(n: int) -> tuple[tuple[int, int], ...]:
    """Prime factors and their powers; -1 for a sign, and what is left beyond ``MOST_FACTOR`` as it is."""
    out, d = [], 2
    if n < 0:
        out.append((-1, 1))
        n = -n
    while d * d <= n and d <= MOST_FACTOR:
        k = 0
        while n % d == 0:
            n, k = n // d, k + 1
        if k:
            out.append((d, k))
        d += 1 + d % 2
    return (*out, (n, 1)) if n > 1 else tuple(out)


def exact(tree, env: dict[str, Fraction]) -> Fraction:
    """The value as a fraction; raises ``Unknown`` where it has none."""
    kind = tree[0]
    if kind == "n":
        return tree[1]
    if kind == "v":
        if tree[1] not in env:
            raise Unknown(tree[1])
        return env[tree[1]]
    if kind == "f":
        if tree[1] == "abs":
            return abs(exact(tree[2], env))
        raise Unknown(tree[1])
    x, y = exact(tree[1], env), exact(tree[2], env)
    if kind == "+":
        return x + y
    if kind == "*":
        return x * y
    if kind == "/":
        if y == 0:
            raise Undefined("division by zero")
        return x / y
    if y.denominator != 1 or abs(y) * max(1, x.numerator.bit_length(), x.denominator.bit_length()) > 4096:
        raise Unknown("no short fraction")
    if x == 0 and y < 0:
        raise Undefined("division by zero")
    return x ** int(y)


def value(tree, env: dict[str, int], exacts: dict[str, Fraction], p: int) -> int:
    """The value modulo p at a point."""
    kind = tree[0]
    if kind == "n":
        if tree[1].denominator % p == 0:
            raise Undefined("division by zero")
        return tree[1].numerator * (1 if tree[1].denominator == 1 else pow(tree[1].denominator, -1, p)) % p
    if kind == "v":
        return env[tree[1]]
    if kind == "f":
        try:
            return value(("n", exact(tree, exacts)), env, exacts, p)
        except Unknown:
            return random.Random(f"{tree[1]} {value(tree[2], env, exacts, p)}").randrange(p)
    if kind == "^":
        return _power(tree, env, exacts, p)
    x, y = (value(t, env, exacts, p) for t in tree[1:])
    if kind == "/":
        if y == 0:
            raise Undefined("division by zero")
        return x * pow(y, -1, p) % p
    return (x + y if kind == "+" else x * y) % p


def _power(tree, env, exacts, p: int) -> int:
    e = exact(tree[2], exacts)
    if abs(e.numerator) > MOST_EXPONENT**3 or e.denominator > 64:
        raise Unknown("exponent")
    k = e.denominator
    if k == 1:
        base = value(tree[1], env, exacts, p)
    else:
        while k % 2 == 0:
            k //= 2
        twos = e.denominator // k
        if math.gcd(k, p - 1) != 1:
            raise Undefined("no single root")
        try:
            r = exact(tree[1], {})
            base = 1
            parts = [*factors(r.numerator), *((f, -n) for f, n in factors(r.denominator))] if r else []
            for f, n in parts:
                root = f % p
                for _ in range(twos.bit_length() - 1):
                    root = square_root(root, p)
                base = base * pow(root, n, p) % p
            base = base if r else 0
        except Unknown:
            base = value(tree[1], env, exacts, p)
            for _ in range(twos.bit_length() - 1):
                base = square_root(base, p)
        base = pow(base, pow(k, -1, p - 1), p)
    if base == 0 and e <= 0:
        raise Undefined("zero to no power")
    return pow(base, e.numerator, p)


def identical(a: str, b: str, pi: Fraction | None = None, points: int = POINTS) -> bool:
    """Whether two answers are the same function of their letters; ``pi`` is a number of its own unless a value is given."""
    x, y = parse(a), parse(b)
    names = sorted(leaves(x, "v") | leaves(y, "v"))
    found, number = 0, 0
    while found < points:
        number += 1
        if number > 64 * points:
            raise Unknown("no point where both have a value")
        p, (drawn, bits) = modulus(number), point(number, len(names))
        exacts = dict(zip(names, drawn, strict=True))
        if "\\pi" in exacts:
            exacts["\\pi"] = Fraction(bits) if pi is None else pi
        try:
            env = {n: v.numerator * (1 if v.denominator == 1 else pow(v.denominator, -1, p)) % p for n, v in exacts.items()}
            if value(x, env, exacts, p) != value(y, env, exacts, p):
                return False
        except Undefined:
            continue
        found += 1
    return True


_FUNCTIONS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "log": math.log, "ln": math.log, "exp": math.exp, "abs": abs}


def number(tree, pi: float = math.pi) -> float:
    """The value of an answer without letters."""
    kind = tree[0]
    if kind == "n":
        return float(tree[1])
    if kind == "v":
        if tree[1] != "\\pi":
            raise Unknown(tree[1])
        return pi
    if kind == "f":
        if tree[1] not in _FUNCTIONS:
            raise Unknown(tree[1])
        return _FUNCTIONS[tree[1]](number(tree[2], pi))
    x, y = number(tree[1], pi), number(tree[2], pi)
    if kind == "^":
        z = x**y
        if isinstance(z, complex):
            raise Unknown("no real value")
        return z
    return x + y if kind == "+" else x * y if kind == "*" else x / y


_DIGITS = re.compile(r"-?[\d,]*\.?\d+(?:\\?%)?")


def close(a: str, b: str) -> bool:
    """Numbers within ``TOLERANCE`` of one another, pi as either of its values; plain ones also as percentages of one another."""
    plain = _DIGITS.fullmatch(a.strip()) and _DIGITS.fullmatch(b.strip())
    if plain:
        a, b = a.rstrip("%\\ "), b.rstrip("%\\ ")
    x, y = parse(a), parse(b)
    for pi in (math.pi, 3.14):
        u, v = number(x, pi), number(y, pi)
        if any(math.isclose(w, u, rel_tol=TOLERANCE) for w in ([v / 100, v, v * 100] if plain else [v])):
            return True
    return False


_FRACTION = re.compile(r"-?(?:\d+/\d+|\\frac\{-?\d+\}\{-?\d+\})")
_WHOLE = re.compile(r"-?[\d,]+(?:\.0*)?")


def _parts(s: str) -> list[str]:
    if len(s) > 2 and s[0] in "([" and s[-1] in ")]" and not any(c in "()[]" for c in s[1:-1]):
        return [x.strip() for x in s[1:-1].split(",")]
    return [s]


@lru_cache(maxsize=100_000)
def graded(given: str | None, truth: str | None, strict: bool = False) -> bool:
    """Whether an answer is right: the same after normalisation, or identical part by part.

    Strict: an unreduced fraction and a number in place of a whole one are
    wrong.  Else numbers that come close are right too.  Null and what can't be
    parsed are right only if they are spelt the same.
    """
    if given is None or truth is None:
        return False
    given, truth = (re.sub(r"(\d) +(?=\d+/\d|\\[td]?frac)", r"\1+", x.strip()) for x in (given, truth))
    if same_math(given, truth):
        return True
    a, b = (normal_math(x) for x in (given, truth))
    x, y = _parts(a), _parts(b)
    same_form = len(x) == len(y) and (len(x) == 1 or a[0] == b[0] and a[-1] == b[-1])
    if same_form and a:
        for u, v in zip(x, y, strict=True):
            if _FRACTION.fullmatch(u) and _FRACTION.fullmatch(v) or bool(_WHOLE.fullmatch(u)) != bool(_WHOLE.fullmatch(v)):
                break
            if not _tried(identical, u, v):
                break
        else:
            return True
    if strict or not same_form or not a:
        return False
    x, y = _parts(given), _parts(truth)
    if len(x) != len(y):
        return False
    return all(any(_tried(identical, u, v, pi) for pi in PI_VALUES) or _tried(close, u, v) for u, v in zip(x, y, strict=True))


@lru_cache(maxsize=100_000)
def _tried(rule, *args) -> bool:
    """Kept, because a strict grade asks what one that isn't strict has asked."""
    try:
        return rule(*args)
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return False


def grade_columns(strict: bool = False):
    """Pandas UDF (given, truth) -> boolean, and one that takes the given answer from the last box of a response."""

    @F.pandas_udf("boolean")
    def grade(given: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([graded(a, b, strict) for a, b in zip(given, truth, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def grade_response(response: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([graded(last_boxed(a), b, strict) for a, b in zip(response, truth, strict=True)], dtype=bool)

    return grade, grade_response
