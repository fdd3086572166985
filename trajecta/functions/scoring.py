"""Answer graders: exact and contained matches, boxed answers, fractions and tuples, penalties and dispatch."""

from __future__ import annotations

import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trajecta.functions import text as X


def match_score(c: Column, golden: Column, contains: bool = False, right: float = 1.0, other: float = 0.0) -> Column:
    """Score of the last answer tag against any golden answer; over ten tags quarter an exact match, no tag gives 0."""
    answer = X.answer_tag(c)
    a = X.normalize_answer(answer)
    hit = F.exists(golden, lambda g: F.contains(a, X.normalize_answer(g)) if contains else a == X.normalize_answer(g))
    tags = F.greatest(F.size(F.split(c, "<answer>")), F.size(F.split(c, "</answer>"))) - 1
    full = F.lit(right) if contains else F.when(tags > 10, right / 4).otherwise(right)
    return F.when(answer.isNull(), 0.0).when(hit, full).otherwise(other)


def number_score(c: Column, truth: Column, strict: bool = True, right: float = 1.0, other: float = 0.0) -> Column:
    """Score of the marked (strict) or last number."""
    a = X.marked_answer(F.right(c, F.lit(300))) if strict else X.last_number(c)
    return F.when(a.isNull(), 0.0).when(a == truth, right).otherwise(other)


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float) -> Column:
    """0 up to limit - buffer, then a linear penalty."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))


def dispatch(source: Column, rules: dict[str, Column], turn_scores: Column | None = None) -> Column:
    """Score by data source; sources without a rule sum their turn scores, or raise where there are none."""
    out = None
    for name, score in rules.items():
        out = F.when(source == name, score) if out is None else out.when(source == name, score)
    rest = F.aggregate(turn_scores, F.lit(0.0), lambda a, x: a + x) if turn_scores is not None else F.raise_error(F.concat(F.lit("no score for source "), source)).cast("double")
    return rest if out is None else out.otherwise(rest)


def last_boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...} with balanced braces, or after the last "\\boxed " up to a dollar sign."""
    if not text:
        return None
    at = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if at < 0:
        return None
    rest = text[at:]
    if rest.startswith("\\boxed "):
        return rest[7:].split("$")[0].strip()
    depth, start = 0, rest.find("{")
    for i in range(start, len(rest)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(rest[i], 0)
        if depth == 0:
            return rest[start + 1 : i]
    return None


# Spellings that mean the same in answers.
_SAME = [("\\tfrac", "\\frac"), ("\\dfrac", "\\frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\%", ""), ("%", ""), ("\\!", ""), ("\\ ", ""), (" ", "")]
_UNIT = re.compile(r"\\text\{[^{}]*\}$")
_FRAC = re.compile(r"\\frac(?:\{(-?\d+)\}\{(-?\d+)\}|(\d)(\d))")
_PLAIN = re.compile(r"(-?\d+)/(-?\d+)")


def normal_math(s: str | None) -> str | None:
    """One spelling for answers: no units, spaces or display marks, fractions as \\frac{a}{b}, leading zeros before points."""
    if s is None:
        return None
    s = _UNIT.sub("", s.replace("\n", "").strip())
    for a, b in _SAME:
        s = s.replace(a, b)
    s = _FRAC.sub(lambda m: f"\\frac{{{m[1] or m[3]}}}{{{m[2] or m[4]}}}", s)
    s = re.sub(r"\\sqrt(\w)", r"\\sqrt{\1}", s)
    s = s.split("=")[-1] if s.count("=") == 1 and len(s.split("=")[0]) <= 2 else s
    if m := _PLAIN.fullmatch(s):
        s = f"\\frac{{{m[1]}}}{{{m[2]}}}"
    s = re.sub(r"(^|[^\d])\.(\d)", r"\g<1>0.\2", s)
    return "\\frac{1}{2}" if s == "0.5" else s.rstrip(".")


def value_of(s: str) -> Fraction | None:
    if m := re.fullmatch(r"(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}", s):
        return None if int(m[3]) == 0 else (-1 if m[1] else 1) * Fraction(int(m[2]), int(m[3]))
    try:
        return Fraction(s.replace(",", ""))
    except (ValueError, ZeroDivisionError):
        return None


def same_math(a: str | None, b: str | None) -> bool:
    """Equal after normalisation, or tuples equal part by part, or equal numbers; an unreduced fraction is no match, nor an integer written otherwise."""
    a, b = normal_math(a), normal_math(b)
    if a is None or b is None:
        return False
    if a == b:
        return True
    if a[:1] in "([" and b[:1] in "([" and a[:1] == b[:1] and a[-1:] == b[-1:]:
        x, y = a[1:-1].split(","), b[1:-1].split(",")
        return len(x) == len(y) > 1 and all(same_math(p, q) for p, q in zip(x, y, strict=True))
    x, y = value_of(a), value_of(b)
    if x is None or y is None or x != y:
        return False
    for s in (a, b):
        if m := re.fullmatch(r"-?\\frac\{(-?\d+)\}\{(-?\d+)\}", s):
            f = Fraction(int(m[1]), int(m[2]))
            if (abs(f.numerator), abs(f.denominator)) != (abs(int(m[1])), abs(int(m[2]))):
                return False
    return ("\\frac" in a) == ("\\frac" in b) or y.denominator != 1


def math_columns():
    """Pandas UDFs (boxed, score): brace matching and number rules go beyond SQL."""

    @F.pandas_udf("string")
    def boxed(c: pd.Series) -> pd.Series:
        return c.map(last_boxed)

    @F.pandas_udf("double")
    def score(c: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([float(same_math(last_boxed(a), b)) for a, b in zip(c, truth, strict=True)])

    return boxed, score


def filter_weights(score: Column, method: str, power: float = 2.0, most: Column | None = None, least: Column | None = None) -> Column:
    """Resampling weights: pow, max_min or max_random."""
    if method == "pow":
        return F.pow(F.abs(score), power)
    if method == "max_min":
        return F.when((score == most) | (score == least), 1.0).otherwise(0.0)
    if method == "max_random":
        return F.when(score == most, 0.4).otherwise(0.1)
    raise ValueError(f"no method named {method}")


def contained_reward(source, response, truth, extra=None, loose: float = 0.0) -> float:
    """1 where the response holds the truth, ``loose`` where it does but for case, else 0; a row function for the reward managers."""
    if truth is None or response is None:
        return 0.0
    return 1.0 if truth in response else loose if truth.lower() in response.lower() else 0.0
