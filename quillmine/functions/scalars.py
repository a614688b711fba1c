"""Scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """Halves go up, so that -2.5 becomes -2."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def normalized_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))


def severity(c: Column, levels: tuple[str, ...]) -> Column:
    """The upper-cased level, or null for an unknown one."""
    up = F.upper(F.trim(c))
    return F.when(up.isin(*levels), up)


def path_of(url: Column) -> Column:
    return F.regexp_replace(url, r"^[a-z]+://[^/]*/?", "")


def district(path: Column) -> Column:
    """Directory part of a path; `root` without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("root"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def backoff(initial: Column, cap: float, attempt: Column, multiplier: float = 2.0) -> Column:
    return F.least(F.lit(cap), initial * F.pow(F.lit(multiplier), F.greatest(F.lit(0), attempt - 1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two double arrays, clipped to [-1, 1]; unequal lengths and zero vectors are errors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norm == 0, F.raise_error(F.lit("zero vector")).cast("double")).otherwise(value)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low))


def glob_pattern(glob: str) -> str:
    """Anchored pattern of a glob: ** crosses directories, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r".+()[]{}|^$\\" else c)
            i += 1
    return f"^{out}$"
