"""Files, patches and source text, as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Languages by file name and extension, words that decide, and words that join conditions.
NAMES = {"gemfile": "ruby", "rakefile": "ruby", "podfile": "ruby", "fastfile": "ruby", "appraisals": "ruby", "brewfile": "ruby", "dangerfile": "ruby"}
EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "go": "go",
    "java": "java", "cs": "csharp", "rb": "ruby", "rs": "rust", "php": "php", "kt": "kotlin", "kts": "kotlin",
}
DECISIONS = ("if", "for", "while", "case", "catch")
MORE_DECISIONS = {"python": ("elif", "except"), "ruby": ("elsif", "rescue", "when"), "kotlin": ("when",)}
JOINS = {"python": ("and", "or"), "ruby": ("and", "or")}
#: What runs a script, by the language it is written in.
RUNNERS = {"javascript": ("node", "bun"), "typescript": ("deno", "ts-node", "tsx"), "python": ("python", "python3"), "ruby": ("ruby",), "php": ("php",)}


def extension(path: Column) -> Column:
    """Lower-cased part after the last dot of the file name; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def language_of(path: Column, text: Column) -> Column:
    """Language by extension, else by the first line's runner, else null."""
    runner = F.lower(F.regexp_extract(text, r"^#!\s*(?:\S*/)?(?:env\s+)?(?:\S*/)?([A-Za-z0-9-]+)", 1))
    found = F.lit(None).cast("string")
    for language, names in RUNNERS.items():
        found = F.when(runner.isin(*names), language).otherwise(found)
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), found)


def detected_language(path: Column, text: Column, strict: bool = False) -> Column:
    """Language by the whole file name, else as language_of(); if strict, a file of no known language is an error."""
    name = F.lower(F.substring_index(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/", -1))
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    found = F.coalesce(F.try_element_at(table, name), language_of(path, text))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no known language: "), path)).cast("string")) if strict else found


def code_lines(language: Column, text: Column) -> Column:
    """lines_of_code() by each row's own language; null for an unknown one."""
    hashes = language.isin("python", "ruby")
    return F.when(language.isNull(), None).when(hashes, lines_of_code(text, True)).otherwise(lines_of_code(text))


def normalized_path(path: Column) -> Column:
    """Trimmed, with slashes one way; null for an empty path."""
    return F.nullif(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), F.lit(""))


def resolved_path(path: Column) -> Column:
    """The path without empty and . parts, .. taking one part back (never above the root)."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def patch_text(patch: Column) -> Column:
    """A patch's lines without their marker; lines of one character or none are empty."""
    lines = F.transform(F.split(patch, "\n"), lambda x: F.when(F.length(x) <= 1, "").when(F.substring(x, 1, 1).isin("+", "-", " "), F.substr(x, F.lit(2))).otherwise(x))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def without_comments(text: Column, hashes: bool = False) -> Column:
    """Source text without strings and comments: // and /* */, or # and doc strings if hashes. Strings become a pair of quotes."""
    strings = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'" + ("" if hashes else r"|`(?:\\.|[^`\\])*`")
    comments = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''|#[^\n]*" if hashes else r"/\*[\s\S]*?\*/|//[^\n]*"
    # The leftmost of comment and string wins, so that neither hides in the other; line ends stay.
    kept = F.regexp_replace(text, f"({comments})|({strings})", '$2\x00')
    kept = F.regexp_replace(kept, f"(?:{strings})\x00", '""')
    return F.regexp_replace(kept, "\x00", "")


def lines_of_code(text: Column, hashes: bool = False) -> Column:
    """Lines that hold more than white space once comments are gone."""
    return F.size(F.filter(F.split(without_comments(text, hashes), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")).cast("long")


def cyclomatic(text: Column, language: str) -> Column:
    """1, and 1 for every word that decides and operator that joins conditions; 0 without code."""
    hashes = language in ("python", "ruby")
    code = F.lower(without_comments(text, hashes))
    words = [*DECISIONS, *MORE_DECISIONS.get(language, ()), *JOINS.get(language, ())]
    n = F.regexp_count(code, F.lit(rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])|&&|\|\|"))
    return F.when(F.regexp_replace(code, r"\s", "") == "", 0).otherwise(1 + n).cast("long")


def signature(parameters: Column, returns: Column) -> Column:
    """(types)=>type, each trimmed and in lower case; a missing return type is unknown."""
    return F.concat(F.lit("("), F.array_join(F.transform(parameters, _token), ","), F.lit(")=>"), F.coalesce(_token(returns), F.lit("unknown")))


def _token(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(c, _token), lambda t: t != ""))), ",")


def function_fingerprint(language: Column, path: Column, name: Column, kind: Column, flags: tuple[Column, Column], parent: Column, lines: tuple[Column, Column], imports: Column, calls: Column, signed: Column) -> tuple[Column, Column]:
    """(digest of the function, digest of its signature): SHA-256 of what makes a function, in fixed order.

    flags: async and exported; lines: the first and last one; calls: (caller, callee), of which those of other
    callers don't count; signed: its signature().
    """
    own = F.filter(calls, lambda c: (F.coalesce(_token(c["caller"]), F.lit("")) == "") | (_token(c["caller"]) == _token(name)))
    own_name = F.coalesce(F.nullif(_token(parent), F.lit("")), F.lit("<none>"))
    span = F.greatest(F.lit(1), lines[1] - lines[0] + 1).cast("string")
    parts = {
        "language": _token(language), "filePath": F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "name": _token(name), "kind": _token(kind), "async": flags[0].cast("int").cast("string"), "exported": flags[1].cast("int").cast("string"),
        "parent": own_name, "lineSpan": span, "imports": _tokens(imports), "calls": _tokens(F.transform(own, lambda c: c["callee"])), "signature": signed,
    }
    payload = F.concat_ws("|", *[F.concat(F.lit(f"{k}="), F.coalesce(v, F.lit(""))) for k, v in parts.items()])
    return F.sha2(payload, 256), F.sha2(signed, 256)


#: Keys whose values are never shown, what stands instead, and texts that look like an address.
SENSITIVE = ("password", "token", "authorization", "api_key", "api-key", "secret", "access_token", "refresh_token", "cookie", "set-cookie", "session", "user", "email", "phone", "ip", "code", "snippet", "patch", "diff")
REDACTED, PERSONAL = "[REDACTED]", r"\S+@\S+\.\S+"


def redacted(c: Column, kind: DataType) -> Column:
    """A value of that type with what is sensitive by its key, at any depth, or by its text, replaced."""
    if isinstance(kind, StringType):
        return F.when(c.rlike(PERSONAL), REDACTED).otherwise(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, MapType):
        # Values of one type: what is no text can only be left out.
        hidden = F.lit(REDACTED) if isinstance(kind.valueType, StringType) else F.lit(None)
        return F.transform_values(c, lambda k, v: F.when(F.lower(F.trim(k)).isin(*SENSITIVE), hidden).otherwise(redacted(v, kind.valueType)))
    if isinstance(kind, StructType):
        fields = [(F.lit(REDACTED) if f.name.strip().lower() in SENSITIVE else redacted(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def redacted_json(text: Column) -> Column:
    """JSON texts of any shape, redacted alike and written with their keys in order; null if it is no JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def clean(value, key=None):
            if key is not None and key.strip().lower() in SENSITIVE:
                return REDACTED
            if isinstance(value, str):
                return REDACTED if re.search(PERSONAL, value) else value
            if isinstance(value, list):
                return [clean(x) for x in value]
            return {k: clean(v, k) for k, v in value.items()} if isinstance(value, dict) else value

        def one(text):
            try:
                return None if text is None else json.dumps(clean(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(text)


def role_score(text: Column, signals: dict[str, tuple[str, ...]]) -> Column:
    """The role whose words a text holds most often (the first of equals), or `unknown`."""
    low = F.lower(text)
    counts = {role: sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0)) for role, words in signals.items()}
    most, best = F.greatest(*counts.values()), F.lit("unknown")
    for role in reversed(list(counts)):
        best = F.when((counts[role] == most) & (most > 0), role).otherwise(best)
    return best


def sorted_json(entries: Column) -> Column:
    """JSON of a map of strings, keys in their order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def date_millis(text: Column) -> Column:
    """Milliseconds of a date or a time of day, in UTC where the text names no zone; what is no date comes before all dates."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & text.rlike("T"), text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.coalesce(F.unix_millis(F.try_to_timestamp(zoned)), F.lit(-(2**63)))
