"""Personal data by weak supervision.

Candidates are found by base patterns, by looser ones, and by those of added kinds (secrets, IBANs, names).
Regex, gazetteer, context, shape and checksum labelers vote on each; expectation-maximisation over the counts
of vote patterns estimates how reliable every labeler is, and the posteriors train a final span classifier,
which also sees the span itself. Base spans always stay; others are added where the classifier accepts them.
Looser spans never overlap base ones; a span of an added kind may (a card number inside a secret).

Defined cases: a null text is empty and has no spans; very long texts are read whole, in linear time;
matches that fail their check are dropped without another try; repeated rows are judged each; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from quillmine.llm.common import mapped

KINDS = ("email", "ip", "card", "phone")
# The base patterns' classes, as the contract states them.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits does, so that long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Kinds that only the method finds.
ADDED = ("secret", "iban", "name")
ALL = KINDS + ADDED
# Looser candidates. Runs are possessive, so that a text is read in linear time.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|@)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|\.)[\])]) ?[A-Za-z0-9-]{2,}+)+", re.I)
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w-])")
_GROUPED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([-. ])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.])")
# Secrets: what is assigned to a name, and long runs that look drawn at random.
_ASSIGNED = re.compile(r"(?<=[=:])[\x20\t]*+[\"']?+([^\s\"'<>,;]{8,}+)")
_RANDOM = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<!\w)(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z'-]+(?: [A-Z][a-z'-]+)?")
#: Gazetteers and cues.
TOP_DOMAINS = frozenset("com org net edu gov io co uk de fr es it nl eu info".split())
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private", "auth", "credential")
IBAN_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
FIRST_NAMES = frozenset("anna anne antonio carlos claire david elena emma erik francois hans james jean john jose juan julia karl laura lucas luis maria marie martin mary michael paul peter pierre robert sofia stefan thomas william".split())
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "llama"),
    "secret": ("login", "bearer", "export", "config", "env", "sign"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "name": ("dear", "signed", "regards", "by ", "liebe", "cher", "estimad"),
}
CONTEXT = 32
EM_ROUNDS = 50


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            end = m.end()
        nxt = text.find("@", at + 1)
        if nxt >= 0 and not m:
            end = max(end, at + 1)
        at = nxt
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    """Looser spans; each pattern is tried only where a character that it needs occurs."""
    if "[" in text or "(" in text:
        yield from (("email", *m.span()) for m in _SPELT.finditer(text))
    yield from (("card", *m.span()) for m in _GROUPED_CARD.finditer(text))
    yield from (("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text))


def _added(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the added kinds, none overlapping another of its kind."""
    found = [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)] + [("secret", *m.span()) for m in _RANDOM.finditer(text)]
    found += [("iban", *m.span()) for m in _IBAN.finditer(text)] + [("name", *m.span()) for m in _NAME.finditer(text)]
    ends = dict.fromkeys(ADDED, -1)
    for k, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= ends[k]:
            ends[k] = b
            yield k, a, b


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans (true), looser spans that none of them overlaps, and spans of the added kinds (false)."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(k, a, b, True) for k, a, b in base]
    i = reach = 0
    for k, a, b in sorted(_loose(text), key=lambda s: (s[1], -s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        j, hit = i, a < reach
        while not hit and j < len(taken) and taken[j][0] < b:
            hit = taken[j][1] > a
            j += 1
        if not hit:
            out.append((k, a, b, False))
            reach = b
    return out + [(k, a, b, False) for k, a, b in _added(text)]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _evenness(s: str) -> float:
    """Bits a character of the span's own letter counts."""
    count = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    return float(-(count / len(s) * np.log2(count / len(s))).sum())


def _check(kind: str, s: str, digits: str) -> int:
    """The checksum or randomness labeler."""
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and _luhn(digits) else -1
    if kind == "iban":
        return 1 if _mod97(s) else -1
    if kind == "secret":
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        return 1 if mixed and _evenness(s) >= 3 else -1
    return 0


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """Votes of the regex, gazetteer, context, shape and checksum labelers: 1 for, 0 abstains, -1 against."""
    s = text[a:b]
    before = text[max(0, a - CONTEXT) : a].lower()
    around = before + " " + text[b : b + CONTEXT].lower()
    digits = _digits(s)
    regex = 1 if base else 0
    shape = -1 if digits and len(set(digits)) <= 2 else 1
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", s.lower().rstrip(")]"))[-1] in TOP_DOMAINS else -1
        shape = 1 if len(s) <= 80 and any(map(str.isalpha, s)) else -1
    elif kind == "ip":
        gazetteer = -1 if s.split(".")[0].lstrip("0") in ("", "127", "255") else 0
    elif kind == "card":
        gazetteer = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    elif kind == "phone":
        gazetteer = 1 if s.startswith(("+", "(")) else 0
    elif kind == "secret":
        gazetteer = 1 if any(n in before for n in SECRET_NAMES) else 0
        regex = 1 if _RANDOM.fullmatch(s) else 0
        shape = -1 if "/" in s or "://" in text[max(0, a - 8) : b] or s.isalpha() or s.isdigit() else 1
    elif kind == "iban":
        gazetteer = 1 if s[:2] in IBAN_COUNTRIES else -1
    else:
        parts = s.lower().replace(".", "").split()[1:]
        gazetteer = 1 if parts[0] in FIRST_NAMES else 0
        shape = 1 if len(parts) == 2 else 0
    context = 1 if any(c in around for c in CUES[kind]) else 0
    return (regex, gazetteer, context, shape, _check(kind, s, digits))


#: Number of values of each feature of a span.
FEATURES = (5, 5, 3, 4)


def features(s: str) -> tuple[int, ...]:
    """What the classifier sees of the span itself: length, part of digits, case, evenness, in steps."""
    n = len(s)
    length = min(4, n.bit_length() - 2 if n >= 4 else 0)
    digits = sum(c.isdigit() for c in s) * 4 // n
    case = 0 if s == s.lower() else 1 if s == s.upper() else 2
    return (length, digits, case, min(3, int(_evenness(s))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[tuple, int] = {}
        for t in batch.column(0):
            text = t.as_py() or ""
            for k, a, b, base in candidates(text):
                p = (k, *votes(text, k, a, b, base), *features(text[a:b]))
                count[p] = count.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in count], pa.string()), pa.array([list(p[1:]) for p in count], pa.list_(pa.int32())), pa.array(list(count.values()), pa.int64())], names=["kind", "seen", "n"])


def reliabilities(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Posterior of each vote pattern by EM over a two-class model with independent labelers."""
    p = np.clip(0.5 + 0.2 * v.sum(1), 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        logs = []
        for weight in (n * (1 - p), n * p):
            share = (weight.sum() + 1) / (n.sum() + 2)
            ll = np.full(len(v), np.log(share))
            for j in range(v.shape[1]):
                c = np.array([weight[v[:, j] == x].sum() + 1 for x in (-1, 0, 1)])
                ll += np.log(c / c.sum())[v[:, j] + 1]
            logs.append(ll)
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
    return p


LABELERS = 5


def inputs(seen: np.ndarray) -> np.ndarray:
    """The classifier's inputs: 1, the votes, and each feature's value as an indicator."""
    v, f = seen[:, :LABELERS], seen[:, LABELERS:]
    return np.hstack([np.ones((len(seen), 1)), v, *[f[:, [i]] == np.arange(n) for i, n in enumerate(FEATURES)]]).astype(float)


def span_classifier(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logistic weights fitted to the posteriors, each pattern weighing its share; votes lean to 0.5, the rest to 0."""
    lean = np.array([0.0] + [0.5] * LABELERS + [0.0] * sum(FEATURES))
    w, weight = lean.copy(), n / n.sum()
    for _ in range(300):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w += x.T @ (weight * (p - q)) - 0.01 * (w - lean)
    return w


def fit(docs: DataFrame) -> dict[str, list[float]]:
    """Classifier weights per kind, from the counts of what is seen at all documents' candidates.

    Votes have at most 243 patterns and features at most 300, so that the counts are bounded whatever the corpus.
    """
    counts = mapped(docs.select("text"), _patterns, "kind string, seen array<int>, n long").groupBy("kind", "seen").agg(F.sum("n").alias("n")).collect()
    model = {}
    for kind in ALL:
        own = sorted((tuple(r["seen"]), r["n"]) for r in counts if r["kind"] == kind)
        if own:
            seen, n = np.array([o[0] for o in own]), np.array([o[1] for o in own], float)
            model[kind] = span_classifier(inputs(seen), n, reliabilities(seen[:, :LABELERS], n)).tolist()
    return model


def spans_of(text: str | None, model: dict[str, list[float]]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind as listed, then start."""
    text = text or ""
    out = []
    for k, a, b, base in candidates(text):
        if not base:
            w = model.get(k)
            if w is None or float((inputs(np.array([[*votes(text, k, a, b, base), *features(text[a:b])]])) @ w)[0]) <= 0:
                continue
        out.append((k, a, b, base))
    return sorted(out, key=lambda s: (ALL.index(s[0]), s[1]))


_SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())])
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def redacted(text: str | None, spans: list[tuple[str, int, int, bool]]) -> str | None:
    """Each stretch of overlapping spans becomes [KIND], by the one that starts first."""
    if text is None:
        return None
    out, at = [], 0
    for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: dict[str, list[float]], spans: str = "pii_spans", clean: str = "pii_redacted") -> DataFrame:
    """The documents with columns spans and clean, which replace columns of these names."""
    docs = docs.drop(spans, clean)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(spans, ArrayType(_SPAN)), StructField(clean, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            found = [spans_of(t, model) for t in texts]
            rows = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in f] for f in found], _ARROW_SPAN)
            redone = pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows, redone], names=[*batch.schema.names, spans, clean])

    return mapped(docs, run, schema)
