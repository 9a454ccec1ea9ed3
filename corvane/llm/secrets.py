"""Secret scans: known shapes, and a battery of randomness tests with false-discovery control.

Known shapes (kinds assign, access, hex) are leftmost non-overlapping matches, as their patterns say.
Beside them, every run of ``SHORTEST`` and more characters of an encoding alphabet is a candidate. Its
encoding is inferred from its characters (hexadecimal, base 32, base 64). Against "drawn uniformly from
that alphabet" stand a chi-squared test of uniformity, a runs test about the median symbol and a test of
lag-one serial correlation, joined by Fisher's method; a candidate that fails them isn't random. Against
"an ordinary word" (or several written together) stand its letter repetitions and its changes between
letters, cases and digits, whose probabilities depend on its length and encoding, joined likewise. Of the
candidates that look random, those survive for which "an ordinary word" is rejected by the
Benjamini-Hochberg procedure at ``FDR`` within their text, with weights that grow with their length. They
are spans of kind random; known ones stay.

Measured on generated tokens alone in a text (tests/llm): of random ones of 32 to 64 characters over nine in
ten are found (base 32: six in ten at 32), of 20 characters about half; of words written together, names and paths under 2 in 100.

Cases: null text counts as empty; offsets are code points, ends exclusive; repeated rows are scanned
alike; null ids keep their rows. Columns named like the results are replaced. Scale: a map, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.frames import append_columns
from corvane.runtime import table

SHORTEST = 20
FDR = 0.01
RANDOM_FLOOR = 1e-4  # what a random token may fail by chance
KINDS = ("assign", "access", "hex", "random")

_WORDS = ("password", "passwd", "secret", "token")
_ANY_CASE = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile("(" + "|".join(map(_ANY_CASE, _WORDS)) + "|" + _ANY_CASE("api") + "_?" + _ANY_CASE("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so shorter ones can be passed over
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")
_HEX_SET = [set("0123456789abcdef"), set("0123456789ABCDEF")]
_ALPHABETS = {"hex": 16, "base32": 32, "base64": 64}
_BASE32 = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
#: Of ordinary words: the chance that two letters are equal, the same for three, and changes of class for each character.
_PAIR, _TRIPLE, _CHANGES = 0.065, 0.0058, 0.5
_CHANGES_EACH = {"hex": 0.06, "base32": 0.11, "base64": 0.17}  # words written together in one case, or in both


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the known shapes."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def infer_encoding(token: str) -> str:
    chars = set(token)
    if any(chars <= s for s in _HEX_SET):
        return "hex"
    return "base32" if chars <= _BASE32 else "base64"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared, by the Wilson-Hilferty transformation."""
    return _normal_tail(((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def _fisher(ps: list[float]) -> float:
    """Fisher's method for independent p-values (exact for even degrees of freedom)."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = math.exp(-half) if half < 700 else 0.0
    for i in range(1, len(ps)):
        term *= half / i
        total += term
    return min(1.0, total)


def _symbol(c: str, encoding: str) -> int:
    if encoding == "hex":
        return int(c, 16)
    if encoding == "base32":
        return ord(c) - 65 if c.isalpha() else ord(c) - 24
    return ord(c) - 65 if "A" <= c <= "Z" else ord(c) - 71 if "a" <= c <= "z" else ord(c) + 4 if c.isdigit() else 62 if c in "+-" else 63


def randomness(token: str, encoding: str) -> float:
    """p-value against a uniform draw from the encoding's alphabet."""
    n, a = len(token), _ALPHABETS[encoding]
    s = [_symbol(c, encoding) for c in token]
    counts: dict[int, int] = {}
    for x in s:
        counts[x] = counts.get(x, 0) + 1
    uniform = _chi_tail(a / n * sum(c * c for c in counts.values()) - n, a - 1)
    high = [x >= a // 2 for x in s]
    n1 = sum(high)
    n2 = n - n1
    if n1 and n2:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 2 * n1 * n2 / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        by_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var))
    else:
        by_runs = 2.0 ** (1 - n)
    m = sum(s) / n
    spread = sum((x - m) ** 2 for x in s)
    serial = 2 * _normal_tail(abs(sum((x - m) * (y - m) for x, y in zip(s, s[1:])) / spread) * math.sqrt(n)) if spread else 0.0
    return _fisher([uniform, min(by_runs, 1.0), min(serial, 1.0)])


def _poisson_tail(k: int, mean: float) -> float:
    term = total = math.exp(-mean)
    for i in range(1, k):
        term *= mean / i
        total += term
    return max(1 - total, 1e-300) if k else 1.0


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def ordinariness(token: str) -> float:
    """p-value against an ordinary word of this length: as few repeated letters and as many changes of class."""
    n = len(token)
    counts: dict[str, int] = {}
    for c in token.lower():
        counts[c] = counts.get(c, 0) + 1
    squares = sum(c * c for c in counts.values())
    mean = n + n * (n - 1) * _PAIR
    var = 4 * n**3 * (_TRIPLE - _PAIR**2) + 2 * n * n * _PAIR
    few = _normal_tail((mean - squares) / math.sqrt(var))
    classes = [_class(c) for c in token]
    changes = 0
    for i in range(1, n):
        x, y = classes[i - 1 : i + 1]
        begins = x == 1 and y == 0 and (i == 1 or classes[i - 2] != 1)  # a capital at the head of a word
        changes += x != y and 3 not in (x, y) and not begins
    return _fisher([few, _poisson_tail(changes, _CHANGES + _CHANGES_EACH[infer_encoding(token)] * n)])


def random_spans(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of random tokens that overlap no known one."""
    found = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if any(x < b and a < y for _, x, y in known):
            continue
        token = m.group()
        if randomness(token, infer_encoding(token)) >= RANDOM_FLOOR:
            found.append((a, b, ordinariness(token)))
    if not found:
        return []
    weights = [math.log2(b - a) for a, b, _ in found]
    mean = sum(weights) / len(weights)
    ranked = sorted((p * mean / w, a, b) for (a, b, p), w in zip(found, weights))
    last = max((i for i, (p, _, _) in enumerate(ranked, 1) if p <= FDR * i / len(ranked)), default=0)
    return [("random", a, b) for _, a, b in ranked[:last]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_random")] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, comma-joined)."""
    column = docs.columns.index(text)

    def make():
        def function(batch):
            out = []
            for t in batch.column(column).to_pylist():
                known = base_spans(t or "")
                extra = random_spans(t or "", known)
                n = [sum(k == kind for k, _, _ in known) for kind in KINDS[:3]]
                out.append((*n, len(extra), hashlib.sha256(joined(known).encode()).hexdigest(), joined(known + extra)))
            return [pa.array([o[i] for o in out], pa.int64() if i < 4 else pa.string()) for i in range(6)]

        return function

    return append_columns(docs, _FIELDS, make)


def op6_secret_scan(spark, sf_dir):
    """Contract query over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select(F.col("doc_id"), "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")
