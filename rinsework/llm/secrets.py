"""Secret scans: known forms, and a battery of randomness tests for the rest.

Known forms are found by patterns (assignments to telling names, access key ids, long hexadecimal runs). Beside them every
run of 20 and more key characters is a candidate. Its encoding is inferred (hexadecimal, base32, letters of one case with
digits, or base64), and three tests ask whether it can be uniform noise in that alphabet: chi-squared over classes of the
alphabet, Wald's runs test about the alphabet's middle, and the serial correlation of neighbours. Their p-values are
combined by Fisher's method.

That a candidate can be noise says little of a short one, so the battery's p-value is set against how much likelier noise of
that alphabet and length is than written language, by its letters and its changes between lower case, capitals and digits:
the ratio of language to noise, over the battery's p-value, is at most the chance that language gets so far (Markov's
inequality). Over a document's candidates it is held against a false-discovery rate by Benjamini and Hochberg's rule. A
candidate is reported if it is discovered there and the battery alone doesn't refuse it.

Defined cases: a null text is empty; texts of any length are scanned whole; candidates that overlap a known form aren't reported
again; spans that start together are in the order of KINDS, and candidates with equal doubt in the order of the text; a null
doc_id stays null; repeated rows stay repeated; no rows give no rows; other columns are ignored, and redaction keeps them as
they were.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinsework.llm.workers import tidy

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run that is too short ends where the next begins, so the length may stand here
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ALPHABETS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef", 4),
    ("base32", re.compile(r"[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 4),
    ("base36", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), "abcdefghijklmnopqrstuvwxyz0123456789", 4),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 5),
)
SWITCH = 0.15  # how often language changes between lower case, capitals, digits and signs, at most
#: Letters in a thousand, about the mean of English, German, French and Spanish; digits and signs are even.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (86, 15, 33, 45, 153, 14, 19, 29, 73, 4, 8, 47, 28, 80, 58, 20, 6, 66, 70, 72, 44, 12, 10, 3, 8, 7), strict=True))
RATE = 0.001  # false discoveries among a document's reported candidates
REFUSE = 0.0005  # the battery's combined p-value under which a candidate isn't noise


def _normal_tail(z: float) -> float:
    """Of both sides."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """P(chi-squared > x) by Wilson and Hilferty."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> tuple[str, str, int, str]:
    """Name, alphabet, number of classes, and the token's symbols in it."""
    bare = token.rstrip("=")
    joined = bare.replace("-", "")
    for name, form, alphabet, classes in ALPHABETS:
        if form.fullmatch(own := joined if name == "hex" else bare):
            own = own.lower() if name in ("hex", "base36") else own
            return name, alphabet, classes, own.replace("-", "+").replace("_", "/")
    return "base64", ALPHABETS[-1][2], 5, bare


def battery(token: str) -> float:
    """Combined p-value of the three tests, under the hypothesis of noise."""
    _, alphabet, classes, symbols = encoding(token)
    values = [alphabet.index(c) for c in symbols]
    n, size = len(values), len(alphabet)
    counts = [0] * classes
    for v in values:
        counts[v * classes // size] += 1
    widths = [0] * classes
    for v in range(size):
        widths[v * classes // size] += 1
    uniform = _chi_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths, strict=True)), classes - 1)
    high = [v >= size // 2 for v in values]
    ups = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    if 0 < ups < n:
        mean = 1 + 2 * ups * (n - ups) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        in_runs = _normal_tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        in_runs = 2.0 ** (1 - n)
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:], strict=False)) / power if power else 1.0
    correlated = _normal_tail((serial + 1 / n) * math.sqrt(n))
    x = -sum(math.log(max(p, 1e-300)) for p in (uniform, in_runs, correlated))
    return min(1.0, math.exp(-x) * (1 + x + x * x / 2))  # Fisher: chi-squared with six degrees of freedom


def written(token: str) -> float:
    """Logarithm of how much likelier the token is as written language than as noise of its encoding."""
    _, alphabet, _, symbols = encoding(token)
    bare = token.rstrip("=")
    kinds = ["u" if c.isupper() else "d" if c.isdigit() else "l" if c.islower() else "o" for c in bare]
    language = sum(math.log(LETTERS[c.lower()] / 1010 if k in "ul" else 0.1 if k == "d" else 0.25) for c, k in zip(bare, kinds, strict=True))
    language += math.log(0.25) + sum(math.log(1 - SWITCH if a == b else SWITCH / 3) for a, b in zip(kinds, kinds[1:], strict=False))
    return language + len(symbols) * math.log(len(alphabet))


def doubt(token: str) -> float:
    """At most the chance that language looks so much like noise; 1 if the battery refuses the token."""
    noise = battery(token)
    return 1.0 if noise < REFUSE else math.exp(min(0.0, written(token) - math.log(noise)))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e in found)
    candidates = []
    for m in CANDIDATE.finditer(text):
        candidates.append((doubt(m[0]), m.start(), m.end()))
    candidates.sort()
    passed = max((i + 1 for i, (p, _, _) in enumerate(candidates) if p <= RATE * (i + 1) / len(candidates)), default=0)
    for _, s, e in candidates[:passed]:
        if not any(a < e and s < b for a, b in base):
            found.append(("random", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py() or "") for t in b.column(1)]
            counts = [pa.array([sum(k == kind for k, _, _ in x) for x in found], pa.int64()) for kind in KINDS[:3]]
            base = [hashlib.sha256(joined([y for y in x if y[0] != "random"]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, s, e in scan(text):
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced, and n_chars set anew where a text changed."""
    text, length = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(text).to_pylist()
            new = [t if t is None else redacted(t) for t in old]
            columns = list(b.columns)
            columns[text] = pa.array(new, b.schema.field(text).type)
            if length is not None:
                columns[length] = pa.array([n if a == t else len(t) for a, t, n in zip(old, new, columns[length].to_pylist(), strict=True)], b.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
