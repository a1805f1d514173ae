"""Text column expressions.

All functions take and return ``Column``s and stay JVM-side (codegen or
built-in higher-order functions), except ``canonical_unicode`` which needs
``unicodedata`` and runs as an Arrow UDF, some texts of a batch at a time.
"""

from __future__ import annotations

import re

import string
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# These must equal the reference's character classes and label
# list for results to agree. Stated in natural order.
# ---------------------------------------------------------------------------

# Control characters removed by text normalisation (U+0010 is not among them).
NORM_CONTROLS = (
    "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011"
    "\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
)
# Characters replaced by a space.
NORM_SPACES = "\u000b\u000c\u0085"
# Hyphen, dash and minus variants replaced by '-'.
NORM_HYPHENS = "‐‑⁃‒–—―−－⁻"
# Soft hyphen, removed.
NORM_SOFT_HYPHEN = "­"
# Double-quote variants replaced by '"'.
NORM_DOUBLE_QUOTES = "“”„‟"
# Single quotes, apostrophes and accents replaced by "'".
NORM_SINGLE_QUOTES = "‘’‚‛՚Ꞌꞌ＇`´"
# Primes, replaced in this order by the given number of "'".
NORM_PRIMES = (("′", 1), ("‵", 1), ("″", 2), ("‶", 2),
               ("‴", 3), ("‷", 3), ("⁗", 4))
# Slash variants replaced by '/'.
NORM_SLASHES = "⁄∕"

# Token pattern: a run of letters/numbers/marks, or any single character that
# is neither a separator nor a control/format/unassigned character.
TOKEN_PATTERN = r"([\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}])"

# The 11 verbal confidence labels, index 0..10.
VERBAL_LABELS = ("Unlikely", "Doubtful", "Uncertain", "Ambiguous", "Probable",
                 "Likely", "Possible", "Specified", "Confirmed", "Certain",
                 "Inevitable")

ASCII_PUNCTUATION = string.punctuation


# ---------------------------------------------------------------------------
# B1 normalize_text
# ---------------------------------------------------------------------------

def _norm_translate_tables() -> tuple[str, str]:
    src, dst = [], []
    for ch in NORM_SPACES:
        src.append(ch); dst.append(" ")
    for ch in NORM_HYPHENS:
        src.append(ch); dst.append("-")
    for ch in NORM_DOUBLE_QUOTES:
        src.append(ch); dst.append('"')
    for ch in NORM_SINGLE_QUOTES:
        src.append(ch); dst.append("'")
    for ch in NORM_SLASHES:
        src.append(ch); dst.append("/")
    # characters without a counterpart in dst are deleted by translate
    deletions = NORM_CONTROLS + NORM_SOFT_HYPHEN
    return "".join(src) + deletions, "".join(dst)


NORM_FROM, NORM_TO = _norm_translate_tables()


def normalize_text(col) -> Column:
    """Punctuation/quote/dash canonicalisation.

    One-to-one maps and deletions touch disjoint characters and commute, so
    they run as one ``translate``; the one-to-many replacements follow in
    order (primes, ellipsis, spaced dots).
    """
    out = F.translate(_c(col), NORM_FROM, NORM_TO)
    for ch, n in NORM_PRIMES:
        out = F.replace(out, F.lit(ch), F.lit("'" * n))
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.replace(out, F.lit(" . . . "), F.lit(" ... "))
    return out


# ---------------------------------------------------------------------------
# B2 / B3 tokens and unicode
# ---------------------------------------------------------------------------

def word_tokens(col, lower: bool = True) -> Column:
    toks = F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 1)
    if lower:
        toks = F.transform(toks, lambda t: F.lower(t))
    return toks


HANDLED = 256  # texts of an Arrow batch that are Python objects at one time


def _normalized(texts: pa.Array, form: str) -> pa.Array:
    """Canonical form of a batch's texts; nulls stay."""
    def norm(v):
        return v if v is None or unicodedata.is_normalized(form, v) else unicodedata.normalize(form, v)

    parts = [pa.array([norm(v) for v in texts.slice(at, HANDLED).to_pylist()], pa.string()) for at in range(0, len(texts), HANDLED)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfc(s: pa.Array) -> pa.Array:
    return _normalized(s, "NFC")


@F.arrow_udf(T.StringType())
def _nfd(s: pa.Array) -> pa.Array:
    return _normalized(s, "NFD")


def canonical_unicode(col, form: str = "NFC") -> Column:
    """Canonical composition (default) or decomposition.

    Token matching only needs both sides in the same canonical form; since
    combining marks are inside the token class, NFC and NFD give the same
    token boundaries and the same matches.
    """
    return (_nfc if form == "NFC" else _nfd)(_c(col))


# ---------------------------------------------------------------------------
# B4 normalize_answer
# ---------------------------------------------------------------------------

def normalize_answer(col) -> Column:
    s = F.translate(F.lower(_c(col)), ASCII_PUNCTUATION, "")
    s = F.regexp_replace(s, r"(?U)\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def answer_tokens(col) -> Column:
    """Whitespace tokens of the normalised answer (empty array for '')."""
    n = normalize_answer(col)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


# ---------------------------------------------------------------------------
# B5 .. B11 prompt assembly
# ---------------------------------------------------------------------------

def compose_passage(title, text) -> Column:
    t = _c(title)
    return F.when(F.length(F.coalesce(t, F.lit(""))) > 0,
                  F.concat(t, F.lit(" "), _c(text))).otherwise(_c(text))


def render_template(template, values: list[tuple[str, Column | str]]) -> Column:
    """Sequential placeholder substitution in the given order.

    A value that itself contains a later placeholder is substituted again,
    exactly like chained ``str.replace`` calls.
    """
    out = template if isinstance(template, Column) else F.lit(template)
    for placeholder, value in values:
        out = F.replace(out, F.lit(placeholder), _c(value))
    return out


def render_context_block(contexts, k: int, sep: str = " - ") -> Column:
    """"\\n" + "\\n".join("title - text") over the first min(k, n) contexts."""
    first = F.slice(_c(contexts), 1, k)
    lines = F.transform(first, lambda c: F.concat(c["title"], F.lit(sep), c["text"]))
    return F.concat(F.lit("\n"), F.array_join(lines, "\n"))


def extract_between(col, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the next ``start``, cut at
    ``end``, stripped. Missing ``start`` → null."""
    c = _c(col)
    after = F.split_part(c, F.lit(start), F.lit(2))
    cut = F.split_part(after, F.lit(end), F.lit(1))
    return F.when(F.locate(start, c) > 0, py_strip(cut))


def py_strip(col) -> Column:
    """Strip leading/trailing Unicode whitespace (``str.strip()``)."""
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def split_once(col, marker: str) -> tuple[Column, Column]:
    """(prefix, rest) around the first ``marker``; both null if missing."""
    c = _c(col)
    pos = F.locate(marker, c)
    prefix = F.when(pos > 0, F.substring_index(c, marker, 1))
    rest = F.when(pos > 0, F.substr(c, pos + F.lit(len(marker))))
    return prefix, rest


def inject_before(col, marker: str, value) -> Column:
    """Insert ``value`` + newline before every ``marker``."""
    v = _c(value) if not isinstance(value, str) else F.lit(value)
    return F.replace(_c(col), F.lit(marker), F.concat(v, F.lit("\n" + marker)))


def temperature_line(temp) -> Column:
    return F.format_string("Temperature: %.4f", _c(temp).cast("double"))


def cut_at_tag(col, tag: str, continuation=None) -> Column:
    """Text before the first ``tag``, then the tag, then an optional continuation."""
    head = F.concat(F.substring_index(_c(col), tag, 1), F.lit(tag))
    if continuation is None:
        return head
    return F.concat(head, _c(continuation))


def is_abstain(col) -> Column:
    return F.lower(_c(col)).contains("no answer")


def parse_verdict(col) -> Column:
    return F.lower(F.trim(_c(col))).contains("yes").cast("int")


def grade_substring(gold, pred) -> Column:
    return _c(pred).contains(_c(gold)).cast("int")


def parse_list(col) -> Column:
    """List literal → array<string>; never evaluates code. Items may be in
    single or double quotes, mixed, with backslash escapes; malformed input
    gives null."""
    return F.from_json(F.trim(_c(col)), "array<string>",
                       {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


# ---------------------------------------------------------------------------
# B16 .. B18 confidence strings
# ---------------------------------------------------------------------------

def verbal_label(idx) -> Column:
    """0..10 → label; out of range → null."""
    arr = F.array(*[F.lit(x) for x in VERBAL_LABELS])
    i = _c(idx).cast("int")
    return F.when((i >= 0) & (i <= 10), F.element_at(arr, i + 1))


def verbal_index(label) -> Column:
    """label → 0..10; unknown → null."""
    arr = F.array(*[F.lit(x) for x in VERBAL_LABELS])
    pos = F.array_position(arr, _c(label))
    return F.when(pos > 0, (pos - 1).cast("int"))


C_TYPES = ("ling", "number", "ct")


def _ctype(c_type) -> Column:
    """A confidence type given as one of C_TYPES is a literal; any other
    string names a column."""
    if isinstance(c_type, str):
        return F.lit(c_type) if c_type in C_TYPES else F.col(c_type)
    return c_type


def format_confidence(c, c_type) -> Column:
    """ling → label; number → '<c> (0-10)' with c rounded to 2;
    otherwise → '<round(100c, 2)> (0-100)', falling back to the raw text."""
    cc = _c(c)
    num = cc.cast("double")
    t = _ctype(c_type)
    pct = F.concat(F.round(num * 100, 2).cast("string"), F.lit(" (0-100)"))
    return (F.when(t == "ling", verbal_label(num.cast("int")))
            .when(t == "number", F.concat(F.round(num, 2).cast("string"), F.lit(" (0-10)")))
            .otherwise(F.coalesce(pct, cc.cast("string"))))


def number_bin_mid(n) -> Column:
    """Midpoint of bin n of 11 equal bins of [0, 1] (edges i/11, last = 1)."""
    i = _c(n).cast("double")
    lo = i * F.lit(1.0 / 11)
    hi = F.when(i + 1 >= 11, F.lit(1.0)).otherwise((i + 1) * F.lit(1.0 / 11))
    return (lo + hi) / 2


def parse_confidence(c_raw, c_type) -> Column:
    """Confidence string → probability in [0, 1]."""
    raw = _c(c_raw)
    t = _ctype(c_type)
    val = raw.try_cast("double")
    prefix = F.split_part(raw, F.lit(" ("), F.lit(1)).try_cast("double")
    is_int = val == F.floor(val)
    number = F.when(is_int & (val >= 0) & (val <= 10), number_bin_mid(val)).when(~is_int, val / 10)
    return (F.when(t == "ling", verbal_index(raw) / 10)
            .when(t == "number", number)
            .otherwise(F.coalesce(prefix / 100, val)))


# ---------------------------------------------------------------------------
# B19 / B20
# ---------------------------------------------------------------------------

def judge_prompt(template: str, preds, question=None, gold=None) -> Column:
    """Fill <prediction1>..<predictionN> (1-based) plus question/gold.

    ``preds`` is an array<string> column; each numbered line is
    "<i>. <pred>" and the whole list replaces ``<predictions>``; numbered
    slots beyond the list's end become empty.
    """
    p = _c(preds)
    numbered = F.array_join(
        F.transform(p, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    out = F.replace(F.lit(template), F.lit("<predictions>"), numbered)
    for slot in dict.fromkeys(re.findall(r"<prediction(\d+)>", template)):
        pred = F.coalesce(F.get(p, F.lit(int(slot) - 1)), F.lit(""))
        out = F.replace(out, F.lit(f"<prediction{slot}>"), pred)
    if question is not None:
        out = F.replace(out, F.lit("<question>"), _c(question))
    if gold is not None:
        out = F.replace(out, F.lit("<ground-truth>"), _c(gold))
    return out


def append_question(prompt, output, suffix, temperature=None) -> Column:
    """prompt + output + suffix (suffix may carry <temp_value>)."""
    s = F.lit(suffix) if isinstance(suffix, str) else suffix
    if temperature is not None:
        s = F.replace(s, F.lit("<temp_value>"), _c(temperature).cast("string"))
    return F.concat(_c(prompt), _c(output), s)
