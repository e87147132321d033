"""Column expressions shared by every operator.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen and also works on a
streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Text that counts as a "textual null" once stripped and lower-cased.
NULL_MARKERS: tuple[str, ...] = ("", "na", "n/a", "nan", "null", "none")

# Date formats tried in order by date sniffing and date conversion
# (first successful parse wins).
DATE_FORMATS: tuple[str, ...] = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "d/M/yyyy",
    "dd-MMM-yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "M-d-yyyy",
    "d-M-yyyy",
    "M.d.yyyy",
    "d.M.yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
)
# ---------------------------------------------------------------------------

# Python's notion of whitespace (what ``str.strip`` removes), derived from
# the interpreter rather than listed by hand.
WHITESPACE: str = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def quoted(name: str) -> Column:
    """The top-level column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _col(c: str | Column) -> Column:
    return quoted(c) if isinstance(c, str) else c


# --- type predicates --------------------------------------------------------

def is_numeric_type(dt: T.DataType) -> bool:
    """Numbers only; booleans are never numeric here (decision D13)."""
    return isinstance(dt, T.NumericType)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_text_type(f.dataType) and f.name not in skip]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing_cols = [c for c in columns if c not in df.columns]
    if missing_cols:
        raise KeyError(f"Column(s) {missing_cols} do not exist.")


# --- string helpers ---------------------------------------------------------

def strip(c: str | Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.trim(_col(c), F.lit(WHITESPACE))


def has_edge_whitespace(c: str | Column) -> Column:
    """value != strip(value), decided by byte lengths (no full comparison)."""
    col = _col(c)
    return F.octet_length(col) != F.octet_length(strip(col))


def stripped_or_null(c: str | Column) -> Column:
    """strip(value), or null when that is empty (blank values drop out)."""
    s = strip(c)
    return F.when(F.octet_length(s) > 0, s)


def norm(c: str | Column) -> Column:
    """strip + lower: the key that groups spelling variants."""
    return F.lower(strip(c))


# Full case folding beyond lower case, from the interpreter's tables: letters
# that stay as they are in lower case but fold to another text (one to one, or
# one to many such as sharp s).
_FOLDS = {ch: ch.casefold() for ch in map(chr, range(0x110000)) if ch.lower() == ch != ch.casefold()}
_FOLD_ONE = {ch: to for ch, to in _FOLDS.items() if len(to) == 1}
_FOLD_MANY = {ch: to for ch, to in _FOLDS.items() if len(to) > 1}
_FOLD_REST = {ch: to for ch, to in _FOLD_MANY.items() if ch != "\u00df"}


def casefold(c: str | Column) -> Column:
    """``str.casefold()``. ASCII texts are only lowered; others lose their
    special letters through the table of one-letter folds and sharp s, and only
    texts that hold another long fold go through those. The one-element arrays
    bind a text that is used several times."""
    def rest(s: Column) -> Column:
        out = s
        for ch, to in _FOLD_REST.items():
            out = F.replace(out, F.lit(ch), F.lit(to))
        return F.when(F.translate(s, "".join(_FOLD_REST), "") == s, s).otherwise(out)

    def folded(s: Column) -> Column:
        out = F.replace(F.translate(s, "".join(_FOLD_ONE), "".join(_FOLD_ONE.values())),
                        F.lit("\u00df"), F.lit(_FOLD_MANY["\u00df"]))
        return F.when(F.octet_length(s) == F.char_length(s), s).otherwise(bound(out, rest))

    return bound(F.lower(_col(c)), folded)


def folded_norm(c: str | Column) -> Column:
    """strip + casefold: the key that groups spelling variants of evidence."""
    return casefold(strip(c))


# --- missing-value predicates (P6, P7) -------------------------------------

def genuine_missing(c: str | Column, dt: T.DataType) -> Column:
    """null, or NaN for floating columns (pandas ``isna``)."""
    col = _col(c)
    if is_float_type(dt):
        return col.isNull() | F.isnan(col)
    return col.isNull()


MAX_MARKER_LENGTH = max(len(m) for m in NULL_MARKERS)


def is_marker_text(c: str | Column) -> Column:
    """strip + lower is a null marker. Only short stripped values can match,
    so long texts are rejected by length before anything is lower-cased."""
    s = strip(c)
    return F.when(F.length(s) <= MAX_MARKER_LENGTH, F.lower(s).isin(*NULL_MARKERS)).otherwise(F.lit(False))


def textual_null(c: str | Column, dt: T.DataType) -> Column:
    """A present text value whose normalized form is a null marker."""
    if not is_text_type(dt):
        return F.lit(False)
    col = _col(c)
    return col.isNotNull() & is_marker_text(col)


def missing(c: str | Column, dt: T.DataType) -> Column:
    """Genuine missing or textual null (P6); never null itself."""
    return F.coalesce(genuine_missing(c, dt) | textual_null(c, dt), F.lit(True))


def nan_to_null(c: str | Column, dt: T.DataType) -> Column:
    """Decision D2: treat NaN like null before aggregating floats."""
    col = _col(c)
    return F.nanvl(col, F.lit(None).cast(dt)) if is_float_type(dt) else col


# --- parsing ----------------------------------------------------------------

def to_number(c: str | Column) -> Column:
    """Guarded text -> double (decision D5).

    Strips, casts with ``try_cast`` and rejects what a pandas user would
    not call a number: NaN and digit-led text with a Java float suffix
    (``1d``, ``2f``).
    """
    s = strip(_col(c).cast("string"))
    # A failed cast costs a thrown exception inside the JVM, so the cast is
    # tried only on text that starts (after control characters, which the
    # cast ignores) with a sign, digit, point or the i/n of inf/nan: a
    # superset of the text the cast accepts.
    v = F.when(s.rlike(r"^[\x00-\x20\x7f-\x9f]*[+-]?[0-9.iInN]"), s.try_cast("double"))
    suffixed = s.rlike(r"^[+-]?[0-9.].*[dDfF]$")
    return F.when(v.isNull() | F.isnan(v) | suffixed, F.lit(None).cast("double")).otherwise(v)


def format_shape(fmt: str) -> str:
    """A regex accepting at least every text the datetime pattern can parse
    (runs of digits for numeric fields, letters for month names), derived
    from the pattern by rule. It only filters out parse attempts that cannot
    succeed, so it is deliberately loose."""
    import re as _re
    out = []
    for run in _re.finditer(r"('[^']*'|y+|M+|d+|H+|m+|s+|S+|X+|[^'yMdHmsSX]+)", fmt):
        tok = run.group(0)
        if tok[0] == "'":
            out.append(_re.escape(tok[1:-1]))
        elif tok[0] == "X":
            out.append(r"(?:[Zz]|[+-][0-9:]+)")
        elif tok[0] == "M" and len(tok) >= 3:
            out.append(r"\p{L}+")
        elif tok[0] in "yMdHmsS":
            out.append(r"\d+")
        else:
            out.append(_re.escape(tok))
    return "^" + "".join(out) + "$"


def to_timestamp_any(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses wins; failures give null (decision D4).
    The result is a wall-clock ``timestamp_ntz`` like a naive pandas date;
    a text with a zone gives the wall clock of the session's time zone.
    Each parse is attempted only when the text has the format's shape, so
    prose costs one anchored regex test and no failed parse."""
    s = _col(c).cast("string")
    shapes = [format_shape(fmt) for fmt in formats]
    parsed = F.coalesce(*[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt)))
                          for shape, fmt in zip(shapes, formats)])
    # One alternation of all shapes rejects non-dates with a single regex
    # test instead of one per format.
    any_shape = "^(?:" + "|".join(sh[1:-1] for sh in shapes) + ")$"
    return F.when(s.rlike(any_shape), parsed).cast("timestamp_ntz")
