"""Scalar functions by name, as expressions over columns.

Strings count from 0; nil gives nil unless noted; integer division is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(28,10)"
REGISTRY: dict[str, Callable[..., Column]] = {}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def scalar(f: Callable[..., Column]) -> Callable[..., Column]:
    REGISTRY[f.__name__.rstrip("_")] = f
    return f


# Logic

@scalar
def xor(a, b):
    return (_c(a) & ~_c(b)) | (~_c(a) & _c(b))


@scalar
def between(x, low, high):
    """Nil if any operand is nil."""
    x, low, high = map(_c, (x, low, high))
    return F.when(x.isNull() | low.isNull() | high.isNull(), F.lit(None).cast("boolean")).otherwise((x >= low) & (x <= high))


@scalar
def compare(a, b):
    """-1, 0 or 1."""
    a, b = _c(a), _c(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


@scalar
def if_nil(x, other):
    return F.coalesce(_c(x), _c(other))


@scalar
def is_nil(x):
    return _c(x).isNull()


@scalar
def min_of(a, b):
    """Nil is skipped."""
    return F.least(_c(a), _c(b))


@scalar
def max_of(a, b):
    return F.greatest(_c(a), _c(b))


# Arithmetic

@scalar
def divide(a, b):
    """Exact decimal quotient, of integers too."""
    return (_c(a).cast(DECIMAL) / _c(b).cast(DECIMAL)).cast(DECIMAL)


@scalar
def div(a, b):
    """Integers truncate towards zero."""
    q = _c(a).cast("decimal(28,0)") / _c(b).cast("decimal(28,0)")
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


@scalar
def div_decimal(a, b):
    """Decimals floor."""
    return F.floor(_c(a).cast(DECIMAL) / _c(b).cast(DECIMAL))


@scalar
def round_(x, digits: int = 2):
    """Halves go up: floor(x * 10^d + 0.5) / 10^d."""
    scale = F.lit(10).cast("decimal(20,0)") ** digits if digits < 0 else F.lit(10**digits).cast("decimal(20,0)")
    return (F.floor(_c(x).cast(DECIMAL) * scale + F.lit("0.5").cast("decimal(2,1)")) / scale).cast(DECIMAL)


@scalar
def truncate(x):
    x = _c(x).cast(DECIMAL)
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


@scalar
def frac(x):
    return (_c(x).cast(DECIMAL) - truncate(x)).cast(DECIMAL)


@scalar
def log(x, base):
    return F.ln(_c(x)) / F.ln(_c(base))


@scalar
def to_integer(x):
    """Decimals round half to even."""
    return F.bround(_c(x).cast(DECIMAL), 0).cast("int")


@scalar
def factorial(x):
    return F.factorial(_c(x).cast("int"))


for _name in ("abs", "floor", "ceiling", "exp", "ln", "log10", "power"):
    REGISTRY[_name] = (lambda f: lambda *xs: f(*map(_c, xs)))(getattr(F, {"power": "pow"}.get(_name, _name)))
for _name, _f in {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "mod": lambda a, b: a % b,
                  "negate": lambda a: -a, "bit_and": Column.bitwiseAND, "bit_or": Column.bitwiseOR, "bit_xor": Column.bitwiseXOR,
                  "bit_not": F.bitwise_not, "shift_left": F.shiftleft, "shift_right": F.shiftright}.items():
    REGISTRY[_name] = (lambda f: lambda a, *b: f(_c(a), *(x if f in (F.shiftleft, F.shiftright) else _c(x) for x in b)))(_f)


# Strings

@scalar
def length(s):
    """In UTF-16 units: code points beyond the base plane count twice."""
    s = _c(s)
    return F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))


@scalar
def char_at(s, i):
    """The character at a place from 0; beyond the end an empty string."""
    s, i = _c(s), _c(i)
    return F.when(i < 0, F.lit("")).otherwise(F.substring(s, i + 1, F.lit(1)))


@scalar
def substring(s, start, count=None):
    s, start = _c(s), F.greatest(_c(start), F.lit(0))
    return F.substring(s, start + 1, _c(count) if count is not None else F.length(s))


@scalar
def pos(part, s):
    """Where the part first stands, from 0; -1 if nowhere."""
    return F.instr(_c(s), _c(part)) - 1


@scalar
def index_of(s, part, start=0):
    return F.position(_c(part), _c(s), _c(start) + 1) - 1


@scalar
def last_index_of(s, part):
    s, part = _c(s), _c(part)
    at = F.instr(F.reverse(s), F.reverse(part))
    return F.when(at == 0, -1).otherwise(F.length(s) - at - F.length(part) + 1)


@scalar
def index_of_any(s, *parts):
    places = [pos(p, s) for p in parts]
    found = F.least(*(F.when(p >= 0, p) for p in places)) if len(places) > 1 else F.when(places[0] >= 0, places[0])
    return F.when(_c(s).isNotNull(), F.coalesce(found, F.lit(-1)))


@scalar
def starts_with(s, part):
    return F.startswith(_c(s), _c(part))


@scalar
def ends_with(s, part):
    return F.endswith(_c(s), _c(part))


@scalar
def pad_left(s, width, pad=" "):
    """Longer strings stay whole."""
    s = _c(s)
    return F.when(F.length(s) >= _c(width), s).otherwise(F.lpad(s, _c(width), _c(pad)))


@scalar
def pad_right(s, width, pad=" "):
    s = _c(s)
    return F.when(F.length(s) >= _c(width), s).otherwise(F.rpad(s, _c(width), _c(pad)))


@scalar
def insert(s, at, part):
    return F.concat(substring(s, 0, at), _c(part), substring(s, at))


@scalar
def remove(s, at, count):
    return F.concat(substring(s, 0, at), substring(s, _c(at) + _c(count)))


@scalar
def replace(s, old, new, ignore_case: bool = False):
    """All matches; the texts are taken as they are."""
    if not ignore_case:
        return F.replace(_c(s), _c(old), _c(new))
    whole = F.concat(F.lit(r"(?iu)\Q"), F.replace(_c(old), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_replace(_c(s), whole, F.regexp_replace(_c(new), F.lit(r"([\\$])"), F.lit(r"\\$1")))


@scalar
def split(s, *delimiters: str):
    """By any of the delimiters, `,` and `;` by default."""
    return F.split(_c(s), "|".join(rf"\Q{d}\E" for d in delimiters or (",", ";")))


@scalar
def count_of(s, part: str):
    """Overlapping matches count."""
    return F.regexp_count(_c(s), F.lit(rf"(?=\Q{part}\E)"))


@scalar
def compare_text(a, b):
    """Case is ignored."""
    return compare(F.lower(_c(a)), F.lower(_c(b)))


for _name, _pattern in {"is_upper": r"[\p{Lu}\P{L}]*", "is_lower": r"[\p{Ll}\P{L}]*", "is_letter": r"\p{L}*", "is_digit": r"\p{Nd}*", "is_letter_or_digit": r"[\p{L}\p{Nd}]*"}.items():
    REGISTRY[_name] = (lambda p: lambda s: F.regexp_like(_c(s), F.lit(rf"\A{p}\z")))(_pattern)
for _name in ("upper", "lower", "trim", "ltrim", "rtrim", "base64", "url_encode", "url_decode"):
    REGISTRY[_name] = (lambda f: lambda s: f(_c(s)))(getattr(F, _name))


# Dates

@scalar
def day_of_week(d):
    """Sunday is 0."""
    return F.dayofweek(_c(d)) - 1


@scalar
def days_in_month(d):
    return F.dayofmonth(F.last_day(_c(d)))


@scalar
def is_leap_year(year):
    y = _c(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


@scalar
def months_between(a, b):
    """Calendar months, days ignored."""
    a, b = _c(a), _c(b)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


@scalar
def years_between(a, b):
    return F.year(_c(b)) - F.year(_c(a))


@scalar
def add_months(d, n):
    return _c(d) + F.make_ym_interval(F.lit(0), _c(n))


@scalar
def add_years(d, n):
    return _c(d) + F.make_ym_interval(_c(n), F.lit(0))


@scalar
def date_part(d):
    return F.to_date(_c(d))


for _name, _f in {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "day_of_year": F.dayofyear}.items():
    REGISTRY[_name] = (lambda f: lambda d: f(_c(d)))(_f)


# Lists, from 0

@scalar
def list_get(xs, i):
    return F.get(_c(xs), _c(i))


@scalar
def list_index_of(xs, x):
    return F.array_position(_c(xs), _c(x)) - 1


@scalar
def list_insert(xs, at, x):
    return F.array_insert(_c(xs), _c(at) + 1, _c(x))


@scalar
def list_remove_at(xs, at):
    return F.filter(_c(xs), lambda _, i: i != _c(at))


@scalar
def list_distinct(xs):
    return F.array_distinct(_c(xs))


@scalar
def list_add(xs, x):
    return F.array_append(_c(xs), _c(x))


@scalar
def list_count(xs):
    return F.size(_c(xs))
