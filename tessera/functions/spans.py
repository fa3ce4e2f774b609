"""Time spans, date fields, conversions, generators and encodings, by name.

A time span is a day-time interval; its ticks are tenths of a microsecond, of
which Spark keeps whole microseconds. Dates with a time have no zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import DECIMAL, REGISTRY, _c, index_of, last_index_of, scalar, substring

MICROS = {"milliseconds": 1_000, "seconds": 1_000_000, "minutes": 60_000_000, "hours": 3_600_000_000, "days": 86_400_000_000}
EPOCH = "timestamp_ntz'0001-01-01 00:00:00'"


def micros(span) -> Column:
    """The whole span in microseconds."""
    part = lambda unit: F.extract(F.lit(unit), _c(span))
    whole = lambda unit: part(unit).cast("bigint")
    return (whole("DAY") * 86_400 + whole("HOUR") * 3_600 + whole("MINUTE") * 60) * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def of_micros(n) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, (_c(n).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


for _unit, _size in MICROS.items():
    REGISTRY[f"span_{_unit}"] = (lambda k: lambda n: of_micros(F.round(_c(n).cast(DECIMAL) * k)))(_size)
    REGISTRY[f"total_{_unit}"] = (lambda k: lambda s: (micros(s).cast("decimal(20,0)") / F.lit(k)).cast(DECIMAL))(_size)
for _name, _unit in {"span_day": "DAY", "span_hour": "HOUR", "span_minute": "MINUTE"}.items():
    REGISTRY[_name] = (lambda u: lambda s: F.extract(F.lit(u), _c(s)).cast("int"))(_unit)


@scalar
def span_second(s):
    m = micros(s)
    return REGISTRY["div"](m, 1_000_000).cast("int") % 60


@scalar
def span_millisecond(s):
    return (REGISTRY["div"](micros(s), 1_000) % 1_000).cast("int")


@scalar
def time_span(days=0, hours=0, minutes=0, seconds=0, milliseconds=0):
    given = zip((days, hours, minutes, seconds, milliseconds), reversed(MICROS.values()), strict=True)
    return of_micros(sum((_c(n).cast("bigint") * k for n, k in given), F.lit(0).cast("bigint")))


@scalar
def span_ticks(n):
    return of_micros(REGISTRY["div"](n, 10))


@scalar
def total_ticks(s):
    return micros(s) * 10


@scalar
def span_multiply(s, x):
    return of_micros(F.round(micros(s).cast("decimal(20,0)") * _c(x).cast("decimal(18,8)")))


@scalar
def span_divide(s, x):
    return of_micros(F.round(micros(s).cast("decimal(20,0)") / _c(x).cast("decimal(18,8)")))


@scalar
def span_ratio(a, b):
    """Span by span: a number."""
    return (micros(a).cast("decimal(20,0)") / micros(b).cast("decimal(20,0)")).cast(DECIMAL)


# Dates

@scalar
def date_time(year, month, day, hour=0, minute=0, second=0, millisecond=0):
    seconds = _c(second).cast("decimal(8,6)") + (_c(millisecond).cast("decimal(8,3)") / 1000).cast("decimal(8,6)")
    return F.make_timestamp_ntz(*map(_c, (year, month, day, hour, minute)), seconds.cast("decimal(16,6)"))


FIELDS = ("year", "month", "day", "hour", "minute", "second", "millisecond")


@scalar
def millisecond(d):
    return ((F.extract(F.lit("SECOND"), _c(d)) * 1000).cast("bigint") % 1000).cast("int")


def _with(name: str):
    def changed(d, n):
        """The same moment with one field changed."""
        now = {x: REGISTRY[x](_c(d)) for x in FIELDS}
        return date_time(**now | {name: n})

    return changed


for _name in FIELDS:
    REGISTRY[f"with_{_name}"] = _with(_name)


@scalar
def duration(start, end):
    return _c(end).cast("timestamp_ntz") - _c(start).cast("timestamp_ntz")


@scalar
def date_ticks(d):
    """Tenths of a microsecond since the first day of year 1."""
    return micros(_c(d).cast("timestamp_ntz") - F.expr(EPOCH)) * 10


@scalar
def from_ticks(n):
    return F.expr(EPOCH) + span_ticks(n)


@scalar
def time_part(d):
    """The span since midnight."""
    d = _c(d).cast("timestamp_ntz")
    return d - F.to_date(d).cast("timestamp_ntz")


# Conversions: halves go to the even number, what doesn't fit is an error

def _whole(x) -> Column:
    return F.bround(_c(x).cast(DECIMAL), 0)


for _name, _kind in {"to_short": "smallint", "to_long": "bigint"}.items():
    REGISTRY[_name] = (lambda k: lambda x: _whole(x).cast(k))(_kind)
for _name, _kind in {"to_decimal": DECIMAL, "to_money": "decimal(28,8)", "to_string": "string", "to_boolean": "boolean", "to_date": "date",
                     "to_date_time": "timestamp_ntz", "to_time_span": "interval day to second"}.items():
    REGISTRY[_name] = (lambda k: lambda x: _c(x).cast(k))(_kind)


@scalar
def to_byte(x):
    """0 to 255, without a sign."""
    n = _whole(x).cast("smallint")
    return F.when(n.isNull() | n.between(0, 255), n).otherwise(F.raise_error(F.lit("value does not fit a byte")).cast("smallint"))


@scalar
def to_guid(s):
    """Canonical text: lower case, hyphens, no braces."""
    digits = F.lower(F.regexp_replace(_c(s), r"[{}()\-]", ""))
    return F.regexp_replace(digits, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")


# Text

@scalar
def last_pos(part, s):
    return last_index_of(s, part)


@scalar
def last_index_of_start(s, part, start):
    """The last match that ends at or before the character `start`."""
    return F.when(_c(start) < 0, F.when(_c(s).isNotNull(), -1)).otherwise(last_index_of(substring(s, 0, _c(start) + 1), part))


@scalar
def index_of_range(s, part, start, count):
    """The first match within `count` characters from `start`."""
    at = index_of(substring(s, start, count), _c(part))
    return F.when(at < 0, at).otherwise(at + _c(start))


@scalar
def last_index_of_any(s, *parts):
    places = [last_index_of(s, p) for p in parts]
    return F.greatest(*places) if len(places) > 1 else places[0]


@scalar
def concat_list(xs, delimiter=""):
    """A nil element makes the whole nil."""
    return F.when(~F.exists(_c(xs), lambda x: x.isNull()), F.array_join(_c(xs), delimiter))


@scalar
def unicode(s):
    """The code points."""
    return F.when(F.length(_c(s)) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(_c(s), ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int")))


@scalar
def from_unicode(points):
    return F.array_join(F.transform(_c(points), lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")), "")


@scalar
def utf8(s):
    return F.encode(_c(s), "UTF-8")


@scalar
def from_utf8(b):
    return F.decode(_c(b), "UTF-8")


@scalar
def matches(s, pattern):
    return F.rlike(_c(s), _c(pattern))


#: Characters with a meaning in HTML, and their references.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


@scalar
def html_encode(s):
    s = _c(s)
    for sign, name in HTML:
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s


@scalar
def html_decode(s):
    s = _c(s)
    for sign, name in reversed(HTML):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return s


@scalar
def from_base64(s):
    return F.unbase64(_c(s))


@scalar
def binary_length(b):
    return F.octet_length(_c(b))


# Generators

@scalar
def new_guid():
    return F.uuid()


@scalar
def random(seed: int | None = None):
    return F.rand(seed).cast(DECIMAL)


@scalar
def random_below(n, seed: int | None = None):
    """0 to n - 1."""
    return F.floor(F.rand(seed) * _c(n)).cast("int")


@scalar
def random_between(low, high, seed: int | None = None):
    """Both ends included."""
    return (F.floor(F.rand(seed) * (_c(high) - _c(low) + 1)) + _c(low)).cast("int")


# Lists, nil and JSON

@scalar
def list_last_index_of(xs, x):
    at = F.array_position(F.reverse(_c(xs)), _c(x))
    return F.when(at == 0, -1).otherwise(F.size(_c(xs)) - at)


@scalar
def list_set(xs, at, x):
    return F.transform(_c(xs), lambda y, i: F.when(i == _c(at), _c(x)).otherwise(y))


@scalar
def list_remove(xs, x):
    """Without its first x."""
    at = F.array_position(_c(xs), _c(x)) - 1
    return F.filter(_c(xs), lambda _, i: i != at)


@scalar
def list_clear(xs):
    return F.slice(_c(xs), 1, 0)


@scalar
def is_not_nil(x):
    return _c(x).isNotNull()


@scalar
def dynamic_get(s, path: str, kind: str = "string"):
    """A typed value at a path of JSON text; nil where there is none."""
    return F.try_variant_get(F.parse_json(_c(s)), path, kind)


@scalar
def dynamic_type(s):
    return F.schema_of_variant(F.parse_json(_c(s)))
