"""Time parsing, formatting and ordinals (DAT-*, SRC-09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The named output formats.
FORMATS = {
    "date_slash": "yyyy/MM/dd",
    "date_dash": "yyyy-MM-dd",
    "date_nod": "yyyyMMdd",
    "ts_slash_microsec": "yyyy/MM/dd HH:mm:ss.SSS'000'",
    "ts_slash_millisec": "yyyy/MM/dd HH:mm:ss.SSS",
    "ts_slash_sec": "yyyy/MM/dd HH:mm:ss",
    "ts_dash_microsec": "yyyy-MM-dd HH:mm:ss.SSS'000'",
    "ts_dash_millisec": "yyyy-MM-dd HH:mm:ss.SSS",
    "ts_dash_sec": "yyyy-MM-dd HH:mm:ss",
    "ts_nod_microsec": "yyyyMMddHHmmssSSS'000'",
    "ts_nod_millisec": "yyyyMMddHHmmssSSS",
    "ts_nod_sec": "yyyyMMddHHmmss",
    "time_microsec": "HH:mm:ss.SSS'000'",
    "time_millisec": "HH:mm:ss.SSS",
    "time_sec": "HH:mm:ss",
    "time_nod_microsec": "HHmmssSSS'000'",
    "time_nod_millisec": "HHmmssSSS",
    "time_nod_sec": "HHmmss",
}

_CANONICAL = "yyyy-MM-dd[ HH[:mm[:ss[.SSS]]]]"

_DIGITS = r"^\d{4}-\d\d-\d\d(?: \d\d(?::\d\d(?::\d\d(?:\.\d{3})?)?)?)?\z"
_FULL = "0001-01-01 00:00:00.000"


def _digit(text: Column, at: int) -> Column:
    return F.substring(text, at, 1).between("0", "9")


# any accepted layout to the canonical one; each step is a single pass over the text, made
# where it can change something
_LAYOUT_STEPS = (
    (r"\s*Z$", "", lambda t: t.contains("Z")),
    # undelimited date
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3", lambda t: _digit(t, 5)),
    # one blank before the clock
    (r"^(\d{4}-\d{2}-\d{2})[\sT]*(\d)", "$1 $2",
     lambda t: (F.length(t) > 10) & ~((F.substring(t, 11, 1) == " ") & _digit(t, 12))),
    # undelimited clock
    (r"^(.{10} \d\d)(\d\d)(\d\d)(\d{0,3})$", "$1:$2:$3.$4", lambda t: _digit(t, 14)),
    # colon before the fraction
    (r"^(.{10} \d\d:\d\d:\d\d):(\d+)$", "$1.$2", lambda t: F.substring(t, 20, 1) == ":"),
)
# a fraction cut to three digits, or padded
_FRACTION_STEPS = ((r"(\.\d{3})\d+$", "$1"), (r"\.(\d\d)$", ".0$1"), (r"\.(\d)$", ".00$1"),
                   (r"\.$", ""))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _laid_out(text: Column) -> Column:
    """Text of any accepted layout in the canonical one."""
    def step(pattern: str, replacement: str, needed: Callable[[Column], Column]):
        return lambda t: F.when(needed(t), F.regexp_replace(t, pattern, replacement)).otherwise(t)

    for rule in _LAYOUT_STEPS:
        text = _bound(text, step(*rule))

    def fraction(t: Column) -> Column:
        cut = t
        for pattern, replacement in _FRACTION_STEPS:
            cut = F.regexp_replace(cut, pattern, replacement)
        whole = (F.length(t) == 23) & (F.substring(t, 20, 1) == ".") & \
            _digit(t, 21) & _digit(t, 22) & _digit(t, 23)
        return F.when(t.contains(".") & ~whole, cut).otherwise(t)
    return _bound(text, fraction)


def _parsed(text: Column) -> Column:
    """Canonical text as a timestamp: full digits by a cast, filled up with the beginning of the
    year, day or hour; other text by the pattern, unless it cannot begin a year."""
    filled = F.concat(text, F.substring(F.lit(_FULL), F.length(text) + 1, F.lit(len(_FULL))))
    return F.when(text.rlike(_DIGITS) & ~text.startswith("0000"), filled.try_cast("timestamp")) \
        .when(_digit(text, 1) | F.substring(text, 1, 1).isin("+", "-"),
              F.try_to_timestamp(text, F.lit(_CANONICAL)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(col: Column | str, z_offset_hours: int = 0) -> Column:
    """DAT-01: text in any of the accepted layouts to a timestamp, null when none fits.

    Dates with ``-``, ``/`` or no delimiter; time down to hour, minute, second or
    fraction; blank, ``T`` or nothing between date and time; undelimited
    ``yyyyMMddHHmmss[SSS]``.  A fraction is cut to three digits; a shorter one is
    padded with zeros on the left.  The time is taken in the session zone; a
    trailing ``Z`` adds ``z_offset_hours`` (8 reproduces a fixed +8 zone).

    Text that already looks like ``yyyy-MM-dd HH:mm:ss.SSS[SSS]`` skips the layout
    steps.
    """
    def usual(c: Column) -> Column:
        return F.length(c).isin(23, 26) & (F.substring(c, 5, 1) == "-") \
            & (F.substring(c, 11, 1) == " ") & (F.substring(c, 20, 1) == ".") & ~c.endswith("Z")

    c = _col(col)
    text = _bound(c, lambda c: F.when(usual(c), F.substring(c, 1, 23)).otherwise(
        _laid_out(F.translate(F.trim(c), "/", "-"))))
    parsed = _bound(text, _parsed)
    if z_offset_hours:
        shift = F.when(F.trim(c).endswith("Z"), F.lit(z_offset_hours)).otherwise(F.lit(0))
        parsed = parsed + F.make_dt_interval(hours=shift)
    return parsed


def format_ts(col: Column | str, fmt: str) -> Column:
    """DAT-02: text in one of the named formats, or in any pattern."""
    return F.date_format(_col(col), FORMATS.get(fmt, fmt))


def to_epoch_ms(col: Column | str) -> Column:
    """DAT-03: timestamp to epoch milliseconds."""
    return F.unix_millis(_col(col).cast("timestamp"))


def from_epoch_us(col: Column | str) -> Column:
    """DAT-03: epoch microseconds to timestamp, at millisecond precision."""
    return F.timestamp_millis(F.floor(_col(col).cast("long") / F.lit(1000)).cast("long"))


def normalize_ts(col: Column | str) -> Column:
    """SRC-09: event time given as text or as an epoch number of any unit.

    A value that starts with ``20`` is text; anything else is filled with zeros on
    the right to sixteen digits and read as epoch microseconds.
    """
    text = _col(col).cast("string")
    digits = F.rpad(text, 16, "0").try_cast("long")
    return F.when(F.substring(text, 1, 2) == "20", parse_ts(text)) \
        .when(F.length(text) >= 10, from_epoch_us(digits))


def day_id(col: Column | str) -> Column:
    """DAT-04: whole days since 1970-01-01, one lower before it."""
    ts = _col(col)
    days = F.datediff(ts, F.lit("1970-01-01").cast("date"))
    return _ordinal(days, ts, 1, "1970-01-01")


def week_id(col: Column | str) -> Column:
    """DAT-04: whole weeks since Monday 1969-12-29, one lower before it."""
    ts = _col(col)
    return _ordinal(F.datediff(ts, F.lit("1969-12-29").cast("date")), ts, 7, "1969-12-29")


def _ordinal(days: Column, ts: Column, size: int, origin: str) -> Column:
    # A count of whole units truncates towards zero, and times before the origin get
    # one less.  ``days`` is already the floor for a time of day, so before the origin
    # the truncated count is days+1 unless the time is midnight.
    start = F.to_timestamp(F.lit(origin))
    midnight = ts.cast("timestamp") == F.date_trunc("day", ts)
    whole = F.when(ts >= start, days).when(midnight, days).otherwise(days + 1)
    units = F.when(whole >= 0, F.floor(whole / size)).otherwise(F.ceil(whole / size)) \
        if size > 1 else whole
    return F.when(ts < start, units - 1).otherwise(units).cast("int")


def month_id(col: Column | str) -> Column:
    """DAT-04: whole months since 1970-01, one lower before it."""
    ts = _col(col)
    start = F.to_timestamp(F.lit("1970-01-01"))
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    first = ts == F.date_trunc("month", ts)
    return F.when(ts >= start, months).when(first, months - 1).otherwise(months).cast("int")


def is_valid_ts(col: Column | str, fmt: str) -> Column:
    """DAT-06: does the text parse in the given format?"""
    parsed = F.try_to_timestamp(_col(col), F.lit(FORMATS.get(fmt, fmt)))
    return F.coalesce(parsed.isNotNull(), F.lit(False))


def dated_name(base: str, fmt: str = "date_nod", on: Column | None = None) -> Column:
    """DAT-05: a name with the current date (or ``on``) appended."""
    day = F.current_date() if on is None else on
    return F.concat(F.lit(base), F.date_format(day, FORMATS.get(fmt, fmt)))


def ts_not_before(first: Column | str, second: Column | str) -> Column:
    """CDC-11: compare two time texts at the precision of the shorter one.

    ``>=`` when the first is as long or longer, strict ``>`` when it is shorter; an
    empty second text is never after anything.
    """
    a, b = _col(first), _col(second)
    a_cut = F.when(F.length(a) > F.length(b), F.substring(a, F.lit(1), F.length(b))).otherwise(a)
    b_cut = F.when(F.length(b) > F.length(a), F.substring(b, F.lit(1), F.length(a))).otherwise(b)
    return F.when(b == "", F.lit(True)) \
        .when(F.length(a) < F.length(b), a_cut > b_cut) \
        .otherwise(a_cut >= b_cut)
