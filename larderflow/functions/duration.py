"""ISO-8601 durations as English phrases, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let as _let

_U32 = 4294967295


def _plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))


def _whole(s: Column) -> Column:
    """Unsigned 32-bit numbers as written, an optional plus sign before digits; else null."""
    n = F.when(F.rlike(s, F.lit(r"^\+?0*[0-9]{1,10}$")), s.try_cast("decimal(38,0)").cast("bigint"))
    return _let(n, lambda x: F.when(x <= _U32, x))


def _join(a: Column, b: Column) -> Column:
    """Both with a space between; an empty one has none."""
    return F.concat(a, F.when((a != "") & (b != ""), " ").otherwise(""), b)


def _clock(minutes: Column) -> Column:
    """Minutes as hours and minutes, without what is zero."""
    h, m = F.floor(minutes / 60).cast("bigint"), minutes % 60
    between = F.when((minutes >= 60) & (m > 0), " ").otherwise("")
    return F.concat(F.when(minutes >= 60, _plural(h, "hour")).otherwise(""), between, F.when(m > 0, _plural(m, "minute")).otherwise(""))


def _is_one_unit(v: Column, unit: str) -> Column:
    return F.rlike(v, F.lit(f"^PT[0-9]{{1,9}}{r'([.]0)?' if unit == 'S' else ''}{unit}$"))


def _one_unit(v: Column, unit: str) -> Column:
    return F.substring_index(F.substr(v, F.lit(3), F.length(v) - 3), ".", 1).try_cast("bigint")


def duration_phrase(value: Column | str) -> Column:
    """'PT1H30M' as '1 hour 30 minutes'. Ranges ('PT15-20M') keep their text, minutes from 60 on and seconds are split into hours and minutes;
    what isn't understood stays as it is, without PT. It follows the established behaviour to the letter, oddities too: seconds displace what came before them, hours
    that aren't whole count as 0, minutes from 60 on are added to hours in words. Minutes before hours stay as they are, with PT."""
    v = F.col(value) if isinstance(value, str) else value
    hours, minutes, seconds = (_one_unit(v, u) for u in "HMS")
    seconds = F.round(seconds / 60).cast("bigint")

    def rest(d: Column) -> Column:
        places = F.struct(F.instr(d, "H").alias("h"), F.instr(d, "M").alias("m"), F.instr(d, "S").alias("s"), (F.length(d) - F.length(F.regexp_extract(d, "([^HM]*)$", 1))).alias("last"))
        return _let(places, lambda p: _phrase(d, p))

    # the usual forms, of one unit, without binding anything: these stay in generated code
    return (
        F.when(~F.startswith(v, F.lit("PT")), v)
        .when(_is_one_unit(v, "M"), F.when(minutes == 0, "0 minutes").otherwise(_clock(minutes)))
        .when(_is_one_unit(v, "H"), _plural(hours, "hour"))
        .when(_is_one_unit(v, "S") & (seconds > 0), _clock(seconds))
        .when(F.rlike(v, F.lit("^PT[0-9]+-[0-9]+M$")), F.concat(F.substr(v, F.lit(3), F.length(v) - 3), F.lit(" minutes")))
        .otherwise(_let(F.substring(v, 3, 2**31 - 1), rest))
    )


def _phrase(d: Column, p: Column) -> Column:
    h, m, s, last = p["h"], p["m"], p["s"], p["last"]
    hours = F.when(h > 0, _let(F.coalesce(_whole(F.substring_index(d, "H", 1)), F.lit(0)), lambda n: _plural(n, "hour"))).otherwise("")
    span = F.substr(d, h + 1, F.greatest(m - h - 1, F.lit(0)))
    counted = _let(_whole(span), lambda n: F.when(n.isNull(), "").when(n == 0, "0 minutes").otherwise(_clock(n)))
    minutes = F.when(m == 0, "").when(F.contains(span, F.lit("-")), F.concat(span, F.lit(" minutes"))).otherwise(counted)
    # seconds stand behind the last H or M, and the first S ends them
    raw = F.substr(d, last + 1, F.greatest(s - last - 1, F.lit(0)))
    number = F.when((s > last) & F.rlike(raw, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), raw.try_cast("double"))
    total = F.least(F.greatest(F.round(number / 60), F.lit(0.0)), F.lit(float(_U32))).cast("bigint")
    total = F.when(number.isNotNull(), total)
    out = _let(total, lambda t: F.when(t.isNotNull(), _clock(t)).otherwise(_join(hours, minutes)))
    return F.when((m > 0) & (h > m), F.concat(F.lit("PT"), d)).otherwise(_let(out, lambda o: F.when(o == "", d).otherwise(o)))


def duration_clean(value: Column | str) -> Column:
    """The same with hours, minutes and seconds added up first; fractions of hours and minutes count; ranges and all else as in `duration_phrase`."""
    v = F.col(value) if isinstance(value, str) else value
    form = r"^PT(?:([0-9]+(?:\.[0-9]+)?)H)?(?:([0-9]+(?:\.[0-9]+)?)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?$"
    part = lambda k: F.coalesce(F.regexp_extract(v, form, k).try_cast("double"), F.lit(0.0))
    total = F.round(part(1) * 60 + part(2) + part(3) / 60).cast("bigint")
    known = F.rlike(v, F.lit(form)) & (F.length(v) > 2)
    hours, minutes, seconds = (_one_unit(v, u) for u in "HMS")
    seconds = F.round(seconds / 60).cast("bigint")
    return (
        F.when(~F.startswith(v, F.lit("PT")), v)
        .when(_is_one_unit(v, "M"), F.when(minutes == 0, "0 minutes").otherwise(_clock(minutes)))
        .when(_is_one_unit(v, "H"), F.when(hours == 0, "0 minutes").otherwise(_plural(hours, "hour")))
        .when(_is_one_unit(v, "S"), F.when(seconds == 0, "0 minutes").otherwise(_clock(seconds)))
        .when(known, _let(total, lambda t: F.when(t > 0, _clock(t)).otherwise("0 minutes")))
        .otherwise(duration_phrase(v))
    )
