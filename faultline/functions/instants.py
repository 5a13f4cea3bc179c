"""Time texts of any notation to one UTC instant.

All notations are compiled into ONE alternation with named groups. A single replacement pass turns a
text into its separated components; every later step is integer arithmetic on those components:
calendar check, days since 1970-01-01, microseconds, offset. No format is tried twice and no date
parser is called per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Offsets of zone abbreviations in seconds.
ZONE_ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "bst": 3600, "cet": 3600, "cest": 7200,
    "eet": 7200, "eest": 10800, "msk": 10800, "ist": 19800, "est": -18000, "edt": -14400,
    "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200,
}
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
WEEKDAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
_ABBR = "|".join(sorted((z.upper() for z in ZONE_ABBREVIATIONS), key=lambda z: (-len(z), z)))
_MON = rf"(?:{MONTHS})[a-z]{{0,6}}"
_FRAC = r"(?:[.,](?<@f>\d{1,9}))?"
_ZONE = rf"(?:\s?(?<@z>[+-]\d{{2}}(?::?\d{{2}})?(?![\d:])|(?:{_ABBR}|z)(?![A-Za-z0-9])))?"
_CLOCK = r"(?<@h>\d{1,2}):(?<@i>\d{2}):(?<@s>\d{2})"

# Each notation: named groups y o d h i s f z, where @ stands for a letter of its own.
_NOTATIONS = [
    ("a", r"(?<@y>\d{4})(?<asep>[-/])(?<@o>\d{2})\k<asep>(?<@d>\d{2})[T ]" + _CLOCK + _FRAC + _ZONE),
    ("b", rf"(?<@d>\d{{1,2}})/(?<@o>{_MON})/(?<@y>\d{{4}}):" + _CLOCK + _FRAC + _ZONE),
    ("c", rf"(?:(?:{WEEKDAYS})[a-z]{{0,6}},? )?(?<@d>\d{{1,2}}) (?<@o>{_MON}) (?<@y>\d{{4}}) " + _CLOCK + _FRAC + _ZONE),
    ("e", rf"(?<@o>{_MON}) +(?<@d>\d{{1,2}}), (?<@y>\d{{4}}),? " + _CLOCK + _FRAC + r"(?: (?<@m>[AaPp][Mm]))?" + _ZONE),
    ("k", r"(?<@d>\d{2})\.(?<@o>\d{2})\.(?<@y>\d{4}),? " + _CLOCK + _FRAC + _ZONE),
    ("n", rf"(?<@o>{_MON}) +(?<@d>\d{{1,2}}) " + _CLOCK + _FRAC + _ZONE),
]
_EPOCH = r"(?<u>\d{10})(?<v>\d{3}|\d{6}|\d{9})?(?:\.(?<w>\d{1,9}))?(?!\d)"


def _without_names(pattern: str) -> str:
    import re

    pattern = pattern.replace(r"(?<asep>[-/])", "[-/]").replace(r"\k<asep>", "[-/]")
    return re.sub(r"\(\?<[A-Za-z]\w*>", "(?:", pattern)


_NAMED = [(p, body.replace("@", p)) for p, body in _NOTATIONS]
#: One alternation over every notation, with named groups, for a whole text.
ALTERNATION = "(?:" + "|".join(body for _, body in _NAMED) + "|" + _EPOCH + ")"
#: The same notations without groups, by letter, to be embedded in log header patterns.
PLAIN = {p: _without_names(body) for p, body in _NAMED} | {"epoch": _without_names(_EPOCH)}

_SEP = "\u0001"


def _merged(field: str) -> str:
    return "".join(f"${{{p}{field}}}" for p, body in _NAMED if f"(?<{p}{field}>" in body)


_TEMPLATE = "\u0002" + _SEP.join([*(_merged(f) for f in "yodhisfzm"), "${u}", "${v}", "${w}"])

_DAYS = """(({y} - if({o} <= 2, 1, 0)) div 400) * 146097
  + (pmod({y} - if({o} <= 2, 1, 0), 400) * 365 + pmod({y} - if({o} <= 2, 1, 0), 400) div 4
     - pmod({y} - if({o} <= 2, 1, 0), 400) div 100
     + (153 * ({o} + if({o} > 2, -3, 9)) + 2) div 5 + {d} - 1) - 719468"""


def civil_days(y: str, o: str, d: str) -> str:
    """SQL text: days from 1970-01-01 to a date of the proleptic calendar, in integers."""
    return _DAYS.format(y=f"({y})", o=o, d=d)


def _month_length(y: str, o: str) -> str:
    leap = f"(({y}) % 4 = 0 and (({y}) % 100 <> 0 or ({y}) % 400 = 0))"
    return f"case when {o} = 2 then if({leap}, 29, 28) when {o} in (4, 6, 9, 11) then 30 else 31 end"


def with_time_parts(df: DataFrame, text: str, out: str = "t", odd_zone_is_local: bool = False) -> DataFrame:
    """Add columns read from the text column `text`:

    {out}_us     microseconds of the instant, where the text has a zone or is an epoch number
    {out}_local  microseconds of the wall-clock reading, where the text has no zone (or, with `odd_zone_is_local`, an impossible offset)
    {out}_o, {out}_d, {out}_tod, {out}_off   month, day, microseconds of the day and written offset in seconds
                 (null if none), where the year is missing

    Null text, blank text, other text, impossible dates and offsets and years before 2 give nulls throughout. Each step is
    a projection of its own, so that no value is worked out twice."""
    keep = df.columns
    a = f"__{out}_a"
    c = {f: f"__{out}_{f}" for f in "yodhisfzmec"}
    num = lambda i: f"try_cast(nullif({a}[{i}], '') as int)"
    months = MONTHS.replace("|", "").lower()
    zone_map = "map(" + ",".join(f"'{k}',{v}" for k, v in ZONE_ABBREVIATIONS.items()) + ")"
    df = df.withColumn(a, F.split(F.regexp_replace(F.trim(F.col(text)), r"\A\s*" + ALTERNATION + r"\s*\z", _TEMPLATE), _SEP))
    df = df.withColumn(a, F.when(F.col(a)[0].startswith("\u0002"), F.col(a)))
    df = df.select(*keep, *[F.expr(x).alias(n) for n, x in {
        c["y"]: f"try_cast(nullif(substr({a}[0], 2), '') as int)",
        c["o"]: f"coalesce({num(1)}, (instr('{months}', lower(substr({a}[1], 1, 3))) + 2) div 3)",
        c["d"]: num(2),
        c["h"]: f"case when {a}[8] = '' then {num(3)} when {num(3)} not between 1 and 12 then 99 "
                f"else {num(3)} % 12 + if(lower({a}[8]) = 'pm', 12, 0) end",
        c["i"]: num(4), c["s"]: num(5), c["f"]: f"cast(rpad(substr({a}[6], 1, 6), 6, '0') as bigint)",
        c["z"]: f"{a}[7]",
        c["m"]: f"""case when coalesce({a}[7], '') = '' then null
               when {a}[7] rlike '^[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?$' then if(startswith({a}[7], '-'), -1, 1) * (try_cast(substr({a}[7], 2, 2) as int) * 3600
                   + coalesce(try_cast(nullif(substr(replace({a}[7], ':', ''), 4, 2), '') as int), 0) * 60)
               else try_element_at({zone_map}, lower({a}[7])) end""",
        c["e"]: f"""if(coalesce({a}[9], '') = '', null, try_cast(rpad(substr(concat({a}[9], {a}[10],
               if({a}[10] = '', {a}[11], '')), 1, 16), 16, '0') as bigint))""",
    }.items()])
    y, o, d = c["y"], c["o"], c["d"]
    fits = (f"{o} between 1 and 12 and {c['h']} between 0 and 23 and {c['i']} between 0 and 59 and {c['s']} between 0 and 59 "
            f"and {d} between 1 and {_month_length(f'coalesce({y}, 2000)', o)}")
    tod = f"(({c['h']} * 60 + {c['i']}) * 60 + {c['s']}) * 1000000L + {c['f']}"
    df = df.withColumn(c["c"], F.expr(f"case when {c['e']} is null and coalesce({y}, 2) > 1 and {fits} then {tod} end"))
    wall = f"__{out}_wall"
    df = df.withColumn(wall, F.expr(f"case when {y} is not null then "
                                    f"cast({civil_days(y, o, d)} as bigint) * 86400000000L + {c['c']} end"))
    none = f"{c['c']} is not null and {y} is null"
    return df.select(*keep, *[F.expr(x).alias(f"{out}_{n}") for n, x in {
        "us": f"coalesce({c['e']}, {wall} - {c['m']} * 1000000L)",
        "local": f"if({c['z']} = ''{f' or {c['m']} is null' if odd_zone_is_local else ''}, {wall}, null)",
        "o": f"if({none}, {o}, null)", "d": f"if({none}, {d}, null)", "tod": f"if({none}, {c['c']}, null)", "off": c["m"],
    }.items()])


def _utc(local: str, zone: str) -> str:
    """SQL text: earlier instant of a wall-clock reading in a zone."""
    return f"unix_micros(to_utc_timestamp(timestamp_micros({local}), {zone}))"


def known_zone(name: Column) -> Column:
    """The name of a zone, an offset such as +03:00, or UTC in place of null and of any name that is no zone. For dimension tables: names are looked up in
    the list of the running JVM."""
    jvm = SparkSession.active()._jvm
    zones = jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds())
    good = F.array_contains(F.split(F.lit(zones), ","), name) | name.rlike(r"^[+-](?:0\d|1[0-7]):[0-5]\d$")
    return F.when(good, name).otherwise("UTC")


def with_instant(df: DataFrame, text: str, zone: str, not_after: str | None = None, out: str = "us", odd_zone_is_local: bool = False) -> DataFrame:
    """Add `{out}`, the microseconds of the instant written in column `text`, and `{out}_shift`, the microseconds
    by which the later instant follows where a local time occurs twice (else 0), and `{out}_known`, whether the text has a zone.

    Texts with a zone or an epoch number are taken as written. Others are read in the zone named by column `zone`
    (null: UTC; any other name must be one of known_zone()), the earlier instant of two. Texts without a year take the latest year in which
    the date exists and the instant is not after column `not_after` (microseconds); without that column they are null."""
    keep = df.columns
    df = with_time_parts(df, text, "__p", odd_zone_is_local)
    df = df.withColumn("__zone", F.expr(f"coalesce({zone}, 'UTC')"))
    parts = ["__p_us", f"if(__p_local is null, null, {_utc('__p_local', '__zone')})"]
    if not_after:
        leap = lambda y: f"if(__p_o = 2 and __p_d = 29, {y} - {y} % 4 - if({y} % 4 = {y} % 100 and {y} % 400 > 3, 4, 0), {y})"
        df = df.withColumn("__y0", F.expr(f"if(__p_o is null, null, year(timestamp_micros({not_after})) + 1)"))
        for k in range(3):
            df = df.withColumn(f"__y{k + 1}", F.expr(leap(f"__y{k}" if not k else f"(__y{k} - 1)")))
            df = df.withColumn(f"__w{k + 1}", F.expr(
                f"cast({civil_days(f'__y{k + 1}', '__p_o', '__p_d')} as bigint) * 86400000000L + __p_tod"))
            df = df.withColumn(f"__c{k + 1}", F.expr(
                f"if(__w{k + 1} is null, null, if(__p_off is not null, __w{k + 1} - __p_off * 1000000L, {_utc(f'__w{k + 1}', '__zone')}))"))
            parts.append(f"if(__c{k + 1} <= {not_after}, __c{k + 1}, null)")
    df = df.withColumn(out, F.expr(f"coalesce({', '.join(parts)})"))
    wall = lambda x: f"unix_micros(from_utc_timestamp(timestamp_micros({x}), __zone))"
    tests = " ".join(f"when {wall(f'{out} + {s}000000L')} = {wall(out)} then {s}000000L" for s in (3600, 1800, 7200))
    df = df.withColumn(f"{out}_shift", F.expr(
        f"case when {out} is null or __p_us is not null or __p_off is not null or __zone = 'UTC' then 0L {tests} else 0L end"))
    return df.withColumn(f"{out}_known", F.expr(f"{out} is not null and (__p_us is not null or __p_off is not null)")).select(
        *keep, out, f"{out}_shift", f"{out}_known")
