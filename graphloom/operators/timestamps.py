"""Normalising date texts to instants: shape masks, one parser per mask, zone transition tables.

A text is tokenised into character classes (digits become 9, every run of letters one a). A mask
is matched against the layouts below once per process; all texts of that mask are then converted
together with numpy. Wall-clock times pass through transition tables of one version of the time
zone database, read by the driver and broadcast, so that all executors use the same rules.
"""

from __future__ import annotations

import calendar
import functools
import re
import struct
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND, DAY = 1_000_000, 86_400_000_000

# Zone abbreviations of mail headers, as minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
WEEKDAY_NAMES = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_MONTH = {**{m: i + 1 for i, m in enumerate(MONTHS)}, **{m: i + 1 for i, m in enumerate(MONTH_NAMES)}, "sept": 9}
_WEEKDAY = {**{w: i for i, w in enumerate(WEEKDAYS)}, **{w: i for i, w in enumerate(WEEKDAY_NAMES)}}

# A piece: its pattern in texts, its pattern in masks.
_PIECES = {
    "y4": (r"(?P<year>\d{4})", "9{4}"),
    "mo": (r"(?P<month>\d{2})", "9{2}"),
    "d2": (r"(?P<day>\d{2})", "9{2}"),
    "d": (r"(?P<day>\d{1,2})", "9{1,2}"),
    "s1": (r"(?P<first>\d{1,2})", "9{1,2}"),
    "s2": (r"(?P<second>\d{1,2})", "9{1,2}"),
    "s3": (r"(?P<third>\d{4}|\d{2})", "(?:9{4}|9{2})"),
    "mon": (r"(?P<mon>[A-Za-z]+)\.?", r"a\.?"),
    "wd": (r"(?:(?P<wd>[A-Za-z]+),? +)?", "(?:a,? +)?"),
    "time": (
        r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<sec>\d{2})(?:[.,](?P<frac>\d{1,9}))?)?(?: ?(?P<half>[AaPp][Mm])(?![A-Za-z]))?",
        r"9{1,2}:9{2}(?::9{2}(?:[.,]9{1,9})?)?(?: ?a)?",
    ),
    "time24": (
        r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<sec>\d{2})(?:[.,](?P<frac>\d{1,9}))?)?",
        r"9{1,2}:9{2}(?::9{2}(?:[.,]9{1,9})?)?",
    ),
    "zone": (
        r"(?: ?(?P<off>[+-]\d{2}(?::?\d{2})?)(?: ?\([^()]*\))?| ?(?P<name>[A-Za-z]+(?:[/_+-][A-Za-z0-9]+)*))?",
        r"(?: ?[+-]9{2}(?::?9{2})?(?: ?\([^()]*\))?| ?a(?:[/_+-][a9]+)*)?",
    ),
    "run": (r"(?P<run>\d{9,16})", "9{9,16}"),
    "c8": (r"(?P<c8>\d{8})", "9{8}"),
    "c6": (r"(?P<c6>\d{4}(?:\d{2})?)(?:[.,](?P<frac>\d{1,9}))?", r"(?:9{6}|9{4})(?:[.,]9{1,9})?"),
}
_LAYOUTS = [
    ("{y4}-{mo}-{d2}(?:[Tt]| +){time}{zone}", "{y4}-{mo}-{d2}(?:a| +){time}{zone}"),
    ("{y4}/{mo}/{d2} +{time}{zone}", None),
    (r"{d}\.{mo}\.{y4},? +{time}{zone}", None),
    ("{s1}/{s2}/{s3},? +{time}{zone}", None),
    ("{wd}{d}[ -]{mon}[ -]{y4},? +{time}{zone}", None),
    ("{wd}{mon} +{d},? +{y4},? +(?:at +)?{time}{zone}", "{wd}{mon} +{d},? +{y4},? +(?:a +)?{time}{zone}"),
    ("{wd}{mon} +{d} +{time24}{zone} +{y4}(?: (?P<off2>[+-]\\d{{4}})(?: ?\\([^()]*\\))?)?", "{wd}{mon} +{d} +{time24}{zone} +{y4}(?: [+-]9{{4}}(?: ?\\([^()]*\\))?)?"),
    ("{c8}[Tt]{c6}{zone}", "{c8}a{c6}{zone}"),
    ("{run}", None),
]
_COMPILED = [
    (re.compile(t.format(**{k: v[0] for k, v in _PIECES.items()})), re.compile((m or t).format(**{k: v[1] for k, v in _PIECES.items()})))
    for t, m in _LAYOUTS
]


def shape_mask(text: str) -> str:
    """Digits as 9, runs of letters as one a, everything else as it stands."""
    return re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", text))


@functools.lru_cache(maxsize=10_000)
def parser_of(mask: str) -> re.Pattern | None:
    """The pattern whose groups give the fields of the texts of this mask, or None."""
    for text, of_mask in _COMPILED:
        if of_mask.fullmatch(mask):
            return text
    return None


# ---- zone transition tables


def _database() -> tuple[str, list[str]]:
    """(version, zone folders) of the one database the tables are made from: the ``tzdata`` package where it is
    installed, else the first folder of the system's search path. Files and version come from the same place."""
    import zoneinfo

    try:
        import tzdata

        return "tzdata-" + tzdata.IANA_VERSION, [str(Path(tzdata.__file__).parent / "zoneinfo")]
    except ImportError:
        pass
    for folder in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            try:
                with open(f"{folder}/{name}") as f:
                    return f.readline().strip().removeprefix("# version "), [folder]
            except OSError:
                continue
    raise RuntimeError("no time zone database with a version: install the tzdata package")


def _read_zone(data: bytes) -> tuple[list[int], list[int], str]:
    """(starts, offsets, rule) of a compiled zone file in seconds: offsets[0] holds before all starts, so
    offsets is one longer; rule is the text that gives the years after the last start."""

    def block(at: int, width: int) -> tuple[list[int], list[int], int]:
        utc, std, leap, times, types, chars = struct.unpack(">6l", data[at + 20 : at + 44])
        at += 44
        starts = list(struct.unpack(f">{times}{'q' if width == 8 else 'l'}", data[at : at + times * width]))
        kinds = list(data[at + times * width : at + times * (width + 1)])
        at += times * (width + 1)
        east = [struct.unpack(">l", data[at + 6 * k : at + 6 * k + 4])[0] for k in range(types)]
        return starts, [east[0], *(east[k] for k in kinds)], at + 6 * types + chars + leap * (width + 4) + std + utc

    starts, offsets, end = block(0, 4)
    if data[4:5] < b"2":
        return starts, offsets, ""
    starts, offsets, end = block(end, 8)
    return starts, offsets, data[end:].strip(b"\n").decode("ascii")


_RULE = re.compile(r"(?:<[^<>]+>|[A-Za-z]+)([+-]?[\d:]+)(?:(?:<[^<>]+>|[A-Za-z]+)([+-]?[\d:]+)?,([^,]+),([^,]+))?")


def _seconds(clock: str) -> int:
    sign, parts = -1 if clock.startswith("-") else 1, clock.lstrip("+-").split(":")
    return sign * sum(int(x) * u for x, u in zip(parts, (3600, 60, 1)))


def _rule_day(rule: str, year: int) -> int:
    """Days since 1970 and seconds of the wall clock at which a rule of the kind M10.5.0/3, J60 or 59 applies."""
    day, _, clock = rule.partition("/")
    after = _seconds(clock) if clock else 7200
    first = date(year, 1, 1).toordinal() - 719_163
    if day.startswith("M"):
        month, week, weekday = map(int, day[1:].split("."))
        begin = date(year, month, 1)
        d = begin.toordinal() + (weekday - begin.isoweekday()) % 7 + 7 * (week - 1)
        length = calendar.monthrange(year, month)[1]
        days = d - 719_163 if d - begin.toordinal() < length else d - 719_163 - 7
    elif day.startswith("J"):
        n = int(day[1:])
        days = first + n - 1 + (calendar.isleap(year) and n >= 60)
    else:
        days = first + int(day)
    return days * 86_400 + after


#: The calendar, weekdays included, repeats after 400 years; so do the rules that hold after the last listed change.
CYCLE = 146_097 * DAY


def _extended(starts: list[int], offsets: list[int], rule: str) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(starts, offsets, end) in microseconds: the listed changes, then those of the rule for 400 years and
    a little more; ``end`` is from where on instants are looked up 400 years earlier, None where nothing changes."""
    starts, offsets = list(starts), list(offsets)
    m = _RULE.fullmatch(rule) if rule else None
    end = None
    if m and m[3]:
        base = -_seconds(m[1])
        summer = -_seconds(m[2]) if m[2] else base + 3600
        year = (datetime(1970, 1, 1) + timedelta(seconds=starts[-1])).year if starts else 1970
        for y in range(year, year + 404):
            for at, east in sorted([(_rule_day(m[3], y) - base, summer), (_rule_day(m[4], y) - summer, base)]):
                if (not starts or at > starts[-1]) and east != offsets[-1]:
                    starts.append(at)
                    offsets.append(east)
        end = (date(year + 402, 1, 1).toordinal() - 719_163) * DAY
    elif m and starts and -_seconds(m[1]) != offsets[-1]:
        offsets[-1] = -_seconds(m[1])
    return np.array([-(1 << 62), *(x * SECOND for x in starts)], "int64"), np.array([x * SECOND for x in offsets], "int64"), end


@functools.lru_cache(maxsize=1)
def zone_files() -> tuple[str, dict[str, tuple[list[int], list[int], str]]]:
    """(version, zone -> listed changes and rule) of the database of this machine: read once, on the driver."""
    version, folders = _database()
    zones = {}
    for folder in folders:
        for path in sorted(Path(folder).rglob("*")):
            name = path.relative_to(folder).as_posix()
            if path.is_file() and not name.startswith(("right/", "posix/")):
                data = path.read_bytes()
                if data[:4] == b"TZif":
                    zones[name] = _read_zone(data)
    return version, zones


class ZoneTables:
    """The transition tables of one version of the database. They are read by the driver and sent along (some 600
    zones, about 1 MB), so whatever an executor has installed plays no part; a zone is extended when first met."""

    def __init__(self, version: str, zones: dict[str, tuple[list[int], list[int], str]]):
        self.version, self.zones, self._made = version, zones, {}

    def get(self, zone: str) -> tuple[np.ndarray, np.ndarray, int | None] | None:
        if zone not in self._made and zone in self.zones:
            self._made[zone] = _extended(*self.zones[zone])
        return self._made.get(zone)


def wall_to_instant(wall: np.ndarray, starts: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(instants, settled) of wall-clock microseconds; not settled: shown never or twice."""
    if end is not None:
        ahead = np.maximum(0, -(-(wall - end) // CYCLE)) * CYCLE
        instants, settled = wall_to_instant(wall - ahead, starts, offsets)
        return instants + ahead, settled

    def offset(at: np.ndarray) -> np.ndarray:
        return offsets[np.searchsorted(starts, at, "right") - 1]

    early, late = offset(wall - DAY), offset(wall + DAY)
    a, b = offset(wall - early) == early, (offset(wall - late) == late) & (early != late)
    return wall - np.where(a, early, late), a ^ b


# ---- conversion of the texts of one mask


def _integers(s: pd.Series, missing: int = 0) -> np.ndarray:
    return pd.to_numeric(s, errors="coerce").fillna(missing).to_numpy("int64")


def _wall(year: np.ndarray, month: np.ndarray, day: np.ndarray, hour: np.ndarray, minute: np.ndarray, sec: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (hour >= 0) & (hour < 24) & (minute < 60) & (sec < 60)
    months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype("int64")
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype("int64")
    ok &= day <= after - first
    days = first + day - 1
    return ((days * 24 + hour) * 60 + minute) * 60 * SECOND + sec * SECOND + us, ok, days


def _convert(texts: pd.Series, pattern: re.Pattern, zone: np.ndarray, order: np.ndarray, tables: ZoneTables) -> np.ndarray:
    """Instants of the texts (all of one mask) as floats-free int64 with the lowest value for none."""
    none = np.iinfo("int64").min
    found = texts.str.extract(f"^(?:{pattern.pattern})$")
    n = len(texts)
    get = lambda k: found[k] if k in found else pd.Series([None] * n, index=texts.index, dtype=object)
    ok = found.notna().any(axis=1).to_numpy()
    if "run" in found:
        run, value = get("run").fillna("0"), _integers(get("run"))
        size = run.str.len().to_numpy()
        out = np.full(n, none, "int64")
        for length, unit in ((9, SECOND), (10, SECOND), (13, 1000), (16, 1)):
            out = np.where(ok & (size == length), value * unit, out)
        joined = ok & np.isin(size, (12, 14))
        if not joined.any():
            return out
        run = run.str.pad(14, "right", "0")
        fields = [_integers(run.str.slice(a, b)) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14))]
        wall, fine, _ = _wall(*fields, np.zeros(n, "int64"))
        named = pd.Series([None] * n, index=texts.index, dtype=object)
        return np.where(joined, _place(wall, joined & fine, named, named, zone, tables, none), out)
    if "c8" in found:
        c8, c6 = get("c8").fillna(""), get("c6").fillna("").str.pad(6, "right", "0")
        year, month, day = (_integers(c8.str.slice(a, b)) for a, b in ((0, 4), (4, 6), (6, 8)))
        hour, minute, sec = (_integers(c6.str.slice(a, b)) for a, b in ((0, 2), (2, 4), (4, 6)))
    else:
        hour, minute, sec = _integers(get("hour")), _integers(get("minute")), _integers(get("sec"))
        if "first" in found:
            a, b, c = _integers(get("first")), _integers(get("second")), _integers(get("third"))
            short = get("third").str.len().fillna(0).to_numpy() == 2
            order = np.array([str(x).lower() for x in order], dtype=object)
            year = np.where(order == "ymd", a, c)
            month = np.where(order == "dmy", b, np.where(order == "mdy", a, b))
            day = np.where(order == "dmy", a, np.where(order == "mdy", b, c))
            ok &= np.isin(order, ("dmy", "mdy")) | ((order == "ymd") & short)
            year = np.where(short, year + np.where(year < 70, 2000, 1900), year)
        else:
            year, day = _integers(get("year")), _integers(get("day"))
            month = get("mon").str.lower().map(_MONTH).fillna(0).to_numpy("int64") if "mon" in found else _integers(get("month"))
    half = get("half").str.lower().to_numpy()
    twelve = np.isin(half, ("am", "pm"))
    ok &= ~twelve | ((hour >= 1) & (hour <= 12))
    hour = np.where(twelve, hour % 12 + np.where(half == "pm", 12, 0), hour)
    us = _integers(get("frac").str.pad(9, "right", "0")) // 1000
    wall, fine, days = _wall(year, month, day, hour, minute, sec, us)
    ok &= fine
    if "wd" in found:
        said = get("wd").str.lower().map(_WEEKDAY)
        ok &= get("wd").isna().to_numpy() | (said.fillna(-1).to_numpy("int64") == (days + 3) % 7)
    off = get("off")
    if "off2" in found:
        off = off.where(off.notna(), get("off2"))
    return _place(wall, ok, off, get("name"), zone, tables, none)


def _place(wall: np.ndarray, ok: np.ndarray, off: pd.Series, name: pd.Series, zone: np.ndarray, tables: ZoneTables, none: int) -> np.ndarray:
    """Wall times as instants: by offset, else by abbreviation or named zone, else by the row's zone."""
    out = np.full(len(wall), none, "int64")
    has_off = off.notna().to_numpy()
    if has_off.any():
        digits = off.fillna("+00").str.replace(":", "", regex=False)
        hours, minutes = _integers(digits.str.slice(1, 3)), _integers(digits.str.slice(3, 5))
        east = (hours * 60 + minutes) * 60 * SECOND * np.where(digits.str.startswith("-"), -1, 1)
        out = np.where(has_off & ok & (hours <= 15) & (minutes < 60), wall - east, out)
    has_name = name.notna().to_numpy() & ~has_off
    zones = np.where(has_name, name.fillna("").to_numpy(), zone)
    left = ok & ~has_off
    for z in pd.unique(zones[left]):
        rows = left & (zones == z) if z is not None else np.zeros(len(wall), bool)
        for named in (True, False):
            some = rows & (has_name == named)
            if not some.any():
                continue
            if named and str(z).upper() in ABBREVIATIONS:
                out = np.where(some, wall - ABBREVIATIONS[str(z).upper()] * 60 * SECOND, out)
            elif (t := tables.get(str(z))) is not None:
                instant, settled = wall_to_instant(wall, *t)
                out = np.where(some & settled, instant, out)
    return out


def _column(texts: pd.Series, zone: pd.Series, order: pd.Series, tables: ZoneTables) -> pd.Series:
    none = np.iinfo("int64").min
    out = np.full(len(texts), none, "int64")
    clean = texts.fillna("").str.strip()
    masks = np.array([shape_mask(x) for x in clean], dtype=object)
    zones, orders = zone.to_numpy(dtype=object), order.to_numpy(dtype=object)
    for mask in pd.unique(masks):
        if mask and (pattern := parser_of(mask)) is not None:
            at = np.flatnonzero(masks == mask)
            out[at] = _convert(clean.iloc[at].reset_index(drop=True), pattern, zones[at], orders[at], tables)
    return pd.Series(pd.arrays.IntegerArray(np.where(out == none, 0, out), out == none))


def normalise_dates(df: DataFrame, text: str = "date", zone: str = "zone_name", order: str = "date_order", result: str = "instant_us") -> DataFrame:
    """``df`` with a bigint column: the instant of ``text`` in microseconds since 1970 UTC, or null
    where the text settles none (no text, impossible, no time, a wall time shown never or twice,
    no zone in text and row). ``zone`` is the row's IANA zone, ``order`` its order of slashed dates;
    both may be null. All other columns stay; texts may be of any length.
    """
    shared = df.sparkSession.sparkContext.broadcast(zone_files())

    @F.pandas_udf("bigint")
    def instants(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tables = ZoneTables(*shared.value)
        for t, z, o in batches:
            yield _column(t, z, o, tables)

    return df.withColumn(result, instants(F.col(text), F.col(zone), F.col(order)))


def delivery_instants(mail: DataFrame, sites: DataFrame) -> DataFrame:
    """(delivery_id, instant_us) of every delivery whose date denotes exactly one instant.
    A site missing from ``sites`` leaves only texts with their own zone settled; of a site listed more than
    once the smallest (zone, order) counts."""
    site = sites.groupBy(F.col("site_id").alias("_site")).agg(F.min(F.struct("zone_name", "date_order")).alias("s")).select("_site", "s.*")
    rows = mail.select("delivery_id", "site_id", "date").where(F.col("date").isNotNull())
    rows = rows.join(site, F.col("site_id") == F.col("_site"), "left")
    return normalise_dates(rows).where("instant_us is not null").select(F.col("delivery_id").cast("bigint").alias("delivery_id"), "instant_us")
