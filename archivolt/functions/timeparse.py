"""Every valid reading of a free-text time, as plain Python on one value.

A reading is ``(fmt, kind, local fields, zone)``. Nothing here looks at other
rows; :mod:`archivolt.operators.timestamps` chooses between readings and turns
local times into instants.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

# Month names (English, French), zone abbreviations in minutes.
MONTHS = {
    "JANUARY": 1, "FEBRUARY": 2, "MARCH": 3, "APRIL": 4, "MAY": 5, "JUNE": 6, "JULY": 7, "AUGUST": 8,
    "SEPTEMBER": 9, "OCTOBER": 10, "NOVEMBER": 11, "DECEMBER": 12, "SEPT": 9,
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    "JANVIER": 1, "FÉVRIER": 2, "FEVRIER": 2, "MARS": 3, "AVRIL": 4, "MAI": 5, "JUIN": 6, "JUILLET": 7,
    "AOÛT": 8, "AOUT": 8, "SEPTEMBRE": 9, "OCTOBRE": 10, "NOVEMBRE": 11, "DÉCEMBRE": 12, "DECEMBRE": 12,
    "JANUAR": 1, "FEBRUAR": 2, "MÄRZ": 3, "JUNI": 6, "JULI": 7, "OKTOBER": 10, "DEZEMBER": 12,
    "ENERO": 1, "FEBRERO": 2, "MARZO": 3, "ABRIL": 4, "MAYO": 5, "JUNIO": 6, "JULIO": 7, "AGOSTO": 8,
    "SEPTIEMBRE": 9, "OCTUBRE": 10, "NOVIEMBRE": 11, "DICIEMBRE": 12,
}
ZONES = {
    "UTC": 0, "GMT": 0, "BST": 60, "CET": 60, "CEST": 120, "JST": 540,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Military letters: A-I east 1-9, K-M east 10-12, N-Y west 1-12, Z zero; J is local and has no offset.
MILITARY = {c: (i + 1) * 60 for i, c in enumerate("ABCDEFGHIKLM")} | {c: -(i + 1) * 60 for i, c in enumerate("NOPQRSTUVWXY")} | {"Z": 0}

MON = r"(?P<mon>[A-ZÀ-Ý]{3,12})"
D, M, Y4, Y = r"(?P<d>\d{1,2})", r"(?P<m>\d{1,2})", r"(?P<y>\d{4})", r"(?P<y>\d{4}|\d{2})"
WEEKDAY = r"(?:(?:MON|TUE|TUES|WED|THU|THUR|THURS|FRI|SAT|SUN)(?:DAY|SDAY|NESDAY|RSDAY|URDAY)?\.?,? )?"

#: (format name, precision, pattern of the date part); a day pattern may be followed by a time.
DATES = [
    ("ymd-", "day", rf"{Y4}-{M}-{D}"),
    ("ymd/", "day", rf"{Y4}/{M}/{D}"),
    ("ymd8", "day", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})"),
    ("mdy/", "day", rf"{M}/{D}/{Y}"),
    ("dmy/", "day", rf"{D}/{M}/{Y}"),
    ("dmy.", "day", rf"{D}\.{M}\.{Y}"),
    ("mdy.", "day", rf"{M}\.{D}\.{Y}"),
    ("dmy-", "day", rf"{D}-{M}-{Y}"),
    ("mdy-", "day", rf"{M}-{D}-{Y}"),
    ("d-mon-y", "day", rf"{D}-{MON}\.?-{Y}"),
    ("d mon y", "day", rf"{WEEKDAY}(?P<d>\d{{1,2}})(?:ER|ST|ND|RD|TH)?\.? (?:DE )?{MON}\.?,? (?:DE )?{Y}"),
    ("mon d, y", "day", rf"{WEEKDAY}{MON}\.? (?P<d>\d{{1,2}})(?:ST|ND|RD|TH)?,? {Y4}"),
    ("ym-", "month", rf"{Y4}-{M}"),
    ("ym/", "month", rf"{Y4}/{M}"),
    ("my/", "month", rf"{M}/{Y4}"),
    ("mon y", "month", rf"{MON}\.?,? {Y4}"),
    ("y", "year", rf"(?:YEAR )?{Y4}\.?"),
    ("--y", "year", rf"(?:--|\?\?|00|XX)/(?:--|\?\?|00|XX)/{Y}"),
]
TIME = r"(?:T| |, )(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?P<f>[.,]\d+)?)?(?: ?(?P<ap>[AP])\.?M\.?(?![A-Z]))?"
TIME_BARE = r"(?:T| )(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?: ?(?P<ap>[AP])\.?M\.?(?![A-Z]))?"
ZONE = r"(?: ?[\[(]?(?P<z>Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,4}|[A-Z]+(?:/[A-Z_+\-0-9]+){1,2})[\])]?)?"
DTG = re.compile(rf"(?P<d>\d{{2}})(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<z>[A-Z]) ?{MON} ?{Y}")
EPOCH = re.compile(r"\d{9,10}|\d{12,13}")
FULL = [(name, prec, re.compile(f"{pat}(?:{TIME}{ZONE}|{TIME_BARE.replace('?P<', '?P<b')}{ZONE.replace('?P<z>', '?P<bz>')})?" if prec == "day" else pat)) for name, prec, pat in DATES]

#: What separates the two ends of a span.
SPAN = re.compile(r" TO | ?[–—] ?| / | - | UNTIL | THRU ")
SPAN_TIGHT = re.compile(r"(\d{1,2}/\d{1,2}/\d{2,4})-(\d{1,2}/\d{1,2}/\d{2,4})")

#: The project's conventions: slashed is month first, dotted is day first. There is none for dashed dates.
CONVENTIONS = frozenset({"mdy/", "dmy."})
AGAINST = frozenset({"dmy/", "mdy."})
OPEN = frozenset({"mdy/", "dmy/", "dmy.", "mdy.", "dmy-", "mdy-"})
AMBIGUOUS = OPEN


@dataclass(frozen=True)
class Reading:
    fmt: str
    kind: str  # 'instant' (offset known), 'local' (zone wanted), 'zone' (IANA zone named), 'day', 'month', 'year'
    when: datetime
    zone: str | None = None
    off: int | None = None
    odd: int = 0  # conventions that this reading goes against


def squeeze(v: str) -> str:
    """Upper case, all white space (no-break too) to single spaces."""
    return " ".join(v.replace(" ", " ").replace(" ", " ").split()).upper()


def full_year(y: str, pivot: int = 26) -> int:
    n = int(y)
    return n if len(y) == 4 else 2000 + n if n <= pivot else 1900 + n


@lru_cache(1)
def zone_names() -> dict[str, str]:
    return {z.upper(): z for z in available_timezones()}


def shifted_year(y: str, pivot: int, shift: int) -> int | None:
    """The year moved by ``shift``, into 1900-2099; None where it is written in full or leaves that range."""
    n = full_year(y, pivot)
    if not shift:
        return n
    return n + shift if len(y) == 2 and 1900 <= n + shift <= 2099 else None


def _day(fmt: str, g: dict, pivot: int, shift: int = 0) -> datetime | None:
    mon = g.get("mon")
    month = MONTHS.get(mon) if mon else int(g["m"])
    year = shifted_year(g["y"], pivot, shift)
    if not month or year is None:
        return None
    try:
        return datetime(year, month, int(g.get("d") or 1))
    except ValueError:
        return None


def _with_time(base: datetime, H: str, M: str, S: str | None, ap: str | None) -> datetime | None:
    h = int(H)
    if ap:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ap == "P" else 0)
    try:
        return base.replace(hour=h, minute=int(M), second=int(S or 0))
    except ValueError:
        return None


def _zoned(fmt: str, when: datetime, z: str | None) -> Reading | None:
    if z is None:
        return Reading(fmt, "local", when)
    if z[0] in "+-":
        n = z[1:].replace(":", "")
        off = (int(n[:2]) * 60 + int(n[2:] or 0)) * (-1 if z[0] == "-" else 1)
        return Reading(fmt, "instant", when, off=off) if abs(off) <= 900 and int(n[2:] or 0) < 60 else None
    if z in ZONES or z == "Z":
        return Reading(fmt, "instant", when, off=ZONES.get(z, 0))
    if z in zone_names():
        return Reading(fmt, "zone", when, zone=zone_names()[z])
    return None


def every_reading(value: str | None, pivot: int = 26) -> list[Reading]:
    """All valid readings whatever the conventions: every order of day and month, both centuries of a two-digit year.

    ``odd`` counts the conventions (:data:`CONVENTIONS`, the pivot) that a reading goes against.
    """
    out: list[Reading] = []
    plain = readings(value, OPEN, pivot)
    # Where the year of a reading stands in the text, it is written in full.
    short = any(str(r.when.year) not in value for r in plain)
    for shift in (0, 100, -100) if short else (0,):
        for r in readings(value, OPEN, pivot, shift) if shift else plain:
            name = r.fmt.removeprefix("span ").removesuffix("h:m").removesuffix("hm")
            out.append(replace(r, odd=(name in AGAINST) + (shift != 0)))
    return out


def readings(value: str | None, allowed: frozenset = CONVENTIONS, pivot: int = 26, shift: int = 0) -> list[Reading]:
    """All valid readings of ``value``, in a fixed order; none if it names no real time.

    ``allowed`` says which of the orders that a separator leaves open may be
    read (:data:`OPEN` allows all of them). A span counts by its first end and
    is read only if both ends can be. With ``shift`` only two-digit years are
    read, so many years off.
    """
    if value is None:
        return []
    s = squeeze(value).rstrip(";,")
    if not any(c.isdigit() for c in s):
        return []
    m = SPAN_TIGHT.fullmatch(s)
    ends = list(m.groups()) if m else SPAN.split(s)
    if len(ends) == 2 and all(any(c.isdigit() for c in e) for e in ends) and not s.startswith("--"):
        first = _one(ends[0], allowed, pivot, shift)
        if first and _one(ends[1], allowed, pivot, shift):
            return [Reading(f"span {r.fmt}", r.kind, r.when, r.zone, r.off) for r in first]
        return []
    return _one(s, allowed, pivot, shift)


def _one(s: str, allowed: frozenset, pivot: int, shift: int = 0) -> list[Reading]:
    out: list[Reading] = []
    if shift and not re.search(r"(?<!\d)\d{2}(?!\d)", s):
        return out
    if EPOCH.fullmatch(s) and not shift:
        secs = int(s) / (1000 if len(s) >= 12 else 1)
        when = datetime(1970, 1, 1) + timedelta(seconds=int(secs))
        out.append(Reading("epoch", "instant", when, off=0))
        return out
    if m := DTG.fullmatch(s):
        g = m.groupdict()
        base = _day("dtg", g, pivot, shift)
        when = base and _with_time(base, g["H"], g["M"], None, None)
        if when and g["z"] == "J":
            out.append(Reading("dtg", "local", when))
        elif when:
            out.append(Reading("dtg", "instant", when, off=MILITARY[g["z"]]))
        return out
    for name, prec, pat in FULL:
        if name in AMBIGUOUS and name not in allowed:
            continue
        m = pat.fullmatch(s)
        if not m:
            continue
        g = m.groupdict()
        if prec == "year":
            y = shifted_year(g["y"], pivot, shift)
            if y and 1 <= y <= 9999:
                out.append(Reading(name, "year", datetime(y, 1, 1)))
            continue
        base = _day(name, g, pivot, shift)
        if base is None:
            continue
        if prec == "month":
            out.append(Reading(name, "month", base))
            continue
        b = "b" if g.get("bH") else ""
        if not g.get(b + "H"):
            out.append(Reading(name, "day", base))
            continue
        when = _with_time(base, g[b + "H"], g[b + "M"], g[b + "S"], g[b + "ap"])
        r = when and _zoned(name + ("hm" if b else "h:m"), when, g[b + "z"])
        if r:
            out.append(r)
    return out


def instants(when: datetime, zone: str) -> list[datetime]:
    """UTC instants at which clocks in ``zone`` show ``when``: none in a gap, two in an overlap."""
    tz = ZoneInfo(zone)
    found = []
    for fold in (0, 1):
        u = when.replace(tzinfo=tz, fold=fold).astimezone(timezone.utc)
        if u.astimezone(tz).replace(tzinfo=None) == when and u not in found:
            found.append(u)
    return [u.replace(tzinfo=None) for u in found]


def normals(r: Reading, local_zone: str | None) -> list[tuple[str, float]]:
    """Normal forms of a reading with their times in epoch seconds: none, one, or two where clocks were put back."""
    stamp = "%Y-%m-%dT%H:%M:%SZ"
    if r.kind in ("day", "month", "year"):
        at, stamp = [r.when], {"day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}[r.kind]
    elif r.kind == "instant":
        try:
            at = [r.when - timedelta(minutes=r.off or 0)]
        except OverflowError:
            return []
    else:
        zone = r.zone or local_zone
        at = instants(r.when, zone) if zone else []
    return [(t.strftime(stamp), (t - datetime(1970, 1, 1)).total_seconds()) for t in at if t.year >= 1000]
