"""Resolve a noisy place name against a small gazetteer.

The gazetteer is a reference table of fixed size; callers pass it as plain rows
after :func:`archivolt.session.bounded_rows` has checked that size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

# Postal and customary short forms of areas.
AREA_SHORT = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho",
    "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana",
    "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas",
    "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming", "BC": "British Columbia", "AB": "Alberta", "MB": "Manitoba",
    "ON": "Ontario", "QC": "Quebec", "NSW": "New South Wales", "QLD": "Queensland", "VIC": "Victoria",
}
_LEAD = re.compile(r"^(?:\d+(?:\.\d+)? ?(?:mi|miles?|km) (?:[nsew]{1,3}|north|south|east|west) of |nr\.? |near |vicinity of |off |outside |c\.? ?)", re.I)


def fold(s: str) -> str:
    """Lower case, accents and punctuation dropped, single spaces."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^0-9a-z]+", " ", s.lower()).split())


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour swaps, ``most + 1`` when larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    # What is alike at either end costs nothing.
    first, m, n = 0, len(a), len(b)
    while first < m and first < n and a[first] == b[first]:
        first += 1
    while m > first and n > first and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[first:m], b[first:n]
    m, n = len(a), len(b)
    if not m or not n:
        return m + n
    # Only cells at most ``most`` off the diagonal can lie on a way of at most ``most`` edits.
    far = most + 1
    before, row = None, [j if j <= most else far for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        now = [far] * (n + 1)
        least = far
        if i <= most:
            now[0] = least = i
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            v = row[j - 1] + (x != y)
            if row[j] < v:
                v = row[j] + 1
            if now[j - 1] < v:
                v = now[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] < v:
                v = before[j - 2] + 1
            if v < far:
                now[j] = v
                if v < least:
                    least = v
        if least > most:
            return far
        before, row = row, now
    return row[n]


def deletes(s: str) -> set[str]:
    """``s`` and every string with one letter left out."""
    return {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}


class Gazetteer:
    """Index of ``(place_id, name, area, tz)`` rows; picklable, built once per worker."""

    def __init__(self, rows: list[tuple]):
        self.rows = [(int(i), fold(n or ""), fold(a or ""), tz) for i, n, a, tz in rows]
        self.by_name = defaultdict(list)
        for r in self.rows:
            self.by_name[r[1]].append(r)
        self.fuzzy = defaultdict(set)
        for n in self.by_name:
            for d in deletes(n):
                self.fuzzy[d].add(n)
        self.areas = {r[2] for r in self.rows}
        short = {fold(k): fold(v) for k, v in AREA_SHORT.items()}
        self.short = {k: v for k, v in short.items() if v in self.areas}
        self.seen: dict[str, tuple] = {}

    def area_of(self, s: str) -> str | None:
        dotted = s.strip().endswith(".")
        s = fold(s)
        if s in self.areas:
            return s
        if dotted and len(s) >= 2:
            close = [a for a in self.areas if a.startswith(s) or "".join(w[0] for w in a.split()) == s.replace(" ", "")]
            if len(close) == 1:
                return close[0]
        if s in self.short:
            return self.short[s]
        if len(s) >= 3:
            close = [a for a in self.areas if a.startswith(s)]
            if len(close) == 1:
                return close[0]
        if len(s) >= 5:
            close = [a for a in self.areas if edits(s, a, 2) <= (2 if len(a) > 6 else 1)]
            if len(close) == 1:
                return close[0]
        return None

    def names_like(self, name: str) -> list[str]:
        if name in self.by_name:
            return [name]
        near: set[str] = set()
        for d in deletes(name):
            near |= self.fuzzy.get(d, set())
        scored = sorted((edits(name, n, 2), n) for n in near)
        scored = [x for x in scored if x[0] <= (2 if len(name) >= 9 else 1)]
        return [n for d, n in scored if d == scored[0][0]]

    def _parts(self, s: str) -> list[tuple[str, str | None]]:
        """Possible splits of a written place into name and area."""
        out = []
        if m := re.fullmatch(r"(.*?)\s*\(([^)]*)\)\s*", s):
            out.append((m[1], m[2]))
        if "," in s:
            a, _, b = s.rpartition(",")
            out.append((a, b))
        if ":" in s:
            a, _, b = s.partition(":")
            out.append((b, a))
        words = s.split()
        for k in (1, 2, 3):
            if len(words) > k and self.area_of(" ".join(words[-k:])):
                out.append((" ".join(words[:-k]), " ".join(words[-k:])))
        out.append((s, None))
        return out

    def resolve(self, written: str | None) -> tuple[list[int], str | None, str | None]:
        """(place ids it may name, their zone if it is one, the area if given).

        Null, empty and unknown names give no id. A name that several areas
        share gives all of its ids unless the area is written too.
        """
        if not written:
            return [], None, None
        hit = self.seen.get(written)
        if hit is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            hit = self.seen[written] = self._resolve(written)
        return hit

    def _resolve(self, written: str) -> tuple:
        s = " ".join(written.split())
        while m := _LEAD.match(s):
            s = s[m.end() :]
        area_only = None
        for name, area in self._parts(s):
            known = self.area_of(area) if area else None
            if area and not known:
                continue
            folded = fold(name)
            if not folded:
                area_only = area_only or known
                continue
            names = self.names_like(folded)
            got = [r for n in names for r in self.by_name[n] if known is None or r[2] == known]
            if not got and known:
                # a name misread beyond the index: nearest of the written area
                near = sorted((edits(folded, r[1], 3), r) for r in self.rows if r[2] == known)
                near = [x for x in near if x[0] <= (3 if len(folded) >= 10 else 2)]
                got = [r for d, r in near if d == near[0][0]]
            if got:
                zones = {r[3] for r in got}
                return sorted(r[0] for r in got), zones.pop() if len(zones) == 1 else None, known or (got[0][2] if len({r[2] for r in got}) == 1 else None)
            if known:
                area_only = area_only or known
        if area_only is None:
            area_only = self.area_of(s)
        zones = {r[3] for r in self.rows if r[2] == area_only} if area_only else set()
        return [], zones.pop() if len(zones) == 1 else None, area_only
