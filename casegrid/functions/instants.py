"""Timestamp strings to instants: one parser for each distinct shape mask, applied to whole columns of characters.

A mask writes every letter as `a`, every digit as `9` and keeps all else, so all strings of one mask hold each
field at the same place. The mask is matched against the grammar below once; the parser that results cuts
the fields out of a character matrix with array slices.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from casegrid.functions import zones

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "IST": 330, "UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "CST": -360, "CDT": -300,
    "BST": 60, "CET": 60, "CEST": 120, "AEST": 600, "AEDT": 660,
}
# Names of the months.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
MONTH_NUMBER = {name[:k]: i for i, name in enumerate(MONTHS, 1) for k in range(3, len(name) + 1)}
MONTH_NUMBER["sept"] = 9

#: Plain numbers denote instants of these years only (seconds since 1970, end exclusive).
EPOCH_LOW, EPOCH_HIGH = 1230768000, 1798761600
#: Seconds from 1970 to 2001, where the other epoch begins.
EPOCH_2001 = 978307200

_TIME = r"(?P<h>9{1,2}):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?(?: ?(?P<ap>aa)(?!a))?"
_ZONE = r"(?: ?(?P<utc>aaa)?(?P<sign>[+-])(?P<oh>9{1,2})(?::?(?P<om>99))?| ?(?P<ab>a{1,4})|(?P<zone>\[[^\]]+\]))?"
_DATES = [
    r"(?P<y>9999)-(?P<m>99)-(?P<d>99)",
    r"(?P<y>9999)/(?P<m>99)/(?P<d>99)",
    r"(?P<y>9999):(?P<m>99):(?P<d>99)",
    r"(?P<p>9{1,2})/(?P<q>9{1,2})/(?P<y>9999)",
    r"(?P<d>9{1,2})-(?P<m>9{1,2})-(?P<y>9999)",
    r"(?P<d>9{1,2})\.(?P<m>9{1,2})\.(?P<y>9999)",
    r"(?:a{3,9}, ?)?(?P<mon>a{3,9})\.? (?P<d>9{1,2}),? (?P<y>9999)",
    r"(?:a{3,9}, ?)?(?P<d>9{1,2})[ -](?P<mon>a{3,9})\.?,?[ -](?P<y>9999)",
]
_GRAMMAR = [re.compile(rf"{d}(?:[aT ,]{{1,2}}{_TIME}{_ZONE})?") for d in _DATES] + [
    re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)a(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9{1,9}))?)?" + _ZONE)
]
_NUMBER = re.compile(r"(?P<n>9{9,19})(?:[.,](?P<f>9{1,9}))?")


def mask_of(text: pd.Series) -> pd.Series:
    """Shape masks of strings; the plan makes the same masks with built-in expressions."""
    return text.str.replace(r"[A-Za-z]", "a", regex=True).str.replace(r"[0-9]", "9", regex=True)


def _digits(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> list[str]:
    codes = np.ascontiguousarray(chars[:, span[0] : span[1]]).astype(np.uint32)
    return codes.view(f"<U{span[1] - span[0]}").ravel().tolist()


def _lookup(words: list[str], known: dict, otherwise: int) -> np.ndarray:
    return np.array([known.get(w, otherwise) for w in words], dtype=np.int64)


def _millis_of_fraction(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    width = min(3, span[1] - span[0])
    return _digits(chars, (span[0], span[0] + width)) * 10 ** (3 - width)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    m = np.where(ok, m, 1)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[m - 1] + ((m == 2) & leap)
    ok &= d <= length
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1, ok


def _numeric(found: re.Match) -> Callable:
    spans = {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
    width = spans["n"][1] - spans["n"][0]
    base = EPOCH_2001 if width % 3 == 0 else 0
    power = {9: 0, 10: 0, 12: 3, 13: 3, 15: 6, 16: 6, 18: 9, 19: 9}.get(width)

    def parse(chars: np.ndarray, zone: np.ndarray, ios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if power is None or ("f" in spans and power):
            return np.zeros(len(chars), dtype=np.int64), np.zeros(len(chars), dtype=bool)
        seconds = _digits(chars, (0, width - power)) + base
        if "f" in spans:
            part = _millis_of_fraction(chars, spans["f"])
        elif power:
            part = _digits(chars, (width - power, width - power + 3))
        else:
            part = np.zeros(len(chars), dtype=np.int64)
        return seconds * 1000 + part, (seconds >= EPOCH_LOW) & (seconds < EPOCH_HIGH) & (ios | (base == 0))

    return parse


def _calendar(found: re.Match) -> Callable:
    spans = {k: found.span(k) for k, v in found.groupdict().items() if v is not None}

    def parse(chars: np.ndarray, zone: np.ndarray, ios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(chars)
        zero = np.zeros(n, dtype=np.int64)
        y = _digits(chars, spans["y"])
        ok = np.ones(n, dtype=bool)
        half = _lookup([w.upper() for w in _words(chars, spans["ap"])], {"AM": 0, "PM": 12}, -1) if "ap" in spans else None
        if "mon" in spans:
            m, d = _lookup([w.lower() for w in _words(chars, spans["mon"])], MONTH_NUMBER, 0), _digits(chars, spans["d"])
        elif "p" in spans:  # slashed: month first with AM/PM, else day first
            p, q = _digits(chars, spans["p"]), _digits(chars, spans["q"])
            m, d = (p, q) if half is not None else (q, p)
        else:
            m, d = _digits(chars, spans["m"]), _digits(chars, spans["d"])
        days, real = _days(y, m, d)
        ok &= real
        h, mi, s = (_digits(chars, spans[k]) if k in spans else zero for k in ("h", "mi", "s"))
        if half is not None:
            ok &= (half >= 0) & (h >= 1) & (h <= 12)
            h = h % 12 + half
        ok &= (h < 24) & (mi < 60) & (s < 60)
        wall = days * 86400 + h * 3600 + mi * 60 + s
        millis = _millis_of_fraction(chars, spans["f"]) if "f" in spans else zero
        if "sign" in spans:
            if "utc" in spans:
                ok &= np.isin(np.array(_words(chars, spans["utc"])), ["GMT", "UTC"])
            oh, om = _digits(chars, spans["oh"]), _digits(chars, spans["om"]) if "om" in spans else zero
            ok &= (oh <= 18) & (om < 60)
            sign = np.where(chars[:, spans["sign"][0]] == ord("-"), -1, 1)
            utc = wall - sign * (oh * 3600 + om * 60)
        elif "ab" in spans:
            minutes = _lookup(_words(chars, spans["ab"]), ABBREVIATIONS, 99999)
            ok &= minutes != 99999
            utc = wall - minutes * 60
        else:
            if "zone" in spans:
                a, b = spans["zone"]
                zone = np.array(_words(chars, (a + 1, b - 1)), dtype=object)
            utc = wall.copy()
            codes, names = pd.factorize(zone)  # -1: no zone is known, then UTC
            for k, name in enumerate(names):
                rows = codes == k
                moved = zones.wall_to_utc(wall[rows], str(name).strip())
                if moved is not None:
                    utc[rows] = moved
                elif "zone" in spans:
                    ok[rows] = False
        return utc * 1000 + millis, ok

    return parse


@functools.lru_cache(maxsize=4096)
def parser_for(mask: str) -> Callable | None:
    """The parser of a mask, made once per process; None if strings of this shape denote no instant."""
    if found := _NUMBER.fullmatch(mask):
        return _numeric(found)
    for rule in _GRAMMAR:
        if found := rule.fullmatch(mask):
            return _calendar(found)
    return None


def to_millis(text: pd.Series, mask: pd.Series, zone: pd.Series, ios: pd.Series) -> pd.Series:
    """Milliseconds since 1970 UTC, null where a string denotes no instant. All four have the same length."""
    out = np.zeros(len(text), dtype=np.int64)
    valid = np.zeros(len(text), dtype=bool)
    codes, masks = pd.factorize(mask)
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(masks) + 1))
    values, zone_of, on_ios = text.to_numpy(dtype=object), zone.to_numpy(dtype=object), ios.fillna(False).to_numpy(dtype=bool)
    for k, shape in enumerate(masks):
        parse = parser_for(shape)
        if parse is None:
            continue
        rows = order[bounds[k] : bounds[k + 1]]
        chars = np.array(values[rows].tolist(), dtype=f"<U{len(shape)}").view(np.uint32).reshape(len(rows), len(shape))
        out[rows], valid[rows] = parse(chars, zone_of[rows], on_ios[rows])
    return pd.Series(pd.arrays.IntegerArray(out, ~valid), index=text.index)
