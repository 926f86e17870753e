"""Versioned zone transition tables: wall clock to UTC for whole arrays at once."""

from __future__ import annotations

import datetime as dt
import functools
import zoneinfo

import numpy as np

#: First and last year for which a table holds transitions.
FIRST_YEAR, LAST_YEAR = 1970, 2040


@functools.lru_cache(maxsize=1)
def version() -> str:
    """Release of the zone rules in use; part of every table's key, so that results can be tied to it."""
    try:
        import tzdata

        packaged = str(tzdata.IANA_VERSION)
    except ImportError:
        packaged = "unknown"
    for root in zoneinfo.TZPATH:
        try:
            with open(f"{root}/tzdata.zi") as f:
                return f.readline().replace("# version", "").strip()
        except OSError:
            continue
    return packaged


def _offset(zone: zoneinfo.ZoneInfo, second: int) -> int:
    at = dt.datetime.fromtimestamp(second, dt.timezone.utc)
    return int(zone.utcoffset(at.astimezone(zone)).total_seconds())


@functools.lru_cache(maxsize=1024)
def transitions(name: str, release: str = "") -> tuple[np.ndarray, np.ndarray] | None:
    """(thresholds, offsets) of a zone, both in seconds; None for an unknown name.

    A wall time w has offsets[searchsorted(thresholds, w, "right")]. The threshold of a change lies at
    instant + max(offset before, offset after): so a repeated wall time is its first occurrence and a
    skipped one is read with the offset before the change.
    """
    del release  # only a cache key
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    begin = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    end = int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    step = 7 * 86400
    offsets, at = [_offset(zone, begin)], []
    low = begin
    while low < end:
        high = min(low + step, end)
        after = _offset(zone, high)
        if after != offsets[-1]:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if _offset(zone, mid) == offsets[-1] else (a, mid)
            at.append(b + max(offsets[-1], _offset(zone, b)))
            offsets.append(_offset(zone, b))
            low = b
        else:
            low = high
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def wall_to_utc(wall_seconds: np.ndarray, name: str) -> np.ndarray | None:
    """UTC seconds of wall-clock seconds in a zone; None for an unknown zone."""
    found = transitions(name, version())
    if found is None:
        return None
    thresholds, offsets = found
    return wall_seconds - offsets[np.searchsorted(thresholds, wall_seconds, side="right")]
