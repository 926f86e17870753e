import pandas as pd
import pytest

from casegrid.functions import instants, zones


def ms(text, zone=None, ios=False):
    s = pd.Series([text])
    out = instants.to_millis(s, instants.mask_of(s), pd.Series([zone], dtype=object), pd.Series([ios]))
    return None if pd.isna(out[0]) else int(out[0])


BASE = 1609459200000  # 2021-01-01T00:00:00Z


@pytest.mark.parametrize("text", [
    "1609459200", "1609459200000", "1609459200000000", "1609459200000000000", "2021-01-01T00:00:00Z", "2021-01-01", "01-01-2021", "Jan 1, 2021 12:00 AM",
    "January 1, 2021 12:00 AM", "01/01/2021 00:00:00", "01/01/2021 12:00 AM", "2021:01:01 00:00:00", "2021-01-01 05:30:00 IST", "2021-01-01T05:30:00+05:30", "20210101T053000+0530",
    "1 January 2021 05:30:00 GMT+5:30", "Fri, 01 Jan 2021 00:00:00 +0000", "2021-01-01T05:30:00[Asia/Kolkata]", "2020-12-31 19:00:00-0500", "1 January 2021 00:00:00 GMT+0",
])
def test_one_instant(text):
    assert ms(text) == BASE


@pytest.mark.parametrize("text", ["", "unknown", "2 hours ago", "31/02/2023 25:61:00", "0000-00-00 00:00:00", "2021-02-29", "9876543210", "13/13/2021 10:00 AM", "Invalid date", "2021-01-01 00:00:00 XYZ", "1609459200 x"])
def test_no_instant(text):
    assert ms(text) is None


def test_epochs_by_device():
    assert ms("745525568", ios=True) == (745525568 + 978307200) * 1000
    assert ms("745525568") is None
    assert ms("735887553476211000", ios=True) == 735887553476 + 978307200000
    assert ms("1712582583.989") == 1712582583989


def test_fractions_are_cut():
    assert ms("2021-01-01T00:00:00.9999Z") == BASE + 999
    assert ms("2021-01-01T00:00:00,5Z") == BASE + 500


def test_wall_times_around_changes():
    # New York 2024: skipped 02:30 on 10 March is read with the offset before; 01:30 on 3 November is the first occurrence
    assert ms("2024-03-10 02:30:00", "America/New_York") == pd.Timestamp("2024-03-10T07:30Z").value // 10**6
    assert ms("2024-03-10 03:00:00", "America/New_York") == pd.Timestamp("2024-03-10T07:00Z").value // 10**6
    assert ms("2024-11-03 01:30:00", "America/New_York") == pd.Timestamp("2024-11-03T05:30Z").value // 10**6
    assert ms("2024-11-03 02:00:00", "America/New_York") == pd.Timestamp("2024-11-03T07:00Z").value // 10**6


def test_zone_tables_agree_with_the_library():
    import datetime as dt
    import zoneinfo

    import numpy as np

    for name in ("Europe/London", "Australia/Sydney", "Asia/Kathmandu"):
        wall = np.arange(1700000000, 1735000000, 3571)
        got = zones.wall_to_utc(wall, name)
        zone = zoneinfo.ZoneInfo(name)
        for w, g in list(zip(wall, got))[::97]:
            want = dt.datetime.fromtimestamp(int(w), dt.timezone.utc).replace(tzinfo=zone).timestamp()
            assert g == want
    assert zones.wall_to_utc(np.array([0]), "No/Where") is None


def test_slashed_dates_and_devices():
    assert ms("02/03/2024 10:00:00") == pd.Timestamp("2024-03-02T10:00Z").value // 10**6
    assert ms("02/03/2024 10:00 AM") == pd.Timestamp("2024-02-03T10:00Z").value // 10**6
    assert ms("2024-07-01 10:00", "Asia/Kolkata") == pd.Timestamp("2024-07-01T04:30Z").value // 10**6
