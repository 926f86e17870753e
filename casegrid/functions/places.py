"""Coordinates, addresses and kinds of place from text. Null and unreadable values give nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of coordinates, parts of addresses, countries, states and words for kinds of place.
_PAIR = r"^\[?(-?\d+\.?\d*)[,\s]+(-?\d+\.?\d*)\]?$"
_DMS = r"(\d+)°\s*(\d+)'\s*([\d.]+)\"?\s*([NSEW])"
POSTAL_CODES = [r"\b\d{5}(?:-\d{4})?\b", r"(?i)\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b", r"(?i)\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b", r"\b\d{6}\b"]
STREET_NUMBER, UNIT = r"^\d+[A-Z]?(?:\s+\w+)?", r"(?i)(?:apt|unit|suite|#)\s*[\w-]+"
COUNTRIES = {"USA": ["USA", "United States", "US", "America"], "India": ["India", "Bharat"], "UK": ["UK", "United Kingdom", "England", "Scotland", "Wales"], "Canada": ["Canada", "CA"], "Australia": ["Australia", "AU"]}
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
PLACE_WORDS = {
    "home": ["home", "residence", "house", "apartment"], "work": ["office", "work", "workplace", "company"], "restaurant": ["restaurant", "cafe", "diner", "eatery"],
    "shop": ["store", "shop", "mall", "market"], "school": ["school", "university", "college", "academy"], "hospital": ["hospital", "clinic", "medical"],
    "transit": ["station", "airport", "bus", "train", "metro"],
}


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, direction: Column) -> Column:
    """Decimal degrees; south and west are negative."""
    value = degrees.try_cast("double") + minutes.try_cast("double") / 60 + seconds.try_cast("double") / 3600
    return F.when(direction.isin("S", "W"), -value).otherwise(value)


def to_dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds to two decimals, with the letter of the side."""
    a = F.abs(value)
    d, rest = F.floor(a), (a - F.floor(a)) * 60
    return F.format_string("%d°%d'%.2f\"%s", d, F.floor(rest), (rest - F.floor(rest)) * 60, F.when(value >= 0, positive).otherwise(negative))


def coordinate(text: Column) -> Column:
    """Struct (latitude, longitude, form) of `28.61, 77.20`, `[28.61, 77.20]` or degrees, minutes and seconds; null outside the globe. A
    coordinate of 0 is one like any other."""
    t = F.trim(text)
    pair = F.rlike(t, F.lit(_PAIR))
    parts = F.regexp_extract_all(t, F.lit(_DMS), F.lit(0))
    side = lambda i: dms_to_decimal(*[F.regexp_extract(F.get(parts, F.lit(i)), _DMS, k) for k in (1, 2, 3, 4)])
    la = F.when(pair, F.regexp_extract(t, _PAIR, 1).try_cast("double")).when(F.size(parts) >= 2, side(0))
    lo = F.when(pair, F.regexp_extract(t, _PAIR, 2).try_cast("double")).when(F.size(parts) >= 2, side(1))
    form = F.when(pair & F.startswith(t, F.lit("[")), "exif").when(pair, "decimal_string").otherwise("dms")
    return F.when(la.between(-90, 90) & lo.between(-180, 180), F.struct(la.alias("latitude"), lo.alias("longitude"), form.alias("form")))


def address(text: Column) -> Column:
    """Struct of the parts of an address and a confidence of 0.5 and what each part adds; null for null and blank.

    The first postal code pattern that fits counts, states in alphabetical order, countries as whole words (so that 'US' isn't found in 'Russia').
    """
    t = F.trim(text)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    postal, unit, street = F.coalesce(*map(first, POSTAL_CODES)), first(UNIT), first(STREET_NUMBER)
    country, state = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, names in reversed(COUNTRIES.items()):
        country = F.when(F.rlike(t, F.lit(r"(?i)\b(?:" + "|".join(names) + r")\b")), name).otherwise(country)
    padded = F.concat(F.upper(t), F.lit(" "))
    for code in reversed(sorted(US_STATES)):
        state = F.when(F.contains(padded, F.lit(f" {code} ")), code).otherwise(state)
    parts = F.split(t, ",")
    city = F.when(F.size(parts) >= 2, F.nullif(F.element_at(F.split(F.trim(F.get(parts, F.size(parts) - 2)), r"\s+"), -1), F.lit("")))
    adds = [(postal, 0.1), (unit, 0.05), (street, 0.1), (country, 0.15), (state, 0.1), (city, 0.05)]
    confidence = F.round(F.lit(0.5) + sum((F.when(c.isNotNull(), x).otherwise(0.0) for c, x in adds), F.lit(0.0)), 6)
    standard = F.nullif(F.concat_ws(", ", street, unit, city, state, postal, country), F.lit(""))
    fields = [street.alias("street_number"), unit.alias("unit"), city.alias("city"), state.alias("state"), postal.alias("postal_code"), country.alias("country"), F.coalesce(standard, t).alias("standardized"), confidence.alias("confidence")]
    return F.when(F.length(t) > 0, F.struct(*fields))


def kind_of_place(text: Column, visits: Column) -> Column:
    """Kind of place by words in its name or address, the first kind that fits, else by its visits: frequent from 10, regular from 5, poi."""
    low, out = F.lower(text), F.when(visits >= 10, "frequent").when(visits >= 5, "regular").otherwise("poi")
    for kind, words in reversed(PLACE_WORDS.items()):
        out = F.when(F.rlike(low, F.lit("|".join(words))), kind).otherwise(out)
    return out


def geojson(latitude: Column, longitude: Column, **properties: Column) -> Column:
    """A GeoJSON point feature as JSON text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties")))
