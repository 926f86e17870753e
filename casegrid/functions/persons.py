"""Whether a text is a person's name, by the mean of several signals. Null and blank texts score 0 and are no names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrid.functions.text import SCRIPTS, main_script

# Forms of address, names, verbs and prefixes that count as signals.
HONORIFICS = [
    "mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "kumari", "sri", "kumar", "captain", "col", "major", "sir", "madam", "lord", "lady",
]
FIRST_NAMES = [
    "राज", "राजेश", "सुरेश", "महेश", "प्रिया", "अनिता", "सुनीता", "रवि", "विजय", "अजय", "संजय", "मोहन", "सोहन",
    "raj", "rajesh", "suresh", "mahesh", "priya", "anita", "sunita", "ravi", "vijay", "ajay", "sanjay", "mohan", "sohan",
    "amit", "sumit", "deepak", "anil", "sunil", "kapil", "neha", "pooja", "sneha", "ritu", "meera", "kavita",
]
LAST_NAMES = ["kumar", "sharma", "singh", "verma", "gupta", "patel", "reddy", "desai", "rao", "iyer", "joshi", "mehta", "agarwal", "shah"]
VERBS = ["call", "message", "sent", "received", "send", "get", "come", "go", "see", "meet"]
COUNTRIES = {"+91": "IN", "+1": "US", "+44": "GB", "+61": "AU", "+81": "JP", "+86": "CN"}
INDIAN_SCRIPTS = ["Devanagari", "Bengali", "Telugu", "Tamil", "Gujarati", "Kannada", "Malayalam", "Gurmukhi"]


def words(text: Column) -> Column:
    """Words of a text between white space; empty for null and blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\h]+"), lambda w: F.length(w) > 0)


def honorific(text: Column) -> Column:
    """The form of address that a text begins with, without its full stop; null if none."""
    first = F.regexp_replace(F.lower(F.get(words(text), F.lit(0))), r"^[.,]+|[.,]+$", "")
    return F.when(first.isin(HONORIFICS), first)


def phone_country(phone: Column) -> Column:
    """Country of a number by its prefix, the first that fits; null if none."""
    out = F.lit(None).cast("string")
    for code, country in reversed(COUNTRIES.items()):
        out = F.when(F.startswith(F.trim(phone), F.lit(code)), country).otherwise(out)
    return out


def list_score(text: Column) -> Column:
    """0.9 if a first and a last name of the lists occur, 0.6 if one of them, else null."""
    own = F.transform(words(text), lambda w: F.lower(w))
    has = lambda names: F.arrays_overlap(own, F.array(*map(F.lit, names)))
    return F.when(has(FIRST_NAMES) & has(LAST_NAMES), 0.9).when(has(FIRST_NAMES) | has(LAST_NAMES), 0.6)


def detect(text: Column, phone: Column, in_contacts: bool = False, ner: Column | None = None) -> Column:
    """Struct (is_name, confidence, script, honorific, tokens, country): confidence is the mean of the signals that apply.

    Script 0.7 (Indian) or 0.5 (Latin), Indian number 0.6, a recogniser's score, name lists, form of address 0.9, all words with a capital
    0.75, number of words, a verb 0.1, contacts list 0.8. From 0.5 on it is a name with a strong signal, else from 0.65 on.
    """
    own = words(text)
    n = F.size(own)
    letters = F.coalesce(F.regexp_count(text, F.lit("|".join(SCRIPTS.values()))), F.lit(0)) > 0
    script = F.when(letters, main_script(text)).otherwise("Unknown")
    indian, latin = script.isin(INDIAN_SCRIPTS), script == "Latin"
    country, lists, title = phone_country(phone), list_score(text), honorific(text)
    verb = F.exists(own, lambda w: F.lower(w).isin(VERBS))
    capital = latin & (n >= 2) & F.forall(own, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    signals = [
        F.when(indian, 0.7).when(latin, 0.5), F.when(country == "IN", 0.6), ner if ner is not None else F.lit(None).cast("double"), lists, F.when(title.isNotNull(), 0.9), F.when(capital, 0.75),
        F.when(verb, 0.1).when(n.between(2, 4) & ~capital, 0.6).when(n == 1, 0.3).when(~capital, 0.2), F.lit(0.8) if in_contacts else F.lit(None).cast("double"),
    ]
    given = F.array_compact(F.array(*signals))
    mean = F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given)
    confidence = F.when((n > 0) & (F.size(given) > 0), mean).otherwise(0.0)
    strong = title.isNotNull() | lists.isNotNull() | capital | indian | (F.coalesce(ner > 0.8, F.lit(False)) if ner is not None else F.lit(False))
    is_name = (n > 0) & (confidence >= F.when(strong, 0.5).otherwise(0.65))
    return F.struct(is_name.alias("is_name"), F.round(confidence, 6).alias("confidence"), script.alias("script"), title.alias("honorific"), n.alias("tokens"), country.alias("country"))
