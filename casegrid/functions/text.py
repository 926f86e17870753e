"""Scalar functions over text, as Column expressions: entities, keywords, scripts, field types, record types, names.

Null gives null or an empty array, as stated; empty text gives empty results. Patterns are Java's, with letters and digits of all
scripts where words are meant.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the kinds of entity looked for in text, several for some kinds; case doesn't matter.
ENTITY_PATTERNS = {
    "phone": [r"\+?\d{1,4}[\s-]?\(?\d{1,4}\)?[\s-]?\d{1,4}[\s-]?\d{1,9}", r"\d{10}", r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", r"\+91[\s-]?\d{10}"],
    "email": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "url": [r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)"],
    "crypto_wallet": [r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", r"\b0x[a-fA-F0-9]{40}\b"],
    "date": [r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}"],
    "time": [r"\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AP]M)?"],
    "money": [r"[$₹€£]\s?\d+(?:,\d{3})*(?:\.\d{2})?", r"\d+(?:,\d{3})*(?:\.\d{2})?\s?(?:USD|INR|EUR|GBP)"],
    "location": [r"\d+\s+[A-Za-z\s,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way)"],
    "coordinates": [r"[-+]?\d{1,3}\.\d+[,\s]+[-+]?\d{1,3}\.\d+"],
}
# Words with a capital in a row, which may be a name; here case matters.
POTENTIAL_NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
# Words that make a message suspicious, and those flagged in transcripts.
KEYWORDS = ["bomb", "explosive", "drug", "cocaine", "heroin", "weapon", "murder", "kill", "ransom", "bitcoin", "crypto", "hawala", "terror", "jihad", "smuggle", "launder", "bribe"]
TRANSCRIPT_KEYWORDS = ["crypto", "bitcoin", "wallet", "transfer", "money", "weapon", "gun", "bomb", "drugs", "illegal", "police", "arrest", "hide", "delete", "destroy"]
# Addresses of wallets, and senders' numbers from abroad.
WALLET = r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b|0x[a-fA-F0-9]{40}"
FOREIGN_NUMBER = r"^\+(?!91)[0-9]{1,3}[0-9\s-]+"
SCRIPTS = {
    "Devanagari": r"\p{IsDevanagari}", "Bengali": r"\p{IsBengali}", "Telugu": r"\p{IsTelugu}", "Tamil": r"\p{IsTamil}", "Gujarati": r"\p{IsGujarati}",
    "Gurmukhi": r"\p{IsGurmukhi}", "Kannada": r"\p{IsKannada}", "Malayalam": r"\p{IsMalayalam}", "Arabic": r"\p{IsArabic}", "Cyrillic": r"\p{IsCyrillic}",
    "Greek": r"\p{IsGreek}", "Hebrew": r"\p{IsHebrew}", "Thai": r"\p{IsThai}", "Hangul": r"\p{IsHangul}", "Han": r"\p{IsHan}", "Hiragana": r"\p{IsHiragana}",
    "Katakana": r"\p{IsKatakana}", "Latin": r"\p{IsLatin}",
}
# Languages written in a script.
SCRIPT_LANGUAGES = {"Devanagari": "hi", "Bengali": "bn", "Telugu": "te", "Tamil": "ta", "Gujarati": "gu", "Gurmukhi": "pa", "Kannada": "kn", "Malayalam": "ml", "Arabic": "ar", "Cyrillic": "ru", "Greek": "el", "Hebrew": "he", "Thai": "th", "Hangul": "ko", "Han": "zh", "Hiragana": "ja", "Katakana": "ja", "Latin": "en"}


def entities(text: Column, kind: str) -> Column:
    """Distinct matches of a kind ('potential_names' included), sorted; empty for null."""
    patterns = [POTENTIAL_NAMES] if kind == "potential_names" else [f"(?i){p}" for p in ENTITY_PATTERNS[kind]]
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(*found))), F.array().cast("array<string>"))


def all_entities(text: Column) -> Column:
    """Array of (kind, value) of all kinds of entity in a text; empty for null."""
    def of(kind: str) -> Column:
        return F.transform(entities(text, kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*map(of, (*ENTITY_PATTERNS, "potential_names")))


def keywords_in(text: Column, words: list[str] | None = None) -> Column:
    """Keywords (by default those that make a message suspicious) that occur in a text as substrings, whatever the case."""
    low = F.lower(text)
    return F.coalesce(F.filter(F.array(*map(F.lit, words or KEYWORDS)), lambda k: F.contains(low, k)), F.array().cast("array<string>"))


def suspicious_patterns(text: Column, sender: Column) -> Column:
    """Array of (pattern_type, pattern_name, severity, confidence): wallets, keywords one by one, senders abroad; empty for nulls."""
    row = lambda t, n, s, c: F.struct(F.lit(t).alias("pattern_type"), n.alias("pattern_name"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    none = F.array().cast("array<struct<pattern_type:string,pattern_name:string,severity:string,confidence:double>>")
    wallet = F.when(F.rlike(text, F.lit(WALLET)), F.array(row("cryptocurrency", F.lit("Crypto Address Detected"), "high", 0.9))).otherwise(none)
    words = F.transform(keywords_in(text), lambda k: row("suspicious_content", F.concat(F.lit("Keyword: "), k), "medium", 0.7))
    abroad = F.when(F.rlike(sender, F.lit(FOREIGN_NUMBER)), F.array(row("foreign_contact", F.lit("International Communication"), "low", 0.8))).otherwise(none)
    return F.concat(wallet, words, abroad)


def script_counts(text: Column) -> Column:
    """Struct of the number of letters of each script."""
    return F.struct(*[F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).alias(k) for k, p in SCRIPTS.items()])


def main_script(text: Column) -> Column:
    """The script with most letters, ties in the order of SCRIPTS; Latin where there is no letter."""
    best = F.array_max(F.array(*[F.struct(F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate(SCRIPTS.items())]))
    return F.when(best["n"] > 0, best["k"]).otherwise(F.lit("Latin"))


def script_language(script: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SCRIPT_LANGUAGES.items() for x in kv])
    return F.coalesce(m[script], F.lit("unknown"))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalised(text: Column) -> Column:
    """Composed characters, plain quotes and dashes, one kind of line end, single blanks, no invisible characters."""
    t = F.when(F.rlike(text, F.lit(r"^[\x00-\x7f]*$")), text).otherwise(_composed(text))
    t = F.translate(t, "‘’“”–—‐", "''\"\"---")
    t = F.regexp_replace(t, r"[\x{200b}-\x{200d}\x{feff}]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[ \t\x{a0}]+", " ")
    return F.trim(t)


def key_values(text: Column) -> Column:
    """Map of `Key: value` lines, keys in lower case, the last value of a key."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_]+):\s*(.+)$"), F.lit(0))
    split = F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^([A-Za-z_]+):", 1)).alias("k"), F.trim(F.regexp_extract(p, r"^[A-Za-z_]+:\s*(.+)$", 1)).alias("v")))
    last = F.aggregate(split, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda y: y["k"] != x["k"]), F.array(x)))
    return F.map_from_entries(last)


def seconds_of(text: Column) -> Column:
    """Seconds of `H:M:S`, `M:S`, `180 seconds`, `3m 20s`, `2 minutes` or a plain number; null otherwise."""
    t = F.lower(F.trim(text))
    p = F.split(t, ":")
    clock = F.when(F.rlike(t, F.lit(r"^\d+:\d{1,2}:\d{1,2}$")), F.get(p, F.lit(0)).cast("int") * 3600 + F.get(p, F.lit(1)).cast("int") * 60 + F.get(p, F.lit(2)).cast("int"))
    clock = clock.when(F.rlike(t, F.lit(r"^\d+:\d{1,2}$")), F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int"))
    unit = lambda pat: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, pat, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    worded = unit(r"(\d+)\s*h") * 3600 + unit(r"(\d+)\s*m") * 60 + unit(r"(\d+)\s*s")
    return F.when(F.rlike(t, F.lit(r"^[\d:]+$")) & F.contains(t, F.lit(":")), clock).when(F.rlike(t, F.lit(r"\d+\s*[hms]")), worded).when(F.rlike(t, F.lit(r"^\d+(\.\d+)?$")), F.floor(F.try_to_number(F.regexp_extract(t, r"^(\d+)", 1), F.lit("999999999"))).cast("int"))


def field_type(value: Column) -> Column:
    """Kind of a string value: uuid, phone, email, datetime or text, the first that fits; unknown for null."""
    v = F.trim(value)
    is_ = lambda p: F.rlike(v, F.lit(p))
    return (
        F.when(v.isNull(), "unknown").when(is_(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid").when(is_(r"^\+?[0-9]{7,15}$"), "phone")
        .when(is_(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}$"), "email")
        .when(is_(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}(T|[ \t\n]+)|[0-9]{2}/[0-9]{2}/[0-9]{4}[ \t\n]+)[0-9]{2}:[0-9]{2}:[0-9]{2}"), "datetime").otherwise("text")
    )


def mask_numbers(text: Column) -> Column:
    """Cards, identity numbers and phones replaced by marks, the longest first."""
    t = F.regexp_replace(text, r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[CARD]")
    return F.regexp_replace(F.regexp_replace(t, r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[ID]"), r"\b\d{10}\b", "[PHONE]")


def short_id(*parts: Column, length: int = 16) -> Column:
    """First characters of the MD5 of parts joined by `:`."""
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, length)


def band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").when(score >= 0.5, "low").otherwise("none")


# names and their likeness


@F.pandas_udf(StringType())
def _without_marks(names: pd.Series) -> pd.Series:
    """Lower case, decomposed, without combining marks (accents, signs of vowels)."""
    known = {n: "".join(c for c in unicodedata.normalize("NFD", n).lower() if not unicodedata.category(c).startswith("M")) for n in names.dropna().unique()}
    return names.map(known).astype(object).where(names.notna(), None)


def plain_name(name: Column) -> Column:
    """Lower case without accents and vowel signs; letters, digits and blanks only, single blanks. Null stays null."""
    plain = F.when(F.rlike(name, F.lit(r"^[\x00-\x7f]*$")), F.lower(name)).otherwise(_without_marks(name))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.95 if the same words, else 0.6 x share of common words + 0.4 x (1 - edits / longer length); 0 for empty ones."""
    return plain_similarity(plain_name(a), plain_name(b))


def plain_similarity(x: Column, y: Column) -> Column:
    """name_similarity of two names that have been through plain_name."""
    tx, ty = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    both, all_ = F.size(F.array_intersect(tx, ty)), F.size(F.array_union(tx, ty))
    lev = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    s = F.when(x == y, 1.0).when((both == F.size(tx)) & (both == F.size(ty)), 0.95).otherwise(0.6 * both / all_ + 0.4 * lev)
    return F.when((F.length(x) > 0) & (F.length(y) > 0), s).otherwise(0.0)


def phone_variants(digits: Column) -> Column:
    """A number's digits with and without the usual prefixes, and its last ten."""
    last = F.right(digits, F.lit(10))
    return F.array_distinct(F.array(digits, F.concat(F.lit("91"), last), F.concat(F.lit("1"), last), F.concat(F.lit("44"), last), last))
