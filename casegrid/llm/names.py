"""Variant spellings of names within a case (problem 3).

Spellings are parsed into tokens (titles, marks of a second number and legal forms put aside, run-together names split).
Near tokens, near brands and near whole names are found by a pigeonhole segment join: a string within k edits of another
shares, unchanged, at least two of k + 2 segments with it, at places shifted by no more than the edits allow. Pairs of segments of one side
are an inverted index, more selective than single ones; the other side looks up its position-shifted pairs of substrings; candidates are
verified with a banded edit distance that counts a swap of neighbours as one edit. A rarer token that lies near a much more frequent one is taken as its
misspelling; two tokens frequent in their own right (Nitin, Nitish) stay apart however near they are.

A spelling with two full tokens names an entity by itself. If one of them is a listed nickname, it goes to the entity of its
case with the formal name in its place, or, of several, to the one that shares a number or e-mail. An unlisted nickname goes to
a much more frequent name beside the same other token if they share a number or e-mail and look alike.
One with an initial, a nickname or a single token is
resolved to an entity of its case by its tokens together with shared numbers and e-mails, or, with an initial, if only
one entity of the case fits. Evidence alone never links: lines are shared.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions.phones import with_country
from casegrid.session import cut, table

# Words that are no part of a name.
TITLES = {"dr", "mr", "mrs", "ms", "miss", "adv", "prof", "shri", "sri", "smt", "er", "capt", "col", "sr", "sra", "herr", "frau", "mme", "m"}
MARKS = {"ji", "bhai", "sir", "madam", "saab", "sahab", "didi", "uncle", "aunty", "office", "home", "work", "new", "no", "bank", "shop", "mobile", "old", "whatsapp", "cell", "number"}
LEGAL = {"ltd", "limited", "pvt", "private", "inc", "incorporated", "llp", "llc", "co", "corp", "gmbh", "sons", "bros", "brothers", "plc"}
BUSINESS = ["motors", "enterprises", "electronics", "trading", "company", "finance", "services", "service", "medical", "stores", "store", "logistics", "travels", "courier", "traders", "industries", "textiles", "foods", "hardware", "jewellers", "pharmacy", "builders", "solutions", "agency", "transport"]
PLACEHOLDERS = {"unknown", "no name", "noname", "private number", "private", "withheld", "spam", "na", "n a", "null", "none", "me", "owner", "self", "mine", "my number", "myself", "blocked", "restricted", "anonymous", "caller", "test", "unavailable", "number withheld", "unknown caller", "phone owner", "device owner"}


@dataclass(frozen=True)
class Settings:
    """edits: most edits between near strings; ratio: how much more frequent the right spelling must be."""

    edits: int = 2
    ratio: float = 3.0


def plain(text: str) -> str:
    """Lower case without accents on Latin letters; other scripts keep their marks."""
    out = unicodedata.normalize("NFKD", text.casefold())
    out = "".join(c for i, c in enumerate(out) if not (unicodedata.combining(c) and i and out[i - 1].isascii()))
    return unicodedata.normalize("NFC", re.sub("[̀-ͯ]", "", out))


def _business(token: str) -> str | None:
    """The business word a token is or abbreviates (same first letter, letters in order), singular."""
    for w in BUSINESS:
        if token == w:
            return w.rstrip("s")
    if token in ("co", "cmpny"):
        return None
    for w in BUSINESS:
        if 3 <= len(token) < len(w) and token[0] == w[0] and token != w.rstrip("s"):
            at = iter(w)
            if all(c in at for c in token) and (w.startswith(token) or not set(token[1:]) & set("aeiou") or len(token) == 4):
                return w.rstrip("s")
    return None


def parse(name: str | None) -> tuple[str, list[str], list[str], str]:
    """(kind, tokens, initials, line): kind is 'person', 'org' or '' (no name); line: an organisation's business."""
    if not name or not re.search(r"[^\W\d_]", name):
        return "", [], [], ""
    raw = re.sub(r"([^\W\d_A-Z])([A-ZÀ-Þ])(?=[^\W\d_A-Z])", r"\1 \2", re.sub(r"\([^)]*\)", " ", name))
    ms = bool(re.match(r"\s*m/s\b", raw, re.I))
    low = re.sub(r"^\s*m/s\b\.?", " ", plain(raw))
    bare = " ".join(re.findall(r"[^\W\d_]+", low))
    if bare in PLACEHOLDERS or not bare:
        return "", [], [], ""
    tokens = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", low)
    legal = [t for t in tokens if t in LEGAL]
    rest = [t for t in tokens if t not in LEGAL and t != "and"]
    lines = [(t, _business(t)) for t in rest]
    firm = [b for t, b in lines[1:] if b] if len(rest) > 1 else []
    if ms or firm or (legal and len(rest) > 1):
        words = [b for t, b in lines[1:] if b]
        brand = [t for k, (t, b) in enumerate(lines) if not b or k == 0]
        line = "-".join(sorted(set(words) - {"company", "compan"}))
        return "org", ["".join(brand)], [], line
    found = [t for t in tokens if t not in TITLES or (t == "m" and len(tokens) == 2)]
    found = [t for t in found if t not in MARKS] or found
    full = [t for t in found if len(t) > 1]
    initials = [t for t in found if len(t) == 1]
    return ("person", full, initials, "") if full else ("", [], [], "")


def banded(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, within a band of width most; most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = most + 1
    older: dict[int, int] = {}
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if not j:
                now[0] = i
                continue
            d = min(before.get(j - 1, big) + (a[i - 1] != b[j - 1]), before.get(j, big) + 1, now.get(j - 1, big) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older.get(j - 2, big) + 1)
            now[j] = d
        older, before = before, now
        if min(before.values()) > most:
            return big
    return min(before.get(len(b), big), big)


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, end) of the k + 2 segments of a string of n characters, as even as can be."""
    cuts = [i * n // (k + 2) for i in range(k + 3)]
    return list(zip(cuts, cuts[1:]))


@functools.lru_cache(maxsize=1024)
def _places(size: int, k: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, segment, segment, start, end, start, end) of what a string of `size` looks up: for each length within k, each two segments
    and each two shifts that k edits before, between and behind them can bring about."""
    out = []
    for n in range(max(1, size - k), size + k + 1):
        more, parts = size - n, segments(n, k)
        for i, j in combinations(range(k + 2), 2):
            for d, e in product(range(-k, k + 1), repeat=2):
                (a, b), (c, f) = parts[i], parts[j]
                if abs(d) + abs(e - d) + abs(more - e) <= k and a + d >= 0 and b + d <= c + e and f + e <= size:
                    out.append((n, i, j, a + d, b + d, c + e, f + e))
    return out


def index_keys(s: str, k: int) -> list[str]:
    """Keys of a string in the index: its length, two segments' numbers and their text."""
    parts = segments(len(s), k)
    return [f"{len(s)}.{i}.{j}.{s[slice(*parts[i])]}.{s[slice(*parts[j])]}" for i, j in combinations(range(k + 2), 2)]


def probe_keys(s: str, k: int) -> list[str]:
    """Keys of every index entry that a string within k insertions, deletions and replacements, or one swap, shares."""
    return sorted({f"{n}.{i}.{j}.{s[a:b]}.{s[c:f]}" for n, i, j, a, b, c, f in _places(len(s), k)})


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], settings: Settings) -> DataFrame:
    """(by..., a, b, distance) of strings within `edits` of one another; left: by..., a, weight; right: by..., b, more.

    Strings under five letters allow one edit only, those under three none. Only pairs in which b is `ratio` times heavier than a are looked at.
    """
    k = settings.edits
    make_index = F.pandas_udf(lambda s: s.map(lambda x: index_keys(x, k)), "array<string>")
    make_probe = F.pandas_udf(lambda s: s.map(lambda x: probe_keys(x, k)), "array<string>")
    distance = F.pandas_udf(lambda a, b: pd.Series([banded(x, y, k) for x, y in zip(a, b)], dtype="int32"), "int")
    index = right.withColumn("key", F.explode(make_index("b")))
    probe = left.withColumn("key", F.explode(make_probe("a")))
    pairs = probe.join(index, [*by, "key"]).where((F.col("a") != F.col("b")) & (F.col("more") >= settings.ratio * F.col("weight")))
    pairs = pairs.select(*by, "a", "b", "weight", "more").distinct().withColumn("distance", distance("a", "b"))
    size = F.greatest(F.length("a"), F.length("b"))
    return pairs.where(F.col("distance") <= F.when(size < 3, F.lit(0)).when(size < 5, F.lit(1)).otherwise(F.lit(k)))


def spellings(rows: DataFrame) -> DataFrame:
    """(case_id, name, kind, tokens, initials, line, facts) of distinct spellings; facts: numbers and e-mails beside them.

    rows: case_id, name, number, email. Placeholders, relation words, numbers and blanks are left out.
    """
    of = F.pandas_udf(
        lambda s: pd.DataFrame([parse(x) for x in s], columns=["kind", "tokens", "initials", "line"]),
        "kind string, tokens array<string>, initials array<string>, line string")
    facts = F.array_compact(F.array(F.concat(F.lit("n"), F.col("number")), F.concat(F.lit("e"), F.lower(F.trim("email")))))
    one = rows.where(F.col("name").isNotNull() & F.col("case_id").isNotNull())
    one = one.select("case_id", "name", F.explode_outer(facts).alias("fact")).distinct()
    one = one.groupBy("case_id", "name").agg(F.collect_set("fact").alias("facts"))
    return one.withColumn("p", of("name")).select("case_id", "name", "p.*", "facts").where("kind <> ''")


def canonical_tokens(known: DataFrame, formal: DataFrame, settings: Settings) -> DataFrame:
    """(kind, token, right) of tokens that are taken as misspellings of a much more frequent one near them; listed
    nicknames stand as they are."""
    counts = known.select("kind", "case_id", F.explode("tokens").alias("token")).distinct()
    counts = counts.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n"))
    free = counts.join(formal.select("token").distinct(), "token", "left_anti")
    pairs = near_pairs(
        free.select("kind", F.col("token").alias("a"), F.col("n").alias("weight")),
        counts.select("kind", F.col("token").alias("b"), F.col("n").alias("more")), ["kind"], settings)
    best = pairs.groupBy("kind", "a").agg(F.min_by("b", F.struct("distance", -F.col("more"), "b")).alias("right"))
    return best.select("kind", F.col("a").alias("token"), "right")


def _email_tokens(facts: list[str]) -> list[list[str]]:
    out = []
    for f in facts:
        if f[:1] == "e" and "@" in f:
            local = re.sub(r"\+.*", "", f[1:].split("@")[0])
            own = [plain(t) for t in re.findall(r"[^\W\d_]+", local) if len(t) > 1]
            if len(own) == 2:
                out.append(own)
    return out


def resolve_alone(kind: str, tokens: list[str], initials: list[str], line: str, facts: list[str]) -> str:
    """Entity key of a spelling that needs no other one; '' if it does. An e-mail completes a single token it holds."""
    if kind == "org":
        return f"o:{tokens[0]}:{line}"
    if len(tokens) >= 2:
        return "p:" + " ".join(sorted(tokens[:1] + tokens[-1:]))
    for own in _email_tokens(facts):
        if tokens[0] in own:
            return "p:" + " ".join(sorted(own))
        if initials and any(banded(tokens[0], t, 2) <= 2 for t in own):
            rest = [t for t in own if banded(tokens[0], t, 2) > 2]
            if rest and rest[0][0] in initials:
                return "p:" + " ".join(sorted(own))
    return ""


def link(rows: DataFrame, nicknames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(case_id, name, entity) of every spelling that names a person or organisation; entity is null where it stays open.

    rows: case_id, name, number, email (any may be null); nicknames: formal_name, nickname.
    """
    known = cut(spellings(rows))
    formal = nicknames.select(F.lower(F.trim("formal_name")).alias("formal"), F.lower(F.trim("nickname")).alias("token")).distinct()
    fixes = cut(canonical_tokens(known, formal, settings))
    long = known.select("case_id", "name", "kind", F.posexplode("tokens").alias("at", "token"))
    long = long.join(fixes, ["kind", "token"], "left").withColumn("token", F.coalesce("right", "token"))
    # a token that is two known ones run together is split
    seen = long.where("kind = 'person'").groupBy("token").agg(F.countDistinct("case_id").alias("n"))
    cuts = F.filter(F.sequence(F.lit(3), F.length("token") - 3), lambda i: i > 0)
    parts = seen.where(F.length("token") >= 7).select("token", "n", F.explode(cuts).alias("i"))
    parts = parts.select("token", "n", F.expr("substring(token, 1, i)").alias("x"), F.expr("substring(token, i + 1)").alias("y"))
    parts = parts.join(seen.select(F.col("token").alias("x"), F.col("n").alias("nx")), "x").join(seen.select(F.col("token").alias("y"), F.col("n").alias("ny")), "y")
    parts = parts.where(F.least("nx", "ny") >= settings.ratio * F.col("n")).groupBy("token").agg(F.max_by(F.array("x", "y"), F.struct(F.least("nx", "ny"), "x")).alias("two"))
    long = long.join(parts, "token", "left").withColumn("two", F.when(F.col("kind") == "person", F.col("two")))
    again = long.groupBy("case_id", "name").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("two", F.array("token")).alias("t")))), lambda s: s["t"])).alias("tokens"))
    alone = F.pandas_udf(lambda k, t, i, ln, f: pd.Series([resolve_alone(a, list(b), list(c), d, list(e)) for a, b, c, d, e in zip(k, t, i, ln, f)], dtype="object"), "string")
    full = known.drop("tokens").join(again, ["case_id", "name"])
    full = full.withColumn("e", alone("kind", "tokens", "initials", "line", "facts"))
    full = cut(full.withColumn("entity", F.expr("nullif(e, '')")).drop("e"))

    # entities of one case whose whole names are near: the rarer spelling goes to the more frequent one
    names = full.where("entity is not null").groupBy("case_id", "entity").agg(F.sum(F.size("facts") + 1).alias("n"), F.first("kind").alias("kind"))
    rare = names.join(_token_counts(full), "entity", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    near = near_pairs(
        rare.where("not common").select("case_id", F.col("entity").alias("a"), F.lit(0.0).alias("weight")),
        rare.select("case_id", F.col("entity").alias("b"), (F.col("n") + F.when(F.col("common"), 1000).otherwise(0)).alias("more")), ["case_id"], settings)
    own = rare.select("case_id", F.col("entity").alias("a"), F.col("n").alias("own"), F.col("common").alias("own_common"))
    near = near.join(own, ["case_id", "a"]).where(F.struct("more", "b") > F.struct(F.col("own").alias("more"), F.col("a").alias("b")))
    moved = near.groupBy("case_id", "a").agg(F.max_by("b", F.struct(-F.col("distance"), "more", "b")).alias("to"))
    full = full.join(moved.withColumnRenamed("a", "entity"), ["case_id", "entity"], "left").withColumn("entity", F.coalesce("to", "entity")).drop("to")
    full = cut(full.withColumn("key", F.col("entity")))
    formal_of = formal_entities(full, formal, settings)
    full = cut(full.join(formal_of, ["case_id", "entity"], "left").withColumn("entity", F.coalesce("to", "entity")).drop("to"))

    # open spellings: nicknames and single tokens need a shared number or e-mail, initials one fitting entity
    done = full.where("entity is not null and kind = 'person'")
    words = done.select("case_id", "entity", "facts", F.explode(F.split(F.expr("substring(key, 3)"), " ")).alias("token"))
    open_ = full.where("entity is null and kind = 'person'").select("case_id", "name", "initials", "facts", F.element_at("tokens", 1).alias("token"))
    ways = open_.unionByName(open_.join(formal, "token").withColumn("token", F.col("formal")).drop("formal"))
    by_fact = words.select("case_id", "entity", "token", F.explode("facts").alias("fact")).distinct()
    proof = ways.select("case_id", "name", "initials", "token", F.explode("facts").alias("fact"))
    sure = proof.join(by_fact, ["case_id", "fact", "token"]).select("case_id", "name", "entity", F.lit(3).alias("w"))
    # an unlisted nickname: same number or e-mail and the same first three, or two, letters as a token of the entity
    loose = proof.withColumn("head", F.substring("token", 1, 2)).drop("token").join(by_fact.withColumn("head", F.substring("token", 1, 2)), ["case_id", "fact", "head"])
    loose = loose.select("case_id", "name", "entity", F.lit(2).alias("w"))
    fits = ways.where(F.size("initials") > 0).select("case_id", "name", "token", F.explode("initials").alias("initial"))
    other = done.select("case_id", "entity", F.split(F.expr("substring(key, 3)"), " ").alias("t")).distinct()
    other = other.select("case_id", "entity", F.explode(F.array(
        F.struct(F.get("t", F.lit(0)).alias("token"), F.substring(F.get("t", F.lit(1)), 1, 1).alias("initial")),
        F.struct(F.get("t", F.lit(1)).alias("token"), F.substring(F.get("t", F.lit(0)), 1, 1).alias("initial")))).alias("k")).select("case_id", "entity", "k.*")
    fits = fits.join(other, ["case_id", "token", "initial"]).select("case_id", "name", "entity").distinct()
    alone_fit = fits.groupBy("case_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity")).where("n = 1")
    alone_fit = alone_fit.select("case_id", "name", "entity", F.lit(1).alias("w"))
    best = sure.unionByName(loose).unionByName(alone_fit).groupBy("case_id", "name", "entity").agg(F.sum("w").alias("w"))
    best = best.groupBy("case_id", "name").agg(F.max_by("entity", F.struct("w", "entity")).alias("found"))
    # single tokens without a full name beside them are one entity with others of the same token and number
    rest = full.join(best, ["case_id", "name"], "left").withColumn("entity", F.coalesce("entity", "found")).drop("found")
    lone = F.when(F.col("kind") == "person", F.concat(F.lit("s:"), F.element_at("tokens", 1), F.lit(" "), F.array_join(F.array_sort("initials"), ""), F.lit(" "), F.coalesce(F.array_min("facts"), F.lit("?"))))
    return rest.select("case_id", "name", F.coalesce("entity", lone).alias("entity"))


def formal_entities(full: DataFrame, formal: DataFrame, settings: Settings) -> DataFrame:
    """(case_id, entity, to): persons written with a nickname and another token, and the entity of the case they belong to.

    A listed nickname leads to the key with its formal name, if the case has that entity or another nickname of it. Where several
    formal names fit, a shared number or e-mail decides; else it stays open. An unlisted one leads to a token `ratio` times more
    frequent over all cases, beside the same other token, that shares a number or e-mail with it and begins with the same letter
    or has two letters in a row in common.
    """
    keys = full.where("kind = 'person' and entity is not null")
    keys = keys.groupBy("case_id", "entity").agg(F.array_distinct(F.flatten(F.collect_list("facts"))).alias("facts"))
    keys = keys.withColumn("t", F.split(F.expr("substring(entity, 3)"), " ")).where("size(t) = 2")
    sides = F.array(*(F.struct(F.get("t", F.lit(i)).alias("token"), F.get("t", F.lit(1 - i)).alias("other")) for i in (0, 1)))
    own = cut(keys.select("case_id", "entity", "facts", F.explode(sides).alias("s")).select("case_id", "entity", "facts", "s.*"))

    made = F.concat(F.lit("p:"), F.array_join(F.array_sort(F.array("formal", "other")), " "))
    asked = own.join(formal, "token").where("formal <> token").select("case_id", "entity", "facts", made.alias("to"))
    there = keys.select("case_id", F.col("entity").alias("to"), F.col("facts").alias("had"))
    siblings = asked.groupBy("case_id", "to").agg(F.countDistinct("entity").alias("n"))
    listed = asked.join(there, ["case_id", "to"], "left").join(siblings, ["case_id", "to"]).where("had is not null or n > 1")
    listed = listed.select("case_id", "entity", "to", F.coalesce(F.size(F.array_intersect("facts", "had")), F.lit(0)).alias("shared"))
    ways = listed.groupBy("case_id", "entity").agg(F.count(F.lit(1)).alias("ways"), F.max("shared").alias("most"))
    listed = listed.join(ways, ["case_id", "entity"]).where("ways = 1 or (most > 0 and shared = most)")
    listed = listed.select("case_id", "entity", "to", F.lit(True).alias("listed"), "shared")

    counts = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = own.join(counts, "token").select("case_id", "entity", "token", "other", "n", F.explode("facts").alias("fact"))
    more = seen.select("case_id", "other", "fact", F.col("entity").alias("to"), F.col("token").alias("right"), F.col("n").alias("more"))
    pairs = seen.join(more, ["case_id", "other", "fact"]).where((F.col("token") != F.col("right")) & (F.col("more") >= settings.ratio * F.col("n")))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, 2))
    like = (F.substring("token", 1, 1) == F.substring("right", 1, 1)) | F.arrays_overlap(grams(F.col("token")), grams(F.col("right")))
    pairs = pairs.groupBy("case_id", "entity", "to", "token", "right").agg(F.count(F.lit(1)).alias("shared")).where(like)
    both = listed.unionByName(pairs.select("case_id", "entity", "to", F.lit(False).alias("listed"), "shared"))
    best = cut(both.groupBy("case_id", "entity").agg(F.max_by("to", F.struct("listed", "shared", "to")).alias("to")))
    # an unlisted form of a listed nickname goes on to the formal name
    on = best.select("case_id", F.col("entity").alias("to"), F.col("to").alias("next"))
    return best.join(on, ["case_id", "to"], "left").select("case_id", "entity", F.coalesce("next", "to").alias("to"))


def _token_counts(full: DataFrame) -> DataFrame:
    """(entity, common): whether all tokens of an entity's key occur in several entities, each case counted by itself."""
    keys = full.where("entity is not null").select("case_id", "entity").distinct()
    words = keys.select("entity", F.explode(F.split("entity", "[: ]")).alias("token")).where(F.length("token") > 1)
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.distinct().join(counts, "token").groupBy("entity").agg((F.min("n") >= 4).alias("common"))


def name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of contacts and call logs with the number and e-mail beside them."""
    contacts = table(spark, sf_dir, "contacts").select("case_id", "name", with_country(F.col("phone_raw")).alias("number"), "email")
    logs = table(spark, sf_dir, "call_logs")
    sides = [
        logs.select("case_id", F.col(f"{x}_name").alias("name"), with_country(F.col(x)).alias("number"), F.lit(None).cast("string").alias("email"))
        for x in ("caller", "callee")
    ]
    return contacts.unionByName(sides[0]).unionByName(sides[1])


def p3_members(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Every stored spelling of a case that names a person or organisation, with the entity it belongs to (null where it stays open)."""
    return link(name_rows(spark, sf_dir), table(spark, sf_dir, "nicknames"), settings)


def p3_found(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Pairs of different stored spellings of one person or organisation within a case."""
    one = cut(p3_members(spark, sf_dir, settings).where("entity is not null"))
    a, b = one.withColumnRenamed("name", "name_a"), one.withColumnRenamed("name", "name_b")
    return a.join(b, ["case_id", "entity"]).where("name_a < name_b").select("case_id", "name_a", "name_b").distinct()
