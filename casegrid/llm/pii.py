"""Personal data in free text (problem 2): found by bootstrapped contextual extraction, replaced by typed placeholders.

Seeds are the names in contacts and call logs and the numbers beside them, and values whose shape leaves no doubt (plain e-mails,
addresses with a word such as Flat or Plot, grouped identity numbers, numbers with `+`). Where seeds occur, the words around them give
lexical patterns: one word to the left with two to the right, or three to the right alone. Patterns and the instances they extract,
seeds or not, form a graph whose scores are iterated in Spark: a pattern is as good as the share of its instances that are trusted,
an instance as good as the patterns that extract it. Good patterns then give names, numbers, identity numbers, disguised e-mails and
addresses that begin with a bare number, which no seed lists; contexts in which no trusted value ever occurs (orders, payments, tickets)
give none.

Seed tokens and patterns are sent to all tasks only if there are at most `Settings.broadcast_rows` of them, which is checked; beyond that
each text gets those that occur in it by a join on the token and on the pattern, with the same result. Counts are over all texts.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.session import cut, table


@dataclass(frozen=True)
class Settings:
    """broadcast_rows: most seed tokens, or patterns, sent to every task; support: seeds a pattern needs; accept: least score of a pattern."""

    broadcast_rows: int = 200_000
    support: int = 3
    accept: float = 0.35
    rounds: int = 3


# Forms of address and words that begin or end an address.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "adv", "shri", "sri", "smt", "sr", "sra", "srta", "herr", "frau", "mme", "mlle", "m", "er", "capt", "श्री", "श्रीमती", "డాక్టర్", "ডাঃ"}
PARTICLES = {"de", "del", "da", "do", "dos", "das", "la", "el", "al", "bin", "von", "van", "der", "e", "y"}
STREETS = "road|street|lane|drive|avenue|crescent|terrace|marg|nagar|colony|sector|bagh|gali|rasta|path|chowk|close|court|place|square|way|row|hill|boulevard|layout|enclave|vihar|salai|rd|st|ave"

_TOKEN = re.compile(r"\S+")
_EDGE = re.compile(r"^[^\w@#+]+|[^\w]+$")
_EMAIL = re.compile(
    r"(?<![\w/.@:+-])[\w][\w.+-]*\s?(?:@|\(at\)|\[at\]|\{at\}|\s\(at\)\s|\s\[at\]\s)\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[\w-]+)+", re.I)
_PLAIN_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_D = r"[0-9०-९০-৯౦-౯]"
_LIKE = r"[0-9OoIl०-९০-৯౦-౯]"
_LICENCE = re.compile(r"(?<![\w])[A-Za-z]{2}[- ]?[0-9OoIl]{2}[- ]?[0-9OoIl]{11}(?!\w)")
_LETTERED = re.compile(r"(?<![\w@#./_-])(?:[A-Za-z]{5}[0-9OoIl]{4}[A-Za-z]|[A-Za-z]{1,2}[0-9OoIl]{7})(?![\w@]|[-/_]\w)")
_NUMBER = re.compile(rf"(?<![\w@#./_,:-])(?:\(?\+\s?|\(|00)?(?:{_D}|[OoIl](?={_D}))(?:[\s().-]{{0,3}}{_LIKE}){{5,16}}(?![\w@/_]|[.,:]{_D}|-\w)")
_ADDRESS = re.compile(
    rf"(?<![\w/.-])(?:(?:flat|plot|house|h\.?\s*no|door|shop|room|unit|apartment|apt|quarter|block)\b[\s.:#]*(?:no\b\.?\s*)?[0-9OoIl]+[\w/-]*|[0-9]{{1,4}}(?:[/-][0-9]{{1,4}}){{0,2}}[A-Za-z]?)"
    rf"(?=(?:[\s,]+(?!(?:{STREETS})\b)[\w.'’]+){{0,8}}?[\s,]+(?:(?:{STREETS})\b))", re.I)  # fmt: skip
_STEP = re.compile(r"[^\s,]+")
_STREET = re.compile(rf"(?:[\s,]+[\w.'’-]+){{0,8}}?[\s,]+(?:{STREETS})\b", re.I)
#: What may follow a street: a landmark, the place and its postal code.
_PLACE = re.compile(r"(?:\s*,\s*(?:near\s+\w+\s+\w+|[^\W\d_]+(?:\s+\d+)?)(?:\s*-?\s*(?:\d{4,6}|[A-Z]{2}\d+\s\d[A-Z]{2}))?){1,3}", re.I)
_MORE = re.compile(rf"(?:[ \t\n]+(?:(?:{STREETS})\b|\d{{1,3}}\b(?=\s*,)))+", re.I)
_NUM_ONLY = re.compile(r"[0-9]{1,4}(?:[/-][0-9]{1,4}){0,2}[A-Za-z]?$")


@functools.lru_cache(maxsize=200_000)
def norm(token: str) -> str:
    """A token in lower case without punctuation around it; runs of digits as one mark."""
    t = _EDGE.sub("", token).lower()
    return re.sub(r"\d+", "9", t)


def value_of(text: str) -> str:
    """Letters and digits of a span, lower-cased, the first twelve."""
    return "".join(c for c in text if c.isalnum()).lower()[:12]


def _digits(s: str) -> str:
    """Digits of a number, whatever their script; characters misread for digits count as digits."""
    out = []
    for c in s:
        if c.isdigit():
            out.append(str(int(c)) if c.isdecimal() else "")
        elif c in "OoIl":
            out.append("0" if c in "Oo" else "1")
    return "".join(out)


def number_kind(span: str) -> tuple[str, bool]:
    """(phone, id_number or '', whether the shape alone settles it) of a span that holds a number."""
    s, d = span.strip(), _digits(span)
    n = len(d)
    groups = [len(g) for g in re.split(r"[\s().+-]+", s) if g]
    if s.startswith(("+", "(+")):
        return ("phone", True) if 8 <= n <= 15 else ("", False)
    if groups == [4, 4, 4] or (groups == [3, 2, 4] and "-" in s):
        return "id_number", True
    if n == 12 and len(groups) == 1:
        phone = (d.startswith("91") and d[2] in "6789") or d.startswith(("447", "9715", "0091"))
        return ("phone", False) if phone else ("id_number", False)
    if n == 9:
        return "id_number", False
    if d.startswith("00") and 11 <= n <= 16:
        return "phone", len(groups) > 1
    if n == 10 or (n == 11 and d[0] in "01") or (n in (12, 13) and len(groups) > 1):
        return "phone", False
    return "", False


def spans(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, type, text, sure) of e-mails, addresses, identity numbers and phones by shape, none overlapping."""
    out: list[tuple[int, int, str, str, bool]] = []
    free = [True] * len(text)

    def take(a: int, b: int, kind: str, sure: bool) -> None:
        if all(free[a:b]):
            free[a:b] = [False] * (b - a)
            out.append((a, b, kind, text[a:b], sure))

    if "@" in text or "at" in text or "AT" in text:
        for m in _EMAIL.finditer(text):
            if "//" not in text[max(0, m.start() - 30) : m.start()].split(" ")[-1]:
                take(m.start(), m.end(), "email", bool(_PLAIN_EMAIL.fullmatch(m.group())))
    if not any(map(str.isdigit, text)):
        return out
    for m in _ADDRESS.finditer(text):
        bare = bool(_NUM_ONLY.match(m.group()))
        if bare:  # a bare number must be followed by the street's name at once
            words = [w.group() for w in islice(_STEP.finditer(text, m.end()), 6)]
            streets = [k for k, w in enumerate(words) if re.fullmatch(STREETS, w.strip(".").lower())]
            if not streets or streets[0] == 0 or any(not (w[0].isalpha() or re.match(r"\d+(?:st|nd|rd|th)$", w, re.I)) for w in words[: streets[0]]):
                continue
            if text[m.end() : m.end() + 1] not in set(" ,\n\r\t") or streets[0] > 4:
                continue
        tail = _STREET.match(text, m.end())
        end = tail.end() if tail else m.end()
        if more := _MORE.match(text, end):
            end = more.end()
        if place := _PLACE.match(text, end):
            end = place.end()
        if all(free[m.start() : m.end()]):
            take(m.start(), end if all(free[m.start() : end]) else m.end(), "address", not bare)
    for m in _LICENCE.finditer(text):
        take(m.start(), m.end(), "id_number", True)
    for m in _LETTERED.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 3:
            take(m.start(), m.end(), "id_number", len(m.group()) == 10)
    for m in _NUMBER.finditer(text):
        kind, sure = number_kind(m.group())
        if kind and sum(c.isdigit() for c in m.group()) >= 6:
            a = m.start()
            if m.group().startswith("(") and not m.group().startswith("(+") and ")" not in m.group():
                a += 1
            take(a, m.end(), kind, sure)
    return out


def _tokens(text: str) -> tuple[list[tuple[int, int]], list[str]]:
    at = [m.span() for m in _TOKEN.finditer(text)]
    return at, [norm(text[a:b]) for a, b in at]


def contexts(words: list[str], i: int, j: int) -> tuple[str, str]:
    """The two patterns around tokens i..j-1: one word to the left and two to the right; three to the right."""
    left = words[i - 1] if i else "^"
    right = words[j : j + 3]
    right += ["$"] * (3 - len(right))
    return f"{left} _ {right[0]} {right[1]}", f"* _ {right[0]} {right[1]} {right[2]}"


def _left_only(words: list[str], i: int) -> str:
    return " ".join(["^", "^", *words[:i]][-2:]) + " _ *"


def _name_token(token: str) -> bool:
    t = token.strip(".,;:!?()[]\"'“”")
    return bool(t) and all(c.isalpha() or c in "'’-." for c in t) or (bool(t) and not any(c.isdigit() or c in "@/_#" for c in t) and any(c.isalpha() for c in t))


def _goes_on(token: str, word: str, place: int) -> bool:
    """Whether a token may be the one at a place of a name; from the fifth on it must have a capital or be a particle."""
    return _name_token(token) and (place <= 4 or token[0].isupper() or word in PARTICLES)


def seed_edges(text: str, lexicon: frozenset) -> list[tuple[str, str]]:
    """(pattern, instance) of runs of seed tokens; initials and titles may stand before them."""
    at, words = _tokens(text)
    out, i, n = [], 0, len(words)
    while i < n:
        if words[i] not in lexicon:
            i += 1
            continue
        j = i + 1
        while j < n and words[j] in lexicon and text[at[j - 1][1] - 1] not in ",;:!?)":
            j += 1
        k = i
        while k and i - k < 2 and (len(words[k - 1]) == 1 and words[k - 1].isalpha() and text[at[k - 1][1] - 1] == "." or words[k - 1] in TITLES):
            k -= 1
        a, b = contexts(words, k, j)
        value = " ".join(words[i:j])
        out += [(a, value), (b, value)]
        i = j
    return out


def context_words(patterns: dict[str, frozenset], lexicon: frozenset) -> frozenset:
    """Words of the patterns themselves, which begin no name."""
    return frozenset(w for k, v in patterns.items() for side in (k, *v) for w in side.split()) - lexicon


def extract(text: str, patterns: dict[str, frozenset], lexicon: frozenset, stop: frozenset = frozenset()) -> list[tuple[str, str, str, str, str, bool]]:
    """(type, span as written, pattern, other pattern, instance, sure) found in a text.

    patterns: left word (or '*') to the right sides that complete a pattern for names.
    """
    found = spans(text)
    at, words = _tokens(text)
    n = len(words)
    out = []
    busy = [False] * n
    k = 0
    for a, b, kind, raw, sure in sorted(found):
        while k < n and at[k][1] <= a:
            k += 1
        j = k
        while j < n and at[j][0] < b:
            busy[j] = True
            j += 1
        x, y = contexts(words, k, j)
        out.append((kind, raw, x, y if k == 0 else _left_only(words, k), value_of(raw), sure))
    by_left = patterns
    i = 0
    while i < n:
        sides = by_left.get(words[i - 1] if i else "^")
        hit = 0
        if sides and not busy[i]:
            for j in range(i + 1, n + 1):
                if busy[j - 1] or not _goes_on(text[at[j - 1][0] : at[j - 1][1]], words[j - 1], j - i):
                    break
                right = f"{words[j] if j < n else '$'} {words[j + 1] if j + 1 < n else '$'}"
                if right in sides:
                    hit = j
                    break
                if text[at[j - 1][1] - 1] in ",;:!?" :
                    break
        if hit:
            while i < hit - 1 and words[i] in stop:
                i += 1
            name = _name(text, at, words, i, hit)
            if name:
                x, y = contexts(words, i, hit)
                out.append(("name", name, x, y, " ".join(words[i:hit]), False))
            i = hit
            continue
        i += 1
    right_only = by_left.get("*")
    if right_only:
        for j in range(1, n - 1):
            if busy[j - 1]:
                continue
            right = f"{words[j]} {words[j + 1]} {words[j + 2] if j + 2 < n else '$'}"
            if right in right_only:
                i = j
                while i and not busy[i - 1] and (words[i - 1] in lexicon or (len(words[i - 1]) == 1 and words[i - 1].isalpha() and j - i > 0)):
                    if i < j and text[at[i - 1][1] - 1] in ",;:!?)" :
                        break
                    i -= 1
                if i == j and text[at[j - 1][0]].isupper() and _name_token(text[at[j - 1][0] : at[j - 1][1]]):
                    i = j - 1
                name = _name(text, at, words, i, j) if i < j else ""
                if name:
                    x, y = contexts(words, i, j)
                    out.append(("name", name, y, x, " ".join(words[i:j]), False))
    return out


def _name(text: str, at: list, words: list[str], i: int, j: int) -> str:
    """Span of a name as written, without titles before it."""
    while i < j and (words[i] in TITLES and len(words[i]) > 1 or not words[i]):
        i += 1
    while j > i and not words[j - 1]:
        j -= 1
    if i >= j:
        return ""
    return text[at[i][0] : at[j - 1][1]].strip(" .,;:!?()[]\"'“”")


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, text) of messages.text and media.ocr_text, without nulls and blanks."""
    a = table(spark, sf_dir, "messages").select(F.lit("messages").alias("source_table"), F.col("msg_id").alias("record_id"), "text")
    b = table(spark, sf_dir, "media").select(F.lit("media").alias("source_table"), F.col("media_id").alias("record_id"), F.col("ocr_text").alias("text"))
    return a.unionByName(b).where(F.length(F.trim("text")) > 0)


def seed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of names of persons (column token); organisations' names are left out."""
    contacts = table(spark, sf_dir, "contacts").select("name")
    logs = table(spark, sf_dir, "call_logs")
    rows = contacts.unionByName(logs.select(F.col("caller_name").alias("name"))).unionByName(logs.select(F.col("callee_name").alias("name")))
    firm = r"(?i)\bm/s\b|\b(ltd|limited|inc|incorporated|pvt|sons|motors|mtrs|enterprises|entp|services|svcs|stores?|company|trading|trdg|logistics|travels|trvls|electronics|elec|finance|courier|log|fin|med)\b"
    rows = rows.where(~F.col("name").rlike(firm)).distinct().select(F.regexp_replace("name", r"(\p{Ll})(\p{Lu})", "$1 $2").alias("name"))
    tokens = rows.select(F.explode(F.split(F.lower("name"), r"[^\p{L}'’]+")).alias("token")).where(F.length("token") > 2)
    common = "unknown|private|number|withheld|spam|owner|name|office|new|bank|bhai|sir|the|home|work|mobile|and|adv|prof|mrs|shri|smt"
    return tokens.where(~F.col("token").rlike(f"^({common})$")).distinct()


_KEY = ["source_table", "record_id"]


def with_own(texts: DataFrame, values: DataFrame, made, name: str) -> DataFrame:
    """Texts with an array `name` of those of `values` (column v) that `made`, a function of a text, gives for them: by a join on the value."""
    of = F.pandas_udf(lambda s: s.map(lambda t: sorted(set(made(t)))), "array<string>")
    here = texts.select(*_KEY, F.explode(of("text")).alias("v")).distinct().join(values.select("v").distinct(), "v")
    return texts.join(here.groupBy(*_KEY).agg(F.collect_set("v").alias(name)), _KEY, "left")


def text_patterns(text: str) -> Iterator[str]:
    """All patterns that a text could hold a name of."""
    at, words = _tokens(text)
    n, right = len(words), [*words, "$", "$", "$"]
    for i in range(n):
        left = words[i - 1] if i else "^"
        yield f"* _ {right[i + 1]} {right[i + 2]} {right[i + 3]}"
        for j in range(i + 1, n + 1):
            if not _goes_on(text[at[j - 1][0] : at[j - 1][1]], words[j - 1], j - i):
                break
            yield f"{left} _ {right[j]} {right[j + 1]}"


class Model:
    """Seed tokens and patterns as a task needs them: in whole, or, where there are too many to send, those of each text."""

    def __init__(self, tokens: frozenset | None = None, patterns: dict[str, frozenset] | None = None) -> None:
        self.tokens, self.patterns = tokens, patterns
        self.stop = context_words(patterns, tokens) if tokens is not None and patterns is not None else None

    def of(self, row) -> tuple[frozenset, dict[str, frozenset], frozenset]:
        """(seed tokens, patterns, words that begin no name) for a row of texts."""
        have = lambda name: [] if getattr(row, name, None) is None else list(getattr(row, name))
        tokens = self.tokens if self.tokens is not None else frozenset(have("own_tokens"))
        patterns = self.patterns if self.patterns is not None else by_left(have("own_patterns"))
        stop = self.stop if self.stop is not None else frozenset(have("own_stops")) - tokens
        return tokens, patterns, stop


def by_left(patterns: list[str]) -> dict[str, frozenset]:
    """Patterns as left word (or '*') to right sides."""
    out: dict[str, set] = {}
    for p in patterns:
        left, _, right = p.partition(" _ ")
        out.setdefault(left, set()).add(right)
    return {k: frozenset(v) for k, v in out.items()}


def _grouped(pairs: Iterator[tuple[str, str]]) -> list[tuple[str, str, int]]:
    return [(p, v, n) for (p, v), n in Counter(pairs).items()]


def name_patterns(texts: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """Patterns (column v) that hold enough different seeds. Counted over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = _grouped(e for r in f.itertuples(index=False) for e in seed_edges(r.text, shared.value.of(r)[0]))
            yield pd.DataFrame(rows, columns=["pattern", "instance", "n"])

    edges = texts.mapInPandas(run, "pattern string, instance string, n long")
    seen = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("seeds"))
    return seen.where(F.col("seeds") >= settings.support).select(F.col("pattern").alias("v"))


_FOUND = "source_table string, record_id string, kind string, raw string, pattern string, other string, instance string, sure boolean, seed boolean"


def extractions(texts: DataFrame, model: Model) -> DataFrame:
    """All candidates of all texts, with their patterns and whether they are trusted as seeds."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                lex, pats, stop = shared.value.of(r)
                for kind, raw, x, y, instance, sure in extract(r.text, pats, lex, stop):
                    seed = sure if kind != "name" else all(w in lex or len(w) == 1 or w in TITLES for w in instance.split()) and any(w in lex for w in instance.split())
                    out.append((r.source_table, r.record_id, kind, raw, x, y, instance, sure, seed))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return texts.mapInPandas(run, _FOUND)


def _graph_kind() -> Column:
    return F.when(F.col("kind").isin("phone", "id_number"), "number").otherwise(F.col("kind"))


def score_patterns(found: DataFrame, settings: Settings) -> DataFrame:
    """(kind, pattern, score): the graph of patterns and instances, scored in rounds.

    A pattern's score is the smoothed mean of its instances' scores; an instance's is 1 if it is a seed, else the chance that
    at least one of its patterns is right, halved. Phones and identity numbers share contexts and are scored together.
    """
    sides = F.explode(F.array("pattern", "other")).alias("pattern")
    edges = found.select(_graph_kind().alias("kind"), sides, "instance", F.col("seed").cast("double").alias("seed"))
    edges = cut(edges.groupBy("kind", "pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    scores = edges.groupBy("kind", "pattern").agg((F.sum("seed") / (F.count(F.lit(1)) + 1)).alias("score"))
    for _ in range(settings.rounds - 1):
        seen = edges.join(scores, ["kind", "pattern"])
        inst = seen.groupBy("kind", "instance").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(0.02)))))).alias("p"))
        inst = inst.select("kind", "instance", F.greatest("seed", F.col("p") / 2).alias("i"))
        scores = cut(edges.join(inst, ["kind", "instance"]).groupBy("kind", "pattern").agg((F.sum("i") / (F.count(F.lit(1)) + 1)).alias("score"), F.count(F.lit(1)).alias("size")).drop("size"))
    return scores


def personal_data(texts: DataFrame, lexicon: DataFrame | frozenset, settings: Settings = Settings()) -> DataFrame:
    """(source_table, record_id, kind, raw) of personal data, texts being (source_table, record_id, text), lexicon the seed tokens.

    Null and empty texts, which must be left out, hold nothing; repeated rows give their values once; other columns are ignored.
    """
    texts = texts.select(*_KEY, "text")
    tokens = lexicon if isinstance(lexicon, frozenset) else None
    if tokens is None:
        lexicon = cut(lexicon.select(F.col("token").alias("v")))
        if lexicon.count() <= settings.broadcast_rows:
            tokens = frozenset(r["v"] for r in lexicon.collect())
        else:
            texts = with_own(texts, lexicon, lambda t: _tokens(t)[1], "own_tokens")
    patterns = cut(name_patterns(texts, Model(tokens), settings))
    known = None
    if patterns.count() <= settings.broadcast_rows:
        known = by_left([r["v"] for r in patterns.collect()])
    else:
        texts = with_own(texts, patterns, text_patterns, "own_patterns")
    if tokens is None or known is None:
        stops = patterns.select(F.explode(F.split(F.regexp_replace("v", " _ ", " "), " ")).alias("v"))
        texts = with_own(texts, stops, lambda t: _tokens(t)[1], "own_stops")
    found = cut(extractions(texts, Model(tokens, known)))
    scores = score_patterns(found, settings).where(F.col("score") >= settings.accept)
    rows = found.withColumn("k", _graph_kind())
    good = scores.select(F.col("kind").alias("k"), "pattern", F.lit(True).alias("good"))
    rows = rows.join(good, ["k", "pattern"], "left")
    rows = rows.join(good.select("k", F.col("pattern").alias("other"), F.col("good").alias("good2")), ["k", "other"], "left")
    trusted = F.coalesce("good", "good2", F.lit(False))
    seeds = (F.col("kind") != "name") & F.col("seed")  # instances of score 1; a name's tokens are common words too, it needs a pattern
    return rows.where(seeds | trusted).select(*_KEY, "kind", "raw").distinct()


def p2_found(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Personal data of messages.text and media.ocr_text."""
    rows = personal_data(texts_of(spark, sf_dir), seed_tokens(spark, sf_dir), settings)
    of = F.pandas_udf(lambda s: s.map(value_of), "string")
    return rows.select("source_table", "record_id", F.col("kind").alias("pii_type"), of("raw").alias("pii_value")).where("pii_value <> ''").distinct()


def redact(text: str, found: list[tuple[str, str]]) -> str:
    """The text with every found (type, span) replaced by a typed placeholder such as [PHONE]; the rest untouched."""
    for kind, raw in sorted(found, key=lambda x: -len(x[1])):
        text = re.sub(rf"(?<!\w){re.escape(raw)}(?!\w)", f"[{kind.upper()}]", text)
    return text


def p2_redacted(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Every message and scan with personal data replaced by placeholders; others as they are."""
    texts = texts_of(spark, sf_dir)
    rows = personal_data(texts, seed_tokens(spark, sf_dir), settings)
    by = rows.groupBy("source_table", "record_id").agg(F.collect_list(F.struct("kind", "raw")).alias("found"))
    of = F.pandas_udf(lambda t, f: pd.Series([redact(a, [(x["kind"], x["raw"]) for x in b] if b is not None else []) for a, b in zip(t, f)]), "string")
    return texts.dropDuplicates(["source_table", "record_id"]).join(by, ["source_table", "record_id"], "left").select("source_table", "record_id", of("text", "found").alias("text"))
