"""Noise in text from scanned pages (problem 5): broken and misread words, running headers, page numbers.

Pass 1 reads each scan by pairs of lines: a line with the lines before and behind it, with its likest other line, and the two lines
at a break. Three classifiers of boosted trees decide on the pairs: whether a line of numbers is a page number, whether a
title-like line is a running header, whether a line's last word goes on in the next line of text. They are fitted on a bounded sample of
pairs that independent evidence settles (a line that interrupts a broken word is furniture; a break whose
whole word stands unbroken in other scans is one), and on pages made by rule, so that few scans need no other way. The trees first see
features other than the evidence, then, with what they settle, all features.

Pass 2 counts all words of all scans. Misread words get candidates through an inverted join on character 2-grams, keyed by their place
from either end of the word; of a word's 2-grams only so many of the rarest are looked up as a candidate must share. What scanners
confuse is a fixed list and what pairs of rare and frequent words of the corpus show. Gradient-boosted trees rank the
candidates and choose the replacement.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.boosting import Boosted
from casegrid.session import cut, table

# What a scanner reads in place of what is printed.
CONFUSIONS = [
    ("m", "rn"), ("d", "cl"), ("n", "ri"), ("w", "vv"), ("h", "b"), ("e", "c"), ("o", "0"), ("i", "1"), ("l", "1"), ("a", "@"),
    ("a", "4"), ("t", "+"), ("g", "9"), ("s", "5"), ("b", "6"), ("z", "2"), ("e", "3"), ("i", "!"), ("l", "|"), ("s", "$"),
    ("u", "ii"), ("h", "li"), ("i", "l"), ("l", "i"), ("b", "8"), ("q", "9"), ("k", "lc"), ("y", "v"), ("f", "t"),
    ("rn", "m"), ("cl", "d"), ("vv", "w"),
]


@dataclass(frozen=True)
class Settings:
    """ratio: how much more frequent the right word must be; least_documents: scans a right word must occur in; shared: 2-grams in
    common, at the same place from either end, per letter; accept: least score of a replacement; learnt: right words that a confusion
    must be seen in; train_words and train_lines bound the training samples of the classifiers."""

    ratio: float = 6.0
    least_documents: int = 5
    shared: float = 0.5
    accept: float = 0.5
    learnt: int = 8
    train_words: int = 3000
    train_lines: int = 6000
    seed: int = 3


_NUMBER = r"(?=[OolI|]*[0-9])[0-9OolI|]++"
#: What a line of numbers looks like, by how plainly it says that it is a page's: a word, of so many, dashes or brackets.
_FORMS = [
    re.compile(rf"(?:page|pagc|p[aeg]ge|pg|p)\s*\.?\s*(?:n[o0]\.?|number)?\s*:?\s*{_NUMBER}(?:\s*(?:of|/|0f)\s*{_NUMBER})?", re.I),
    re.compile(rf"{_NUMBER}\s*(?:of|/)\s*{_NUMBER}", re.I),
    re.compile(rf"[-–—~]\s*{_NUMBER}\s*[-–—~]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)"),
    re.compile(r"[0-9]+"),
]
_TAIL = re.compile(rf"[\s|–—-]*(?:\b(?:page|pagc|pg|p)\s*\.?\s*(?:n[o0]\.?)?\s*{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?|[-–—\[(]\s*{_NUMBER}\s*[-–—\])]|\s{{2,}}{_NUMBER})\s*$", re.I)
_HEAD = re.compile(rf"^\s*(?:(?:page|pagc|pg|p)\s*\.?\s*(?:n[o0]\.?)?\s*{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?|[-–—\[(]\s*{_NUMBER}\s*[-–—\])]|{_NUMBER}\s{{2,}})[\s|–—-]*", re.I)
_BREAK = re.compile(r"([^\W\d_][^\s]*?)[-‐¬­]\s*$")
_FOLDS = [("rn", "m"), ("cl", "d"), ("ri", "n"), ("vv", "w"), ("0", "o"), ("1", "l"), ("i", "l"), ("@", "a"), ("4", "a"), ("+", "t"), ("9", "g"), ("5", "s"), ("c", "e"), ("b", "h")]


def fold(line: str) -> str:
    """Shape of a header line by which its readings agree: no page number, digits masked, like characters as one."""
    s = _HEAD.sub("", _TAIL.sub("", line)).strip().lower()
    s = re.sub(r"\d[\d/.,]*", "#", s) if not re.search(r"[a-z]\d|\d[a-z]", s) else re.sub(r"(?<![a-z])\d[\d/.,]*(?![a-z])", "#", s)
    for a, b in _FOLDS:
        s = s.replace(a, b)
    return re.sub(r"[^a-z#à-ÿ]+", " ", s).strip()


@functools.lru_cache(maxsize=50_000)
def _title_like(line: str) -> bool:
    s = _HEAD.sub("", _TAIL.sub("", line)).strip()
    words = re.findall(r"[^\W\d_]{2,}", s)
    if not words or s[-1] in ".,;:?!" or not s[0].isalnum():
        return False
    big = [w for w in words if len(w) > 3 or w.isupper()]
    return s[0].isupper() | s[0].isdigit() and sum(w[0].isupper() or not w[0].islower() for w in words) >= 0.75 * len(words) and bool(big)


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance within a band of width `most`; most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            x = before.get(j - 1, most + 1) + (a[i - 1] != b[j - 1])
            now[j] = min(x, before.get(j, most + 1) + 1, now.get(j - 1, most + 1) + 1)
        before = now
        if min(before.values(), default=most + 1) > most:
            return most + 1
    return min(before.get(len(b), most + 1), most + 1)


def read_lines(text: str) -> tuple[list[str], list[bool]]:
    """(lines, whether a page break precedes each)."""
    lines, fresh, edge = [], [], True
    for part in re.split(r"(\f|\n)", text.replace("\r\n", "\n").replace("\r", "\n")):
        if part == "\f":
            edge = True
        elif part != "\n" and part.strip():
            lines.append(part)
            fresh.append(edge)
            edge = False
        elif part.strip(" \t") == "" and part != "\n" and lines:
            lines.append("")
            fresh.append(edge)
    return lines, fresh


def _near_number(lines: list[str], marks: list[bool], fresh: list[bool], i: int) -> bool:
    """Whether a line stands at a page's edge: next to a page number or page break."""
    if fresh[i] or _TAIL.search(lines[i]) or _HEAD.search(lines[i]):
        return True
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(lines) and not lines[j].strip():
            j += step
        if not 0 <= j < len(lines) or marks[j] or (step == 1 and fresh[j]):
            return True
    return False


def number_form(line: str) -> int:
    """Which of the forms a line that holds nothing but a page number has, -1 if none."""
    return next((k for k, p in enumerate(_FORMS) if p.fullmatch(line)), -1)


def _clean(token: str) -> str:
    return re.sub(r"^[^\w@+$|!]+|[^\w@+$|]+$", "", token)


_INNER = re.compile(r"@.*\.|://|[._]\w")


@functools.lru_cache(maxsize=200_000)
def _word(token: str) -> tuple[str, bool]:
    """(word in lower case or '', whether it is written as a name) of a token: more than two characters, most of them letters."""
    w = _clean(token)
    if len(w) < 3 or sum(c.isalpha() for c in w) * 2 <= len(w) or _INNER.search(w):
        return "", False
    return w.lower(), w[0].isupper() and not w.isupper()


_SENTENCE_END = re.compile(r"[.!?:;]['\"”’)\]]*\s*$")
_AMOUNT = re.compile(r"(?:amount|total|sum|balance|rs\.?|no\.?|ex\.)\s*$", re.I)
_HYPHENS = "-‐¬\xad"


def scan_pairs(text: str) -> list[tuple]:
    """(kind, a, b, n, named, x) of one scan. page: a line of numbers; line: a title-like one, its shape and how often that occurs there;
    break: the two halves at a line end; word: one in lower case, its uses and those written like a name. x: features of the pair
    of lines, as PAGE, LINE and JOIN name them."""
    lines, fresh = read_lines(text)
    strip = [s.strip() for s in lines]
    live = [i for i, s in enumerate(strip) if s]
    form = {i: k for i in live if (k := number_form(strip[i])) >= 0}
    marks = [i in form for i in range(len(lines))]
    shapes = {i: fold(strip[i]) for i in live if i not in form and _title_like(strip[i])}
    often = Counter(shapes.values())
    likest = {}
    for i, shape in list(shapes.items()):
        likest[i] = float(often[shape] > 1)
        if shape and often[shape] == 1:  # a reading of its own: take the likest shape's
            most = 2 if len(shape) > 8 else 1
            for other in often:
                d = _distance(shape, other, most) if other != shape and often[other] > 1 else most + 1
                if d <= most:
                    shapes[i], likest[i] = other, 1 - d / max(1, len(shape))
                    break
    often = Counter(shapes.values())
    furniture = {i for i in form} | {i for i, s in shapes.items() if often[s] > 1 or _near_number(lines, marks, fresh, i)}
    body = [i for i in live if i not in form and i not in shapes]
    before, behind, last = {}, {}, None
    for i in live:
        before[i] = last
        last = i if i not in form and i not in shapes else last
    last = None
    for i in reversed(live):
        behind[i] = last
        last = i if i not in form and i not in shapes else last
    width = float(np.median([len(strip[i]) for i in body])) if body else 1.0

    def flow(i: int) -> tuple[float, float, float]:
        """Whether the text before a line is unfinished, or broken within a word, and that behind it goes on in a small letter."""
        p, q = before[i], behind[i]
        broken = p is not None and bool(_BREAK.search(lines[p]))
        unfinished = p is not None and (broken or not _SENTENCE_END.search(lines[p]))
        return float(unfinished), float(broken), float(q is not None and strip[q][0].islower()) if q is not None else -1.0

    def blank(i: int, step: int) -> float:
        return float(not 0 <= i + step < len(lines) or not strip[i + step])

    out: list[tuple] = []
    numbers = {i: int(m.group()) for i in form if (m := re.search(r"[0-9]+", strip[i])) and len(m.group()) < 12}
    at = sorted(numbers)
    order, place = {i: k for k, i in enumerate(at)}, {i: k for k, i in enumerate(live)}
    for i, k in form.items():
        j = order.get(i, -1)
        near = [numbers[x] for x in at[max(0, j - 1) : j] + at[j + 1 : j + 2]] if j >= 0 else []
        p = live[place[i] - 1] if place[i] else None
        unfinished, broken, lower = flow(i)
        out.append(("page", strip[i], "", 1, 0, [
            float(sum(c.isdigit() for c in strip[i])), float(fresh[i]), float(i == live[-1] or fresh[i + 1] if i + 1 < len(lines) else True), float(lines[i][:1] in " \t"),
            float(any(y in shapes for y in (i - 1, i + 1))), blank(i, -1), blank(i, 1), min(2.0, len(strip[p]) / width) if p is not None else 0.0, float(len(form)),
            float(k), float(any(abs(m - numbers[i]) == 1 for m in near)), float(p is not None and bool(_AMOUNT.search(strip[p]))), unfinished, broken, lower]))
    for i, shape in shapes.items():
        if shape:
            words = re.findall(r"[^\W\d_]+", strip[i])
            out.append(("line", strip[i], shape, often[shape], 0, [
                float(_near_number(lines, marks, fresh, i)), float(often[shape]), likest[i], sum(w.isupper() for w in words) / max(1, len(words)), min(3.0, len(strip[i]) / width),
                float(any(c.isdigit() for c in strip[i])), blank(i, -1), blank(i, 1), *flow(i)]))
    joined: dict[int, int] = {}
    breaks = [i for i in live if i not in furniture and _BREAK.search(lines[i])]
    for i in breaks:
        k = place[i] + 1
        while k < len(live) and (live[k] in form or live[k] in shapes):
            k += 1
        if k == len(live):
            continue
        j, skipped = live[k], live[place[i] + 1 : k]
        tail, right = lines[i].rstrip(" \t"), strip[j].split()[0]
        left = _clean(_BREAK.search(lines[i]).group(1).split()[-1])
        if "@" in left[1:-1] or sum(c.isalpha() for c in left) * 2 < len(left) or not left:
            continue
        out.append(("break", left.lower(), _clean(right).lower(), 1, 0, [
            float(_HYPHENS.find(tail[-1])), float(tail != lines[i]), min(2.0, len(strip[i]) / width), float(right[0].islower()), float(right[0].isupper()),
            float(len(left)), float(len(right)), float(sum(x in form for x in skipped)), float(sum(x in shapes for x in skipped)), len(breaks) / len(live),
            float(i in shapes), float(left[:1].isupper()), float(j - i)]))
        joined[i], joined[j] = joined.get(i, 0) | 1, joined.get(j, 0) | 2
    uses: dict[str, list[int]] = {}
    for i in live:
        if i in furniture:
            continue
        tokens = strip[i].split()
        tokens = tokens[1 if joined.get(i, 0) & 2 else 0 : len(tokens) - (1 if joined.get(i, 0) & 1 else 0)]
        start = True
        for t in tokens:
            w, named = _word(t)
            if w:
                n = uses.setdefault(w, [0, 0])
                n[0] += 1
                n[1] += named and not start
            start = t[-1] in ".?!:"
    return out + [("word", w, "", n, named, None) for w, (n, named) in uses.items()]


#: Features of the three kinds of pairs. Those from `view` on are the evidence that labels come from, and are seen in the second fit only.
PAGE = ["digits", "page_begins", "page_ends", "indented", "beside_title", "blank_before", "blank_behind", "line_before", "numbers", "form", "in_sequence", "after_amount", "unfinished", "broken", "goes_on"]
LINE = ["at_edge", "often", "likest", "capitals", "length", "has_digits", "blank_before", "blank_behind", "unfinished", "broken", "goes_on", "repeated", "shape_edge", "log_scans"]
JOIN = ["hyphen", "blank_behind", "filled", "small", "capital", "left", "right", "numbers_between", "titles_between", "break_share", "title", "name", "lines_between"]
VIEW = {"page": list(range(0, 9)), "line": [0, 1, 2, 3, 4, 5, 6, 7, 11, 12, 13], "break": list(range(len(JOIN)))}
_ROWS = "source_table string, record_id string, kind string, a string, b string, n int, named int, x array<float>"


def pass_one(scans: DataFrame) -> DataFrame:
    """Rows of scan_pairs for every scan; scans: source_table, record_id, text. Null and empty texts give none."""
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known: dict[str, list] = {}
            out = []
            for s, r, t in zip(f["source_table"], f["record_id"], f["text"]):
                if t not in known:
                    known[t] = scan_pairs(t)
                out += [(s, r, *x) for x in known[t]]
            yield pd.DataFrame(out, columns=names)

    return scans.where(F.length("text") > 0).mapInPandas(run, _ROWS)


# Words of the pages made by rule.
_PLAIN_WORDS = "about account after again among animal answer around because before behind between building carry change children city clear close country course cover door early earth enough evening example family father figure follow friend garden general ground group happen hundred island large learn letter light machine measure money morning mother mountain music nothing number office often paper people picture plant point power problem product question river school second sentence several should simple small something space stand station story street system table teacher thing though thought through together travel under understand village voice watch water weather while window winter without woman wonder world write young".split()


def made_pages(count: int, seed: int) -> list[tuple[str, set[str], set[str]]]:
    """(text, its header lines, its page-number lines) of pages made by rule: wrapped sentences, words broken at line ends, headers, numbers,
    headings and amounts of the text itself."""
    rng = np.random.default_rng(seed)
    pick = lambda n: [_PLAIN_WORDS[i] for i in rng.integers(len(_PLAIN_WORDS), size=n)]
    out = []
    for _ in range(count):
        name = " ".join(w.capitalize() for w in pick(3))
        name = name.upper() if rng.random() < 0.3 else name
        hyphen = _HYPHENS[rng.integers(4)] + (" " if rng.random() < 0.2 else "")
        form = ["Page {}", "- {} -", "[{}]", "{}", "Page {} of 90", "   {}"][rng.integers(6)]
        has_head, has_number, break_at = rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.8
        words: list[str] = []
        for _ in range(int(rng.integers(6, 16))):
            sentence = pick(int(rng.integers(6, 14)))
            words += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
        lines, line = [], ""
        for w in words:
            if len(line) + len(w) + 1 <= 56:
                line = f"{line} {w}".strip()
            elif len(w) > 6 and w.isalpha() and w.islower() and break_at:
                lines.append(f"{line} {w[:3]}{hyphen}")
                line = w[3:]
            else:
                lines.append(line)
                line = w
        lines.append(line)
        heads, numbers, text, page = set(), set(), [], int(rng.integers(1, 80))
        for at in range(0, len(lines), 5):
            if at and rng.random() < 0.3:
                text.append(" ".join(w.capitalize() for w in pick(2)))  # a heading of the text
            if at and rng.random() < 0.3:
                text += ["Total amount", str(rng.integers(10, 9000))]
            if at and rng.random() < 0.3:  # a postal code or another long number alone on a line
                text += [" ".join(pick(6)) + ",", str(rng.integers(10 ** int(rng.integers(3, 6)), 10**6)), " ".join(pick(7)) + "."]
            if at and rng.random() < 0.2:
                text += [" ".join(pick(3)) + "-", "Item " + " ".join(pick(2))]
            text += lines[at : at + 5]
            if has_number:
                own = form.format(page)
                numbers.add(own.strip())
                text.append(own)
            if at + 5 < len(lines) and has_head:
                heads.add(name)
                text.append(name)
            page += 1
        out.append(("\n".join(text), heads, numbers))
    return out


def prior_pairs(kind: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pairs of the pages made by rule."""
    x, y = [], []
    pages = [(scan_pairs(t), heads, numbers) for t, heads, numbers in made_pages(60, seed)]
    seen: dict[str, list[int]] = {}
    for rows, _, _ in pages:
        for b, n in {(r[2], r[3]) for r in rows if r[0] == "line"}:
            seen.setdefault(b, []).append(n)
    for rows, heads, numbers in pages:
        for r in rows:
            if r[0] != kind:
                continue
            if kind == "line":
                n = seen[r[2]]
                x.append([*r[5], sum(k > 1 for k in n) / len(n), r[5][0], float(np.log1p(len(n)))])
                y.append(float(r[1] in heads))
            else:
                x.append(r[5])
                y.append(float(r[1] in numbers) if kind == "page" else float(r[5][3] > 0))
    return np.array(x, dtype=float), np.array(y)


def fit_views(kind: str, x: np.ndarray, y: np.ndarray, seed: int) -> Boosted:
    """Trees for one kind of pair. y: labels by evidence, nan where it settles nothing.

    The first trees see the features besides the evidence; pairs they are sure of count in the second fit, which sees all features.
    """
    px, py = prior_pairs(kind, seed)
    x, y = np.vstack([px, x.reshape(-1, px.shape[1])]), np.append(py, y)
    known, view = ~np.isnan(y), VIEW[kind]
    p = Boosted(trees=40, least=6).fit(x[known][:, view], y[known]).score(x[:, view])
    y = np.where(known, y, np.where(p > 0.9, 1.0, np.where(p < 0.1, 0.0, np.nan)))
    sure = ~np.isnan(y)
    return Boosted(trees=40, least=6).fit(x[sure], y[sure])


def held_out(kind: str, x: np.ndarray, y: np.ndarray, seed: int) -> tuple[float, float]:
    """(recall, precision) on every fifth pair that evidence settles, of trees fitted without these pairs."""
    known = np.flatnonzero(~np.isnan(y))
    test = known[::5]
    rest = np.setdiff1d(np.arange(len(y)), test)
    said, true = fit_views(kind, x[rest], y[rest], seed).score(x[test]) >= 0.5, y[test] > 0.5
    return float(said[true].mean()), float(true[said].mean())


def evidence(kind: str) -> Column:
    """Label of a pair by evidence, null where there is none; x holds its features."""
    names = {"page": PAGE, "line": LINE}[kind]
    v = lambda c: F.col("x")[names.index(c)]
    cuts = (v("broken") > 0) & (v("goes_on") > 0)
    if kind == "page":
        completes = (v("form") == 3) & (v("in_sequence") == 0) & (v("unfinished") > 0) & (v("goes_on") <= 0) & (v("broken") == 0)
        return F.when(cuts | (v("form") < 2) | (v("in_sequence") > 0), 1.0).when(completes | ((v("after_amount") > 0) & (v("form") == 3)), 0.0)
    return F.when(cuts, 1.0).when((v("often") == 1) & (v("repeated") <= 0.2), 0.0)


def pair_sample(rows: DataFrame, label: Column, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of pairs, by a hash: half of it with a label, half of all."""
    rows = rows.select("x", label.alias("y"), F.xxhash64("source_table", "record_id", "a", "b").alias("h"))
    n = settings.train_lines // 2
    few = rows.where("y is not null").orderBy("h").limit(n).unionByName(rows.where("y is null").orderBy("h").limit(n)).toPandas()
    few = few.sort_values("h", kind="stable")
    return np.array(few["x"].tolist(), dtype=float), few["y"].to_numpy(dtype=float)


def decided(rows: DataFrame, kind: str, label: Column, settings: Settings) -> DataFrame:
    """Rows with p, the score of the trees fitted on a sample of them."""
    x, y = pair_sample(rows, label, settings)
    trees = fit_views(kind, x, y, settings.seed)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(trees.score(np.array(x.tolist(), dtype=float)) if len(x) else np.zeros(0))

    return rows.withColumn("p", score("x"))


@functools.lru_cache(maxsize=8)
def _by_last(confusions: tuple) -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for good, bad in confusions:
        out.setdefault(bad[-1], []).append((good, bad))
    return out


@functools.lru_cache(maxsize=200_000)
def confusion_cost(seen: str, right: str, confusions: tuple = tuple(CONFUSIONS)) -> tuple[float, int]:
    """(cost, edits) of reading `right` as `seen`: 0.2 for a confusion, 1 for any other single edit.

    What both words begin and end with, but for a letter beside the change, costs nothing.
    """
    most = min(len(seen), len(right))
    a = next((i for i in range(most) if seen[i] != right[i]), most)
    b = next((i for i in range(most - a) if seen[-1 - i] != right[-1 - i]), most - a)
    a, b = max(0, a - 1), max(0, b - 1)
    seen, right = seen[a : len(seen) - b], right[a : len(right) - b]
    known, m = _by_last(confusions), len(right)
    rows = [[(float(j), j) for j in range(m + 1)]]
    for i in range(1, len(seen) + 1):
        c, up, row = seen[i - 1], rows[i - 1], [(float(i), i)]
        own = [(g, len(g), len(x)) for g, x in known.get(c, ()) if seen.endswith(x, 0, i)]
        for j in range(1, m + 1):
            same = c == right[j - 1]
            x, y, z = up[j - 1], up[j], row[j - 1]
            best = min((x[0] + (not same), x[1] + (not same)), (y[0] + 1, y[1] + 1), (z[0] + 1, z[1] + 1))
            for good, g, n in own:
                if j >= g and right.endswith(good, 0, j):
                    k = rows[i - n][j - g]
                    best = min(best, (k[0] + 0.2, k[1] + 1))
            row.append(best)
        rows.append(row)
    return rows[-1][m]


def rank_features(seen: str, right: str, ratio: float, shared: float, confusions: tuple) -> list[float]:
    cost, edits = confusion_cost(seen, right, confusions)
    odd = sum(not c.isalpha() and c not in "-'’" for c in seen)
    return [cost, float(edits), cost / max(1, len(right)), min(np.log1p(ratio), 9.0), shared, float(odd), float(len(right)), float(seen[:1] == right[:1])]


def place_grams(word: str) -> list[str]:
    """2-grams of a padded word with their place from the start and from the end."""
    p = f"^{word}$"
    n = len(p) - 1
    return [f"s{i}{p[i : i + 2]}" for i in range(n)] + [f"e{n - 1 - i}{p[i : i + 2]}" for i in range(n)]


def needed(size: int, shared: float) -> int:
    """2-grams of a word of `size` (letters + 1) that a candidate must share at least."""
    return max(1, int(np.ceil(shared * size - 1e-9)))


def _misread(word: str, rng: np.random.Generator, confusions: tuple) -> str | None:
    """The word misread: one, now and then two, confusions, seldom any other letter in place of one; None if none applies."""
    if rng.random() < 0.1 and len(word) > 4:
        i = int(rng.integers(1, len(word) - 1))
        return word[:i] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + word[i + 1 :]
    for _ in range(1 + (rng.random() < 0.15)):
        places = [(i, g, b) for g, b in confusions for i in range(len(word)) if word.startswith(g, i)]
        if not places:
            return None
        i, g, b = places[rng.integers(len(places))]
        word = word[:i] + b + word[i + len(g) :]
    return word


def fit_ranker(words: list[tuple[str, int]], confusions: tuple, settings: Settings) -> Boosted:
    """Ranker fitted on misreadings made from a bounded list of frequent words and those of the pages made by rule: the right word against
    the next likest ones, and frequent words, which are right as they stand, against their likest others.

    A word near one twenty times as frequent may be a misreading itself and makes no example.
    """
    known = {w for w, _ in words}
    words = sorted([*words[: settings.train_words], *((w, 1) for w in _PLAIN_WORDS if w not in known)], key=lambda x: (-x[1], x[0]))
    rng = np.random.default_rng(settings.seed)
    index: dict[str, list[int]] = {}
    for i, (w, _) in enumerate(words):
        for g in place_grams(w):
            index.setdefault(g, []).append(i)

    def near(w: str) -> list[tuple[int, float]]:
        grams = place_grams(w)
        hits = Counter(i for g in grams for i in index.get(g, ()))
        return [(i, 2 * n / len(grams)) for i, n in hits.most_common(6) if 2 * n / len(grams) >= settings.shared]

    x, y = [], []
    for k, (w, n) in enumerate(words):
        others = [(i, shared) for i, shared in near(w) if i != k]
        if any(words[i][1] >= 20 * n and confusion_cost(w, words[i][0], confusions)[0] <= 0.4 for i, _ in others):
            continue
        for _ in range(6):
            bad = _misread(w, rng, confusions)
            if not bad or len(bad) < 3 or bad == w or bad in known:
                continue
            for i, shared in near(bad):
                x.append(rank_features(bad, words[i][0], float(np.exp(rng.uniform(1.5, 8))), shared, confusions))
                y.append(float(i == k))
        for i, shared in others:
            x.append(rank_features(w, words[i][0], float(np.exp(rng.uniform(1.5, 8))), shared, confusions))
            y.append(0.0)
    return Boosted().fit(np.array(x), np.array(y))


def _changed(seen: str, right: str) -> tuple[str, str, bool]:
    """(right, seen) parts in which two words differ, and whether the right part lies before the word's end."""
    a = 0
    while a < min(len(seen), len(right)) and seen[a] == right[a]:
        a += 1
    b = 0
    while b < min(len(seen), len(right)) - a and seen[-1 - b] == right[-1 - b]:
        b += 1
    return right[a : len(right) - b], seen[a : len(seen) - b], b > 0


def learnt_confusions(pairs: DataFrame, settings: Settings) -> list[tuple[str, str]]:
    """(right, seen) parts of at most two letters that are exchanged, mostly before the word's end, in at least `learnt` right words where
    the right word is twenty times as frequent, and four times as often as where it is not."""
    of = F.pandas_udf(lambda a, b: pd.DataFrame([_changed(*v) for v in zip(a, b)], columns=["good", "bad", "inner"]), "good string, bad string, inner boolean")
    parts = pairs.select("right", "ratio", of("word", "right").alias("c")).select("right", "ratio", "c.*")
    parts = parts.where("length(good) between 1 and 2 and length(bad) between 1 and 2")
    by = parts.groupBy("good", "bad", "right").agg(F.max((F.col("ratio") >= 20).cast("int")).alias("high"), F.max(F.col("inner").cast("int")).alias("inner"))
    by = by.groupBy("good", "bad").agg(F.sum("high").alias("high"), F.sum(1 - F.col("high")).alias("low"), F.avg("inner").alias("inner"))
    rows = by.where((F.col("high") >= settings.learnt) & (F.col("high") >= 4 * F.col("low")) & (F.col("inner") >= 0.6)).collect()
    return sorted((r["good"], r["bad"]) for r in rows)


def candidates(words: DataFrame, settings: Settings) -> DataFrame:
    """(word, right, ratio, shared): right words that share at least `shared` placed 2-grams per letter with a word, `ratio` times as frequent.

    Two sets of which one shares n of its m members with the other meet in any m - n + 1 of them: of a word's 2-grams only as many
    of the rarest are joined, which leaves out the most frequent keys; what is left of them Spark splits (skewed joins).
    """
    common = words.where((F.col("n_documents") >= settings.least_documents) & F.col("word").rlike(r"^[\p{L}]+([-'’][\p{L}]+)*$") & (F.col("named") < 0.5))
    grams = F.pandas_udf(lambda s: s.map(place_grams), "array<string>")
    least = F.pandas_udf(lambda s: s.map(lambda w: len(w) + 1).map(lambda n: 2 * n - needed(n, settings.shared) + 1), "int")
    right = common.select(F.col("word").alias("right"), F.col("n_documents").alias("m"), grams("word").alias("all"))
    index = right.select("right", "m", "all", F.explode("all").alias("g"))
    seen = cut(words.where(F.col("named") < 0.9).select("word", F.col("n_documents").alias("n"), grams("word").alias("own"), least("word").alias("k")))
    often = index.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    probe = seen.select("word", "k", F.explode("own").alias("g")).join(often, "g")
    rarest = probe.groupBy("word").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("often", "g"))).alias("by"))
    # 2-grams that no right word has come first of all and join nothing
    none = seen.join(rarest.select("word", F.size("by").alias("have"), "by"), "word")
    left = none.withColumn("take", F.col("k") - (F.size("own") - F.col("have"))).where("take > 0")
    left = left.select("word", "n", "own", F.explode(F.transform(F.slice("by", 1, F.col("take")), lambda x: x["g"])).alias("g"))
    met = left.join(index, "g").where((F.col("m") >= settings.ratio * F.col("n")) & (F.col("word") != F.col("right")) & (F.abs(F.length("word") - F.length("right")) <= 2))
    pairs = met.dropDuplicates(["word", "right"]).withColumn("shared", F.size(F.array_intersect("own", "all")) / (F.length("word") + 1))
    return pairs.where(F.col("shared") >= settings.shared).select("word", "right", (F.col("m") / F.col("n")).alias("ratio"), "shared")


def replacements(words: DataFrame, settings: Settings) -> DataFrame:
    """(word, right) for misread words. words: word, n_documents, named (share of uses as a name within a sentence)."""
    pairs = cut(candidates(words, settings))
    confusions = (*CONFUSIONS, *(c for c in learnt_confusions(pairs, settings) if c not in CONFUSIONS))
    frequent = words.where((F.col("n_documents") >= settings.least_documents) & F.col("word").rlike(r"^[\p{L}]+([-'’][\p{L}]+)*$") & (F.col("named") < 0.5))
    most = [(r["word"], r["n_documents"]) for r in frequent.orderBy(F.desc("n_documents"), "word").limit(settings.train_words).collect()]
    ranker = fit_ranker(most, confusions, settings)

    @F.pandas_udf("double")
    def score(seen: pd.Series, right: pd.Series, ratio: pd.Series, shared: pd.Series) -> pd.Series:
        x = np.array([rank_features(*v, confusions) for v in zip(seen, right, ratio, shared)], dtype=float).reshape(len(seen), 8)
        return pd.Series(ranker.score(x) if len(x) else np.zeros(0))

    scored = pairs.withColumn("p", score("word", "right", "ratio", "shared")).where(F.col("p") >= settings.accept)
    best = cut(scored.groupBy("word").agg(F.max_by("right", F.struct("p", "shared", "ratio", "right")).alias("right")))
    on = best.select(F.col("word").alias("right"), F.col("right").alias("next"))  # a replacement may be a frequent misreading itself
    return best.join(on, "right", "left").select("word", F.coalesce("next", "right").alias("right"))


def found(scans: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(source_table, record_id, noise_kind, found), distinct, of scans (source_table, record_id, text).

    Null and empty texts have no cases; repeated rows give the same cases once; other columns are ignored.
    """
    rows = cut(pass_one(scans))
    key = ["source_table", "record_id"]
    case = lambda rows, kind, c: rows.select(*key, F.lit(kind).alias("noise_kind"), F.col(c).alias("found"))
    pages = case(decided(rows.where("kind = 'page'"), "page", evidence("page"), settings).where("p >= 0.5"), "page_no", "a")

    lines = rows.where("kind = 'line'").select(*key, "a", "b", "n", "x")
    per = lines.groupBy(*key, "b").agg(F.max("n").alias("n"), F.avg(F.col("x")[0]).alias("edge"))
    shapes = per.groupBy("b").agg(F.count(F.lit(1)).alias("scans"), F.avg((F.col("n") > 1).cast("double")).alias("repeated"), F.avg("edge").alias("edge"))
    lines = lines.join(shapes, "b")
    lines = cut(lines.withColumn("x", F.concat("x", F.array(*[c.cast("float") for c in (F.col("repeated"), F.col("edge"), F.log1p("scans"))]))))
    headers = case(decided(lines, "line", evidence("line"), settings).where("p >= 0.5"), "header", "a")

    uses = rows.where("kind = 'word'").groupBy("a").agg(F.count(F.lit(1)).alias("n_documents"), (F.sum("named") / F.sum("n")).alias("named"))
    words = cut(uses.select(F.col("a").alias("word"), "n_documents", "named"))
    counts = words.select("word", F.col("n_documents").alias("n"))
    breaks = rows.where("kind = 'break'").select(*key, "a", "b", "x")
    breaks = breaks.withColumns({"whole": F.concat("a", "b"), "kept": F.concat_ws("-", "a", "b")})
    for name in ("whole", "kept", "a", "b"):
        breaks = breaks.join(counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}")), name, "left")
    breaks = cut(breaks.fillna(0, [f"n_{c}" for c in ("whole", "kept", "a", "b")]))
    joins = F.when((F.col("n_whole") > 1) | (F.col("n_kept") > 1), 1.0).when((F.col("n_whole") + F.col("n_kept") == 0) & (F.col("n_b") > 1), 0.0)
    breaks = cut(decided(breaks, "break", joins, settings))
    keep = F.expr("n_kept > n_whole or (n_whole = 0 and n_kept = 0 and n_a > 20 and n_b > 20 and length(a) > 2 and length(b) > 1)")
    joined = breaks.where("p >= 0.5").select(*key, F.when(keep, F.col("kept")).otherwise(F.col("whole")).alias("word"))
    halves = breaks.where("p < 0.5").select(*key, F.explode(F.array("a", "b")).alias("word")).where("length(word) > 2")

    more = joined.unionByName(halves).groupBy("word").agg(F.countDistinct(*key).alias("n_documents")).withColumn("named", F.lit(0.0))
    every = words.unionByName(more).groupBy("word").agg(F.sum("n_documents").alias("n_documents"), F.min("named").alias("named"))
    fixes = cut(replacements(every, settings))
    hyphens = case(joined.join(fixes, "word", "left").withColumn("word", F.coalesce("right", "word")), "hyphen", "word")
    seen = rows.where("kind = 'word'").select(*key, F.col("a").alias("word")).unionByName(joined).unionByName(halves)
    chars = case(seen.join(fixes, "word"), "char", "right")
    return pages.unionByName(headers).unionByName(hyphens).unionByName(chars).distinct()


def scans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct page scans: media.ocr_text and the text of enhanced images and PDFs."""
    media = table(spark, sf_dir, "media").select(F.lit("media").alias("source_table"), F.col("media_id").alias("record_id"), F.col("ocr_text").alias("text"))
    more = table(spark, sf_dir, "media_enhancements").where(F.lower(F.trim("media_type")).isin("image", "pdf"))
    more = more.select(F.lit("media_enhancements").alias("source_table"), F.col("id").cast("string").alias("record_id"), F.col("extracted_text").alias("text"))
    rows = media.unionByName(more).where(F.col("text").isNotNull())
    return rows.groupBy("source_table", "record_id").agg(F.max("text").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Cases of scan noise in all page scans."""
    return found(scans_of(spark, sf_dir), settings)
