"""Language of each message and of each part of a mixed one (problem 6).

A bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time, gives every
position of a text a probability of each language. Words pool the positions they cover; within a sentence the words
are cut into stretches of one language by the best path under a cost for each switch; a message pools its words.

The network is fitted on a bounded sample of labelled messages (`Settings.per_language` each, chosen by a hash of the text).
Labels may be wrong: after a first round, rows whose label the network rejects are left out of the second. Prediction
covers whole texts: longer ones go through in overlapping windows, so that each position is labelled with context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.session import table

LANGUAGES = ("en", "hi", "te", "bn", "es", "fr", "de", "pt")


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the training sample and crop its pieces; the rest shapes network and cutting."""

    max_rows: int = 24_000
    crop: int = 56
    hidden: int = 32
    updates: tuple[int, int, int] = (240, 280, 320)
    batch: int = 192
    rate: float = 2e-2
    trusted: float = 0.3
    agree: float = 0.5
    window: int = 768
    overlap: int = 96
    switch_cost: float = 4.0
    least_words: int = 4
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Bidirectional GRU; w: (2, 256, 3H) input tables with bias, u: (2, H, 3H), b: (2, 1, H), v: (2H, K), c: (K,)."""

    def __init__(self, hidden: int, classes: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        f = np.float32
        self.hidden = hidden
        self.p = {
            "w": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f),
            "u": (rng.normal(0, 1, (2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f),
            "b": np.zeros((2, 1, hidden), f),
            "v": rng.normal(0, 0.1, (2 * hidden, classes)).astype(f),
            "c": np.zeros(classes, f),
        }

    @staticmethod
    def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes (2, T, B), reverse index (T, B), lengths): the second direction holds each text backwards."""
        n = np.array([len(t) for t in texts])
        size = max(1, int(n.max(initial=1)))
        a = np.zeros((size, len(texts)), np.int64)
        for j, t in enumerate(texts):
            a[: len(t), j] = np.frombuffer(t, np.uint8)
        at = np.arange(size)[:, None]
        back = np.where(at < n, n - 1 - at, at)
        return np.stack([a, np.take_along_axis(a, back, 0)]), back, n

    def states(self, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """All states (T, 2, B, H) and, if kept, what the backward pass needs."""
        p, h_size = self.p, self.hidden
        _, size, batch = codes.shape
        h = np.zeros((2, batch, h_size), np.float32)
        out = np.empty((size, 2, batch, h_size), np.float32)
        tape = []
        for t in range(size):
            x = np.stack([p["w"][0][codes[0, t]], p["w"][1][codes[1, t]]])
            g = h @ p["u"]
            zr = _sigmoid(x[..., : 2 * h_size] + g[..., : 2 * h_size])
            z, r = zr[..., :h_size], zr[..., h_size:]
            m = g[..., 2 * h_size :] + p["b"]
            new = np.tanh(x[..., 2 * h_size :] + r * m)
            if keep:
                tape.append((h, z, r, m, new))
            h = new + z * (h - new)
            out[t] = h
        return out, tape

    def plain_states(self, codes: np.ndarray) -> np.ndarray:
        """The states of `states` where nothing is kept for a backward pass, in arrays that are used again at each step."""
        p, h_size = self.p, self.hidden
        w_zr, w_h = np.ascontiguousarray(p["w"][:, :, : 2 * h_size] * 0.5), np.ascontiguousarray(p["w"][:, :, 2 * h_size :])
        u_zr, u_h = np.ascontiguousarray(p["u"][:, :, : 2 * h_size] * 0.5), np.ascontiguousarray(p["u"][:, :, 2 * h_size :])
        _, size, batch = codes.shape
        h, out = np.zeros((2, batch, h_size), np.float32), np.empty((size, 2, batch, h_size), np.float32)
        x_zr, x_h = np.empty((2, batch, 2 * h_size), np.float32), np.empty((2, batch, h_size), np.float32)
        zr, m = np.empty_like(x_zr), np.empty_like(x_h)
        for t in range(size):
            for k in (0, 1):
                np.take(w_zr[k], codes[k, t], axis=0, out=x_zr[k], mode="clip")
                np.take(w_h[k], codes[k, t], axis=0, out=x_h[k], mode="clip")
            np.matmul(h, u_zr, out=zr)
            zr += x_zr
            np.tanh(zr, out=zr)  # of half the sum: the logistic function by way of tanh
            zr *= 0.5
            zr += 0.5
            np.matmul(h, u_h, out=m)
            m += p["b"]
            m *= zr[..., h_size:]
            m += x_h
            np.tanh(m, out=m)
            h -= m
            h *= zr[..., :h_size]
            h += m
            out[t] = h
        return out

    def outputs(self, states: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class probabilities (T, B, K), joined states (T, B, 2H))."""
        other = np.take_along_axis(states[:, 1], back[:, :, None], 0)
        joined = np.concatenate([states[:, 0], other], axis=2)
        logit = joined @ self.p["v"] + self.p["c"]
        logit -= logit.max(axis=2, keepdims=True)
        e = np.exp(logit)
        return e / e.sum(axis=2, keepdims=True), joined

    def predict(self, texts: list[bytes]) -> list[np.ndarray]:
        """Probabilities (len, K) of each text's positions."""
        codes, back, n = self.pack(texts)
        prob, _ = self.outputs(self.plain_states(codes), back)
        return [prob[: n[j], j] for j in range(len(texts))]

    def gradients(self, texts: list[bytes], labels: list[np.ndarray]) -> tuple[float, dict]:
        """Mean loss over positions and its gradients, by backpropagation through time."""
        p, h_size = self.p, self.hidden
        codes, back, n = self.pack(texts)
        _, size, batch = codes.shape
        states, tape = self.states(codes, True)
        prob, joined = self.outputs(states, back)
        live = np.arange(size)[:, None] < n
        y = np.zeros((size, batch), np.int64)
        for j, a in enumerate(labels):
            y[: len(a), j] = a
        total = max(1, int(n.sum()))
        chosen = np.take_along_axis(prob, y[:, :, None], 2)[:, :, 0]
        loss = float(-(np.log(np.maximum(chosen, 1e-9)) * live).sum() / total)
        d = prob.copy()
        np.put_along_axis(d, y[:, :, None], chosen[:, :, None] - 1, 2)
        d *= live[:, :, None] / np.float32(total)
        flat = d.reshape(-1, d.shape[2])
        grad = {"v": joined.reshape(-1, 2 * h_size).T @ flat, "c": flat.sum(0)}
        dj = d @ p["v"].T
        ds = np.stack([dj[:, :, :h_size], np.take_along_axis(dj[:, :, h_size:], back[:, :, None], 0)], axis=1)
        du, db, dx = np.zeros_like(p["u"]), np.zeros_like(p["b"]), np.empty((size, 2, batch, 3 * h_size), np.float32)
        dh = np.zeros((2, batch, h_size), np.float32)
        ut = p["u"].transpose(0, 2, 1)
        for t in range(size - 1, -1, -1):
            h, z, r, m, new = tape[t]
            dh = dh + ds[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            dg = np.concatenate([dz, dr, dm], axis=2)
            du += h.transpose(0, 2, 1) @ dg
            db += dm.sum(1, keepdims=True)
            dx[t] = np.concatenate([dz, dr, dn], axis=2)
            dh = dh * z + dg @ ut
        dw = np.zeros_like(p["w"])
        for k in range(2):
            flat_codes = codes[k].ravel()
            by_code = np.argsort(flat_codes, kind="stable")
            seen, at = np.unique(flat_codes[by_code], return_index=True)
            dw[k][seen] = np.add.reduceat(dx[:, k].reshape(-1, 3 * h_size)[by_code], at, axis=0)
        return loss, grad | {"u": du, "b": db, "w": dw}

    def train(self, texts: list[bytes], labels: list[np.ndarray], settings: Settings, updates: int) -> None:
        """Adam with a falling rate; batches hold texts of like length."""
        rng = np.random.default_rng(settings.seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = np.argsort([len(t) for t in texts], kind="stable")
        groups = [g for g in np.array_split(order, max(1, len(order) // settings.batch)) if len(g)]
        for step in range(1, updates + 1):
            g = groups[rng.integers(len(groups))]
            _, grad = self.gradients([texts[i] for i in g], [labels[i] for i in g])
            norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            rate = settings.rate * (0.05 + 0.95 * (1 - step / updates))
            for k, x in grad.items():
                x = x * scale
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


_JOINS = [", ", ". ", " ", " ... ", "\n", " - ", " / ", " — "]


def _crop(data: bytes, labels: np.ndarray, size: int, rng: np.random.Generator) -> tuple[bytes, np.ndarray]:
    at = int(rng.integers(0, max(1, len(data) - size + 1)))
    return data[at : at + size], labels[at : at + size]


def _pieces(rows: list[tuple[str, int]], count: int, mixed: float, settings: Settings, seed: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Crops of rows, languages as often as they occur in rows; a share of them of two rows joined."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(count):
        a, ka = rows[rng.integers(len(rows))]
        data = _varied(a, rng).encode("utf-8", "replace")
        own = np.full(len(data), ka)
        size = settings.crop
        if rng.random() < mixed:
            b, kb = rows[rng.integers(len(rows))]
            join = _JOINS[rng.integers(len(_JOINS))].encode()
            more = _varied(b, rng).encode("utf-8", "replace")
            keep = int(rng.integers(12, settings.crop))
            data, own = data[-keep:] + join, np.append(own[-keep:], np.full(len(join), ka))
            data, own = data + more[: settings.crop], np.append(own, np.full(len(more[: settings.crop]), kb))
            size = settings.crop * 3 // 2
        x, y = _crop(data, own, size, rng)
        if len(x):
            texts.append(x)
            labels.append(y)
    return texts, labels


def _varied(text: str, rng: np.random.Generator) -> str:
    """The text as it is, or in capitals, or in small letters."""
    k = rng.integers(6)
    return text.upper() if k == 0 else text.lower() if k == 1 else text


def sample(messages: DataFrame, settings: Settings) -> list[tuple[str, str]]:
    """At most max_rows (text, label) rows with a label of ours: those of the least hash of the text."""
    rows = messages.select("text", F.lower(F.trim("detected_language")).alias("label"))
    rows = rows.where(F.col("label").isin(*LANGUAGES) & (F.size(F.split(F.trim("text"), r"\s+")) >= settings.least_words))
    rows = rows.orderBy(F.xxhash64("text"), "text", "label").limit(settings.max_rows)
    return [(r["text"], r["label"]) for r in rows.collect()]


def fit(rows: list[tuple[str, str]], settings: Settings = Settings()) -> Network | None:
    """Network trained on (text, label) rows, some labels being wrong; None without rows.

    In the first round a language counts by the root of its number of rows, so that rare ones are learnt although a
    rare label is more often a wrong one. The second sees of each language only the `trusted` share of its rows whose
    label the first round finds likeliest, the third those that the second accepts (`agree`); in both all languages
    count alike, and a part of the pieces joins two rows.
    """
    if not rows:
        return None
    known = [(t, LANGUAGES.index(k)) for t, k in rows]
    groups = [[r for r in known if r[1] == k] for k in range(len(LANGUAGES))]
    rng = np.random.default_rng(settings.seed + 1)
    uneven = [g[i] for g in groups if g for i in rng.integers(len(g), size=int(40 * len(g) ** 0.5) + 1)]
    net = Network(settings.hidden, len(LANGUAGES), settings.seed)
    first = _pieces(uneven, min(8 * len(known), settings.updates[0] * settings.batch), 0.0, settings, settings.seed)
    net.train(*first, settings, settings.updates[0])
    for turn in (1, 2):
        chosen = []
        for k, g in enumerate(groups):
            score = _agreement(net, g, k, settings)
            best = np.argsort(-score, kind="stable")
            n = int(len(g) * settings.trusted) if turn == 1 else int((score > settings.agree).sum())
            chosen.append([g[i] for i in best[: max(n, 1)]])
        most = max(len(g) for g in chosen)
        even = [g[i] for g in chosen if g for i in rng.integers(len(g), size=most)]
        pieces = _pieces(even, settings.updates[turn] * settings.batch // 2, 0.35, settings, settings.seed + 1 + turn)
        net.train(*pieces, settings, settings.updates[turn])
    return net


def _agreement(net: Network, rows: list[tuple[str, int]], k: int, settings: Settings) -> np.ndarray:
    """Mean probability of class k over the head of each text."""
    heads = [t.encode("utf-8", "replace")[: 2 * settings.crop] for t, _ in rows]
    order = np.argsort([len(x) for x in heads], kind="stable")
    score = np.zeros(len(rows))
    for p in range(0, len(order), 512):
        ids = order[p : p + 512]
        score[ids] = [prob[:, k].mean() if len(prob) else 0.0 for prob in net.predict([heads[i] for i in ids])]
    return score


_SENTENCE = re.compile(r"[.!?।…\n]+(?:\s|$)|\s[-–—/|]+\s")
_WORD = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[tuple[int, int, int, int, int]]:
    """(sentence, start, end, first byte, byte behind) of each word with a letter in it."""
    cuts = [m.start() for m in _SENTENCE.finditer(text)]
    out, at, byte, k, plain = [], 0, 0, 0, text.isascii()
    size = len if plain else lambda x: len(x.encode("utf-8", "replace"))
    for m in _WORD.finditer(text):
        a, b = m.span()
        first = byte + size(text[at:a])
        at, byte = b, first + size(text[a:b])
        if _LETTER.search(text, a, b):
            while k < len(cuts) and cuts[k] <= a:
                k += 1
            out.append((k, a, b, first, byte))
    return out


def best_path(scores: np.ndarray, switch_cost: float) -> np.ndarray:
    """Class of each word that gives the highest sum, each change of class costing switch_cost."""
    n, k = scores.shape
    best, came = scores[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - switch_cost
        stay = best >= jump
        came[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, jump) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    return path


def segments_of(texts: list[str], probs: list[np.ndarray], settings: Settings) -> list[list[tuple[int, int, str, float, int]]]:
    """(start, end, language, confidence, words) of each stretch of one language within a sentence of each text, in order.

    A word's scores are the means of the log probabilities of its bytes. Where no change of language can pay, as the best of all
    words together are no more than its cost better than one language throughout, the sentence is one stretch; else the best path decides.
    """
    out: list[list] = [[] for _ in texts]
    words, owner, sentence, offset = [], [], [], 0
    for i, (t, p) in enumerate(zip(texts, probs)):
        for k, a, b, first, last in words_of(t):
            words.append((a, b, offset + first, offset + last))
            owner.append(i)
            sentence.append(k)
        offset += len(p)
    if not words:
        return out
    total = np.zeros((offset + 1, len(LANGUAGES)))
    np.cumsum(np.log(np.maximum(np.concatenate(probs), 1e-6)), axis=0, out=total[1:])
    spans = np.array([w[2:] for w in words])
    scores = (total[spans[:, 1]] - total[spans[:, 0]]) / np.maximum(1, spans[:, 1] - spans[:, 0])[:, None]
    owner, sentence = np.array(owner), np.array(sentence)
    starts = np.append(0, np.flatnonzero((np.diff(owner) != 0) | (np.diff(sentence) != 0)) + 1)
    ends = np.append(starts[1:], len(words))
    sums, best = np.add.reduceat(scores, starts, axis=0), np.add.reduceat(scores.max(axis=1), starts)
    even = sums.max(axis=1) >= best - settings.switch_cost
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if even[k]:
            parts = [(a, b, int(sums[k].argmax()))]
        else:
            path = best_path(scores[a:b], settings.switch_cost)
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
            parts = [(a + x, a + y, int(path[x])) for x, y in zip(cuts, cuts[1:])]
        for x, y, lang in parts:
            mean = (sums[k] if even[k] else scores[x:y].sum(axis=0)) / (y - x)
            confidence = 1.0 / float(np.exp(mean - mean[lang]).sum())
            out[owner[a]].append((words[x][0], words[y - 1][1], LANGUAGES[lang], confidence, y - x))
    return out


def positions(net: Network, texts: list[str], settings: Settings) -> list[np.ndarray]:
    """Probabilities of every byte of every text; long ones in windows, of which the inner part is used."""
    data = [t.encode("utf-8", "replace") for t in texts]
    pieces = []  # (text, from, used from, used to, to)
    step = settings.window - 2 * settings.overlap
    for i, d in enumerate(data):
        if len(d) <= settings.window:
            pieces.append((i, 0, 0, len(d), len(d)))
            continue
        for a in range(0, len(d), step):
            b = min(len(d), a + step)
            pieces.append((i, max(0, a - settings.overlap), a, b, min(len(d), b + settings.overlap)))
    out = [np.zeros((len(d), len(LANGUAGES)), np.float32) for d in data]
    order = np.argsort([p[4] - p[1] for p in pieces], kind="stable")
    for p in range(0, len(order), 128):
        chosen = [pieces[i] for i in order[p : p + 128]]
        for (i, lo, a, b, hi), prob in zip(chosen, net.predict([data[i][lo:hi] for i, lo, _, _, hi in chosen])):
            out[i][a:b] = prob[a - lo : b - lo]
    return out


_SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double,words:int>>"


def label(rows: DataFrame, net: Network | None, settings: Settings = Settings()) -> DataFrame:
    """Add `segments` and the message's own `lang` and `confidence` to rows with a column `text`.

    Each distinct text goes through the network once. Null and blank texts, and those without a letter, get no segments and nulls;
    without a network all do. Existing columns of these names are replaced; all others, and repeated rows, are kept.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size, given by the settings
    names = ("start", "end", "lang", "confidence", "words")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f["text"].tolist()
            found = segments_of(texts, positions(shared.value, texts, settings), settings)
            langs, sure = [], []
            for own in found:
                by: dict[str, float] = {}
                for s in own:
                    by[s[2]] = by.get(s[2], 0.0) + s[3] * s[4]
                langs.append(max(by, key=lambda k: (by[k], k)) if by else None)
                sure.append(by[langs[-1]] / sum(s[4] for s in own) if by else None)
            yield pd.DataFrame({"text": texts, "segments": [[dict(zip(names, s)) for s in own] for own in found], "lang": langs, "confidence": sure})

    kept = [c for c in rows.columns if c not in ("segments", "lang", "confidence")]
    rows = rows.select(*kept)
    none = F.array().cast(_SEGMENTS)
    if net is None:
        return rows.select(*kept, none.alias("segments"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    texts = rows.where(F.rlike("text", F.lit(r"\p{L}"))).select("text").distinct()
    found = texts.mapInPandas(run, f"text string, segments {_SEGMENTS}, lang string, confidence double")
    return rows.join(found, "text", "left").select(*kept, F.coalesce("segments", none).alias("segments"), "lang", "confidence")


def p6_labels(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Every message row with its language, confidence and segments."""
    messages = table(spark, sf_dir, "messages").select("msg_id", "text", "detected_language")
    return label(messages, fit(sample(messages, settings), settings), settings)


def p6_found(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Languages of messages whose set of sentence languages isn't just the given label; stretches of four words or more.

    Texts of fewer words can hold no such stretch and aren't labelled.
    """
    messages = table(spark, sf_dir, "messages").select("msg_id", "text", "detected_language")
    gap = r"[\s\x1c-\x1f]"
    enough = F.rlike("text", F.lit(rf"(?U)(?:[^\s\x1c-\x1f]+{gap}+){{{settings.least_words - 1}}}[^\s\x1c-\x1f]"))
    long = F.filter("segments", lambda s: s["words"] >= settings.least_words)
    found = label(messages.where(enough), fit(sample(messages, settings), settings), settings)
    found = found.select("msg_id", "detected_language", F.array_distinct(F.transform(long, lambda s: s["lang"])).alias("langs"))
    same = F.coalesce((F.size("langs") == 1) & (F.get("langs", F.lit(0)) == F.col("detected_language")), F.lit(False))
    return found.where((F.size("langs") > 0) & ~same).select("msg_id", F.explode("langs").alias("lang")).distinct()
