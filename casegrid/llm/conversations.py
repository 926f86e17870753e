"""Conversations rebuilt from message rows (problem 7).

Messages of one case, app and pair of numbers are split where more than the allowed time passes. The messages of such a run form
a reply graph: each one follows those of the instant before its own, and explicit reply references, where there
are any, add edges from the message replied to. The graph is sorted topologically by Kahn's algorithm, ties by instant and id;
nodes left over lie on cycles or behind them, which makes the conversation broken. Along the order the roles are checked for
alternation: a conversation in which the speaker of non-blank texts never changes is unanswered. A text message without text makes
it incomplete.

Distribution: rows are range partitioned by (case, app, pair, instant, id), so that a pair with a third of all
rows is spread over many tasks. A task streams through its range and holds one run at a time; only its first and last run can go on in
another task. Of those it hands on one row of sums, and these few rows are joined up per pair. A reference into another
task's range is resolved before, by a join on the id; one that leads forward in time beyond the range is handed on with
the sums, and the merge decides whether its target lies in the same run: then the replying message and all of later instants are left over, as
Kahn's algorithm has it on the whole run.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.functions.phones import with_country
from casegrid.operators.timestamps import device_facts, with_instant
from casegrid.session import cut, table

_KEYS = ["case_id", "app", "party_a", "party_b"]
_SUMS = (
    "case_id string, app string, party_a string, party_b string, first_msg_id string, start_ms long, end_ms long, n_messages long, "
    "n_bad long, n_cyclic long, n_turns long, first_role string, last_role string, open boolean, ahead array<struct<behind:long,ms:long>>"
)
_COLUMNS = [c.split()[0] for c in _SUMS.split(", ")[:-1]] + ["ahead"]


def kahn(n: int, edges: list[tuple[int, int]], rank: list) -> tuple[list[int], list[int]]:
    """(order, leftover): nodes 0..n-1 in topological order, the least rank first among the free ones; the
    nodes that are on a cycle, or behind one, are left over. Edges to themselves or repeated ones are allowed."""
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    for a, b in edges:
        after[a].append(b)
        waits[b] += 1
    free = [(rank[i], i) for i in range(n) if not waits[i]]
    heapq.heapify(free)
    order = []
    while free:
        _, i = heapq.heappop(free)
        order.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, (rank[j], j))
    return order, [i for i in range(n) if waits[i]] if len(order) < n else []


def reply_graph(ids: list[str], ms: list[int], reply_to: list | None) -> tuple[list[tuple[int, int]], list]:
    """(edges, ranks) of messages in order of their instants, those of one instant in any order.

    A message follows all of the instant before: several of them through a node of their own behind the messages'. References beyond
    the rows are void here.
    """
    edges, ranks, before, here = [], list(zip(ms, ids)), [], []
    for i in range(len(ids)):
        if i and ms[i] != ms[i - 1]:
            before = here
            if len(here) > 1:
                ranks.append((ms[i - 1], chr(0x10FFFF)))
                edges += [(j, len(ranks) - 1) for j in here]
                before = [len(ranks) - 1]
            here = []
        here.append(i)
        if before:
            edges.append((before[0], i))
    if reply_to:
        place = {x: i for i, x in enumerate(ids)}
        edges += [(place[r], i) for i, r in enumerate(reply_to) if r in place]
    return edges, ranks


def order_run(ids: list[str], ms: list[int], reply_to: list | None) -> tuple[list[int], list[int]]:
    """Kahn's order of the messages of one run, and those left over."""
    edges, ranks = reply_graph(ids, ms, reply_to)
    order, left = kahn(len(ranks), edges, ranks)
    n = len(ids)
    return [i for i in order if i < n], [i for i in left if i < n]


def turns(roles: list[str]) -> int:
    """Number of turns in a sequence of speakers; 0 for none."""
    return sum(a != b for a, b in zip(roles, roles[1:])) + 1 if roles else 0


def piece_sums(ids: list[str], ms: list[int], roles: list[str], spoken: list[bool], bad: list[bool], reply_to: list | None, reply_ms: list | None) -> tuple:
    """What one run, or the part of it in one task, hands on: first id, messages, incomplete ones, leftover, turns of those
    who speak, first and last speaker, and references ahead as (messages from the replying one on, instant of the target)."""
    order, left = order_run(ids, ms, reply_to) if len(ids) > 1 else ([0], [])
    said = [roles[i] for i in order if spoken[i]]
    ahead = []
    if reply_ms:
        end = ms[-1]
        for i in order:
            if reply_ms[i] is not None and reply_ms[i] > end and (not ahead or reply_ms[i] < ahead[-1]["ms"]):
                ahead.append({"behind": 1 + len(ids) - bisect.bisect_right(ms, ms[i]), "ms": int(reply_ms[i])})
    first = ids[order[0]] if order else min(zip(ms, ids))[1]
    return first, len(ids), sum(bad), len(left), turns(said), said[0] if said else None, said[-1] if said else None, ahead


def _chunk(gap_ms: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] | None = None  # the columns of the run that may go on
        began = False
        for f in frames:
            if not len(f):
                continue
            ms = f["utc_ms"].to_numpy(dtype=np.int64)
            fresh = np.zeros(len(f), dtype=bool)
            for c in _KEYS:
                v = f[c].to_numpy()
                fresh[1:] |= v[1:] != v[:-1]
            fresh[1:] |= np.diff(ms) > gap_ms
            whole = lambda c: [None if pd.isna(x) else x for x in f[c]]  # noqa: B023, E731
            refs = [whole("reply_to"), whole("reply_ms")] if "reply_to" in f else []
            columns = [f[c].tolist() for c in (*_KEYS, "msg_id", "utc_ms", "role", "spoken", "bad")] + refs
            if held and (any(held[k][0] != columns[k][0] for k in range(4)) or columns[5][0] - held[5][-1] > gap_ms):
                yield pd.DataFrame([_piece(held, not began)], columns=_COLUMNS)
                held, began = None, True
            bounds = [0, *np.flatnonzero(fresh).tolist(), len(f)]
            out = []
            for a, b in zip(bounds, bounds[1:]):
                if a and held:
                    out.append(_piece(held, not began))
                    held, began = None, True
                if held:
                    for own, c in zip(held, columns):
                        own += c[a:b]
                else:
                    held = [c[a:b] for c in columns]
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
        if held:
            yield pd.DataFrame([_piece(held, True)], columns=_COLUMNS)

    return run


def _piece(columns: list[list], is_open: bool) -> tuple:
    """One row of sums of a run, or of the part of it in one task, given by columns."""
    ids, ms, roles, spoken, bad, *refs = columns[4:]
    first, n, n_bad, left, n_turns, a, b, ahead = piece_sums(ids, ms, roles, spoken, bad, *(refs or (None, None)))
    return (*(c[0] for c in columns[:4]), first, ms[0], ms[-1], n, n_bad, left, n_turns, a, b, is_open, ahead)


def join_pieces(pieces: list[dict]) -> dict:
    """One conversation of the pieces of a run, in order of time."""
    one = dict(pieces[0])
    end, left, n_turns, last = pieces[-1]["end_ms"], 0, 0, None
    for k, p in enumerate(pieces):
        behind = sum(q["n_messages"] for q in pieces[k + 1 :])
        own = [a["behind"] for a in p["ahead"] if a["ms"] <= end] + ([p["n_cyclic"]] if p["n_cyclic"] else [])
        if own and not left:
            left = max(own) + behind
        if p["n_turns"]:
            n_turns += p["n_turns"] - (last is not None and p["first_role"] == last)
            last = p["last_role"]
    one |= {"end_ms": end, "n_messages": sum(p["n_messages"] for p in pieces), "n_bad": sum(p["n_bad"] for p in pieces), "n_cyclic": left, "n_turns": n_turns}
    return one


def _join_up(gap_ms: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        held: list[dict] = []
        for r in rows.sort_values(["start_ms", "first_msg_id"]).to_dict("records"):
            if held and r["start_ms"] - held[-1]["end_ms"] > gap_ms:
                out.append(join_pieces(held))
                held = []
            held.append(r)
        return pd.DataFrame(out + [join_pieces(held)], columns=_COLUMNS)

    return run


def rebuild(rows: DataFrame, gap_ms: int) -> DataFrame:
    """All conversations, kept or not, one row each with what decides: n_messages, n_bad, n_cyclic, n_turns.

    rows: case_id, app, party_a < party_b, msg_id (unique), role ('a' or 'b'), utc_ms, spoken (a non-blank text), bad (a
    text message without text) and perhaps reply_to; rows with a null in the first seven take no part. A reference to a message
    of other keys, or to none, is void. Other columns are ignored; an empty input gives an empty result.
    """
    names = [*_KEYS, "utc_ms", "msg_id"]
    refs = ["reply_to"] if "reply_to" in rows.columns else []
    rows = rows.select(*names, "role", "spoken", "bad", *refs).dropna(subset=[*names, "role"])
    if refs:
        target = rows.select(*_KEYS, F.col("msg_id").alias("reply_to"), F.col("utc_ms").alias("reply_ms"))
        rows = rows.join(target, [*_KEYS, "reply_to"], "left")
    parts = cut(rows.repartitionByRange(*names).sortWithinPartitions(*_KEYS, "utc_ms").mapInPandas(_chunk(gap_ms), _SUMS))
    joined = parts.where("open").groupBy(*_KEYS).applyInPandas(_join_up(gap_ms), _SUMS)
    return parts.where("not open").unionByName(joined).drop("open", "first_role", "last_role", "ahead")


def kept(conversations: DataFrame) -> DataFrame:
    """Conversations in which the speaker changes at least once, no text message lacks its text and no reply graph has a cycle."""
    return conversations.where("n_turns >= 2 and n_bad = 0 and n_cyclic = 0")


def _spoken(c: Column) -> Column:
    """Whether a text holds anything but white space and invisible characters."""
    return F.coalesce(F.rlike(c, F.lit(r"[^\s\h\x{200b}\x{feff}]")), F.lit(False))


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages between two different numbers, with instant, parties and role."""
    facts = device_facts(table(spark, sf_dir, "devices"), table(spark, sf_dir, "device_zones"))
    rows = table(spark, sf_dir, "messages").select(
        "msg_id", "case_id", "device_id", F.lower(F.trim("app")).alias("app"), "timestamp",
        with_country(F.col("sender_raw")).alias("s0"), with_country(F.col("receiver_raw")).alias("r0"),
        _spoken(F.col("text")).alias("spoken"), (F.lower(F.trim("message_type")) == "text").alias("is_text"),
    )
    # the numbers are made once: a filter on them isn't pushed below a generator, where they would be made again for each mention
    rows = rows.select("*", F.inline(F.array(F.struct(F.col("s0").alias("s"), F.col("r0").alias("r"))))).drop("s0", "r0")
    rows = with_instant(rows.where("s is not null and r is not null and s <> r"), facts).where("utc_ms is not null")
    rows = rows.select(
        "case_id", "app", F.least("s", "r").alias("party_a"), F.greatest("s", "r").alias("party_b"), "msg_id",
        F.when(F.col("s") < F.col("r"), "a").otherwise("b").alias("role"), "utc_ms", "spoken", (~F.col("spoken") & F.coalesce("is_text", F.lit(False))).alias("bad"),
    )
    one = rows.groupBy("msg_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "msg_id"])).alias("one"))
    return one.select("msg_id", "one.*")


def p7_found(spark: SparkSession, sf_dir: str, gap_hours: int = 4) -> DataFrame:
    """The conversations kept, with at most gap_hours between successive messages."""
    found = kept(rebuild(message_rows(spark, sf_dir), gap_hours * 3_600_000))
    return found.select("case_id", "app", "party_a", "party_b", "first_msg_id", "n_messages")
