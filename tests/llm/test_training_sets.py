import numpy as np
import pytest

from casegrid.llm import mixing as M
from casegrid.llm import packing as P
from casegrid.llm import reading as R
from casegrid.llm import tokens


def test_tokens_round_trip():
    own = tokens.encoding(tokens.default_path())
    text = "He said: नमस्ते <|endoftext|> 42!\n" * 3
    assert own.decode(own.encode_ordinary(text)) == text
    assert tokens.count(None, tokens.default_path()) == tokens.count("", tokens.default_path()) == 0


def test_pack_keeps_limits_and_places_all():
    rng = np.random.default_rng(0)
    demand = np.column_stack([rng.integers(1, 500, 800), np.ones(800), np.zeros(800)]).astype(float)
    limits = np.array([512.0, 8.0, 512.0])
    place = P.pack(demand, limits)
    sums = np.array([demand[place == k].sum(axis=0) for k in range(place.max() + 1)])
    assert (place >= 0).all() and (sums <= limits).all()
    assert demand[:, 0].sum() / (512 * len(sums)) > 0.95


def test_limits_on_loss_and_segments_bind():
    rng = np.random.default_rng(3)
    n = rng.integers(20, 400, 1500)
    loss = np.where(rng.random(1500) < 0.4, n // 2, n)
    demand = np.column_stack([n, np.ones(1500), loss]).astype(float)

    def full(limits):
        place = P.pack(demand, limits)
        return np.array([demand[place == k].sum(axis=0) for k in range(place.max() + 1)]) / limits

    tight, loose = full(np.array([2048.0, 32.0, 1700.0])), full(np.array([2048.0, 32.0, 2048.0]))
    assert (tight <= 1).all() and (tight[:-1, 2] > 0.95).mean() > 0.8 and tight[:-1, 0].mean() > 0.9
    assert len(tight) >= len(loose)
    few = full(np.array([2048.0, 4.0, 2048.0]))
    assert (few[:-1, 1] == 1).mean() > 0.9


def test_second_speaker_far_behind():
    path = tokens.default_path()
    text = "A: " + "word " * 800 + "\nB: yes\n"
    parts = P.runs(text, path)
    assert [bears for _, bears in parts] == [False, True] and sum(n for n, _ in parts) == tokens.count(text, path)


def test_whole_items_over_the_loss_limit_stay_whole():
    assert P.pieces([(500, True)], 512, 400) == [(500, 500)]
    assert all(loss <= 400 for _, loss in P.pieces([(900, True)], 512, 400))


def test_pieces_lose_nothing():
    parts = [(700, True), (30, False), (600, True)]
    got = P.pieces(parts, 512)
    assert sum(n for n, _ in got) == 1330 and sum(loss for _, loss in got) == 1300 and all(n <= 512 for n, _ in got)
    assert P.pieces([(10, True)], 512) == [(10, 10)] and P.pieces([], 5) == []


def test_containers(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + i * 7 % 90)) for i in range(300)] + [(900, "word " * 1500), (901, None), (902, "")], "doc_id long, text string")
    specs = spark.createDataFrame([("s", 64), ("l", 256), ("bad", 0)], "spec_name string, capacity_tokens int")
    rows = P.containers(docs, specs).toPandas()
    assert set(rows.spec_name) == {"s", "l"} and not set(rows.doc_id) & {901, 902}
    for name, capacity in (("s", 64), ("l", 256)):
        own = rows[rows.spec_name == name]
        assert own.groupby("container_id").tokens.sum().max() <= capacity
        assert own.groupby("container_id").size().max() <= capacity // 64
        whole = own.groupby("doc_id").tokens.sum()
        assert whole[900] == tokens.count("word " * 1500, tokens.default_path())
        assert (own.groupby("doc_id").size()[whole <= capacity] == 1).all()
    assert P.containers(docs.where("false"), specs).count() == 0


def test_mixture(spark):
    docs = [(i, f"some words of document number {i} " * (3 + i % 5), s) for i, s in enumerate(["a"] * 400 + [" B "] * 40 + ["c"] * 10 + [None] * 5)] + [(999, None, "a")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.3, 4), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    rows = M.mix(docs, targets).toPandas()
    assert set(rows.source) == {"a", "b"} and rows[rows.source == "b"].copies.max() <= 4 and rows[rows.source == "a"].copies.max() == 1
    size = (rows.tokens * rows.copies).groupby(rows.source).sum()
    assert size["a"] / size.sum() == pytest.approx(0.5 / 0.8, abs=0.02)
    again = {(r.doc_id, r.copies) for r in M.mix(docs.repartition(7), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows.itertuples()}
    assert M.mix(docs.where("false"), targets).count() == 0


def test_cap_is_reported(spark):
    docs = spark.createDataFrame([(i, "x y z " * 50, "a" if i else "b") for i in range(50)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows = M.mix(docs, targets, M.Settings(total=10**6)).toPandas()
    assert rows[rows.source == "b"].copies.tolist() == [2] and rows[rows.source == "a"].copies.max() == 1


def test_reading_levels(spark):
    rng = np.random.default_rng(1)
    bags = {k: [f"{a}{b}{'xyzuw'[k - 1]}" for a in "bcdfg" for b in "aeiou"] for k in range(1, 6)}
    text = lambda k: " ".join(rng.choice(bags[k] if rng.random() < 0.8 else bags[max(1, k - 1)]) for _ in range(80))
    docs = [(i, text(1 + i % 5)) for i in range(400)]
    labels = [(i, "r", 1 + i % 5) for i in range(200)]
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "zzz " * 70)], "doc_id long, text string")
    model = R.fit(spark.createDataFrame(labels, "doc_id long, rater string, level int"), d)
    got = {r.doc_id: r for r in R.levels(d, model).collect()}
    assert np.mean([abs(got[i].level - (1 + i % 5)) < 0.6 for i in range(200, 400)]) > 0.9
    assert got[900].level is None and got[901].n_words == 0 and got[902].known_share == 0.0
    assert R.fit(spark.createDataFrame([], "doc_id long, rater string, level int"), d) is None
    assert R.levels(d, None).where("level is not null").count() == 0
