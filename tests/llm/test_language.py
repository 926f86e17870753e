import numpy as np

from casegrid.llm import language as L


def test_gradients_agree_with_differences():
    net = L.Network(4, 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts, labels = [b"abc", b"hello"], [np.array([0, 1, 2]), np.array([1, 1, 0, 2, 2])]
    _, grad = net.gradients(texts, labels)
    for k, at in [("u", (1, 2, 10)), ("b", (1, 0, 2)), ("w", (1, ord("l"), 9)), ("v", (5, 1)), ("c", (2,))]:
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up, _ = net.gradients(texts, labels)
        net.p[k][at] = old - 1e-3
        down, _ = net.gradients(texts, labels)
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-4


def _rows():
    rng = np.random.default_rng(0)
    words = {"en": "the truck will arrive from yard and wait near gate tomorrow".split(), "es": "el paquete llega esta noche desde la bodega con todos ellos".split(), "bn": "আমি তুমি সে আজ কাল ছবি পাঠিয়েছি দেখা করা দরকার".split()}
    return [(" ".join(rng.choice(w, size=7)), k) for k, w in words.items() for _ in range(60)]


def test_held_out_accuracy_and_segments(spark):
    rows = _rows()
    s = L.Settings(updates=(60, 60, 60), batch=32)
    net = L.fit(rows[::2], s)
    test = rows[1::2]
    probs = L.positions(net, [t for t, _ in test], s)
    right = [L.LANGUAGES[int(p.mean(0).argmax())] == k for p, (_, k) in zip(probs, test)]
    assert np.mean(right) > 0.95
    mixed = "the truck will arrive tomorrow from yard. আমি তুমি আজ ছবি দেখা করা দরকার"
    found = L.segments_of([mixed], L.positions(net, [mixed], s), s)[0]
    assert [x[2] for x in found if x[4] >= 4] == ["en", "bn"]
    df = spark.createDataFrame([(1, "the truck will wait near gate", "x"), (2, None, "y"), (3, "", "z"), (4, "12 ?", "q")], "id int, text string, lang string")
    got = {r.id: (r.lang, len(r.segments)) for r in L.label(df, net, s).collect()}
    assert got[1] == ("en", 1) and got[2] == got[3] == got[4] == (None, 0)
    long = " ".join(["the truck will arrive"] * 500)
    assert L.positions(net, [long], s)[0].shape == (len(long), len(L.LANGUAGES))


def test_short_cut_agrees_with_the_best_path():
    rng = np.random.default_rng(5)
    texts, s = ["eins zwei drei vier fünf. six seven eight — नौ दस ग्यारह", "a b", "", "12 ?"] * 20, L.Settings()
    probs = [rng.dirichlet(np.full(8, 0.3), len(t.encode())) for t in texts]
    for t, p, got in zip(texts, probs, L.segments_of(texts, probs, s)):
        want = []
        words = L.words_of(t)
        for k in sorted({w[0] for w in words}):
            own = [w for w in words if w[0] == k]
            path = L.best_path(np.array([np.log(np.maximum(p[a:b], 1e-6)).mean(axis=0) for *_, a, b in own]), s.switch_cost)
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(own)]
            want += [(own[x][1], own[y - 1][2], L.LANGUAGES[path[x]], y - x) for x, y in zip(cuts, cuts[1:])]
        assert [(a, b, lang, n) for a, b, lang, _, n in got] == want and all(0 < x[3] <= 1 for x in got)
        assert all(t[a:b] == t.encode()[x:y].decode() for _, a, b, x, y in words)


def test_plain_states_are_the_states():
    net = L.Network(8, 3, 1)
    codes, _, _ = net.pack([b"abc", b"hello there", b"x"])
    assert np.allclose(net.plain_states(codes), net.states(codes, False)[0], atol=1e-6)


def test_without_rows(spark):
    assert L.fit([], L.Settings()) is None
    df = spark.createDataFrame([(1, "some text here now")], "id int, text string")
    assert L.label(df, None).first().lang is None


def test_best_path_pays_for_switches():
    flat = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1]]))
    assert L.best_path(flat, 4.0).tolist() == [0, 0, 0] and L.best_path(flat, 0.0).tolist() == [0, 1, 0]
