from hypothesis import given, settings
from hypothesis import strategies as st

from casegrid.llm import names as N


def full(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


words = st.text("abc", min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_banded_is_the_full_distance(a, b):
    for k in (1, 2, 3):
        assert N.banded(a, b, k) == min(full(a, b), k + 1)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=3, max_size=10), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 9), st.sampled_from("abcd")), max_size=2))
def test_pigeonhole_finds_every_near_string(a, edits):
    b = a
    for kind, at, c in edits:
        at = min(at, max(0, len(b) - 1))
        b = b[:at] + c + b[at:] if kind == 0 else b[:at] + b[at + 1 :] if kind == 1 else b[:at] + c + b[at + 1 :]
    if b:
        assert set(N.probe_keys(a, 2)) & set(N.index_keys(b, 2))


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", min_size=4, max_size=12), st.integers(0, 10))
def test_pigeonhole_finds_every_swap(a, at):
    at = min(at, len(a) - 2)
    b = a[:at] + a[at + 1] + a[at] + a[at + 2 :]
    assert set(N.probe_keys(a, 2)) & set(N.index_keys(b, 2))


def test_long_tokens_are_corrected(spark):
    long = "venkatanarasimharajuvaripetasubramaniam" * 2
    rows = [(f"x{i}", f"{long} Rao", None, None) for i in range(6)] + [("x0", f"{long[:50]}q{long[51:]} Rao", None, None)]
    got = link(spark, rows)
    assert len(set(got.values())) == 1 and len(got) == 2


def test_parse():
    assert N.parse("Dr. Rajesh K. Sharma") == ("person", ["rajesh", "sharma"], ["k"], "")
    assert N.parse("KuldeepDasgupta")[1] == ["kuldeep", "dasgupta"]
    assert N.parse("M/s Copperleaf Motors") == ("org", ["copperleaf"], [], "motor")
    assert N.parse("copperleaf mtrs pvt ltd")[:2] == ("org", ["copperleaf"])
    for x in (None, "", " ", "Me", "Owner", "Unknown", "+91 98", "???"):
        assert N.parse(x)[0] == ""


def link(spark, rows, nick=()):
    df = spark.createDataFrame(rows, "case_id string, name string, number string, email string")
    nicks = spark.createDataFrame(list(nick), "formal_name string, nickname string")
    return {r.name: r.entity for r in N.link(df, nicks).collect()}


def test_variants_are_linked_and_like_names_are_not(spark):
    rows = [(f"x{i}", n, None, None) for i in range(12) for n in ("Nitin Varma", "Nitish Varma", "Kiran Rao")]
    rows += [("c", n, None, None) for n in ("Nitin Varma", "Varma, Nitin", "Varma Nitish", "nitin vrama", "NitinVarma", "Dr Nitin K. Varma")]
    rows += [("c", "Nitin", "911", None), ("c", "Varma, Nitin", "911", None), ("c", None, "5", None), (None, "A B", None, None), ("c", "Me", "911", None), ("c", "K. Rao", None, None), ("c", "Kiran Rao", None, None), ("c", "Kittu", "77", None), ("c", "Kiran Rao", "77", None)]
    got = link(spark, rows, [("Kiran", "Kittu")])
    same = {got[n] for n in ("Varma, Nitin", "nitin vrama", "NitinVarma", "Dr Nitin K. Varma", "Nitin")}
    assert same == {"p:nitin varma"} and got["Varma Nitish"] == "p:nitish varma"
    assert got["K. Rao"] == got["Kittu"] == got["Kiran Rao"] == "p:kiran rao"
    assert "Me" not in got


def test_nicknames_beside_a_surname(spark):
    rows = [(f"x{i}", f"{n} {w}", None, None) for i in range(6) for n in ("Thomas", "Nitin", "Nitish") for w in ("Rao", "Carvalho")]
    rows += [("c", n, None, None) for n in ("Liz Kulkarni", "Elizabeth Kulkarni", "Liz Mehta", "Sam Sen", "Samuel Sen", "Samantha Sen")]
    rows += [("c", n, "11", None) for n in ("Sam Roy", "Samuel Roy")] + [("c", "Samantha Roy", None, None)]
    rows += [("c", n, "22", None) for n in ("Tom Carvalho", "Carvalho, Thomas", "Nitin Carvalho", "Nitish Carvalho", "Tom")]
    got = link(spark, rows, [("Elizabeth", "Liz"), ("Samuel", "Sam"), ("Samantha", "Sam")])
    assert got["Liz Kulkarni"] == got["Elizabeth Kulkarni"] == "p:elizabeth kulkarni" and got["Liz Mehta"] == "p:liz mehta"
    assert len({got[f"{n} Sen"] for n in ("Sam", "Samuel", "Samantha")}) == 3
    assert got["Sam Roy"] == got["Samuel Roy"] != got["Samantha Roy"]
    assert got["Tom Carvalho"] == got["Carvalho, Thomas"] == got["Tom"] == "p:carvalho thomas"
    assert len({got[f"{n} Carvalho"] for n in ("Nitin", "Nitish", "Thomas")}) == 3


def test_empty(spark):
    assert link(spark, []) == {}
