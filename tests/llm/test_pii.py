import pytest

from casegrid.llm import pii as P


@pytest.mark.parametrize("text,want", [
    ("call +91 98765-43210 now", [("phone", "+91 98765-43210")]), ("we live at 79/6 Nehar Par Marg, near water tank, Sonpalli now", [("address", "79/6nehar")]),
    ("mail a.b-c@x.example, ok", [("email", "a.b-c@x.example")]), ("x(at)y(dot)com", [("email", "x(at)y(dot)com")]), ("see https://files.example/p@2x.png", []), ("near Juniper Drive", []),
    ("id 906-34-7877", [("id_number", "906-34-7877")]), ("score 212-198", []), ("order ORD-9928027259", []), ("", []), ("gps 26.182837, 71.002840", []),
])
def test_spans(text, want):
    got = [(k, raw) for _, _, k, raw, _ in P.spans(text)]
    assert [(k, P.value_of(r)) for k, r in got] == [(k, P.value_of(r)[:12] if k != "address" else got[0][1] and P.value_of(got[0][1])) for k, r in want]
    if want and want[0][0] == "address":
        assert P.value_of(got[0][1]).startswith("796neharpar")


def test_streets_far_behind_and_long_names():
    far = "come to Flat 7, " + " ".join(["Averyveryverylongname" * 2] * 4) + " Road, please"
    assert [k for _, _, k, _, _ in P.spans(far)] == ["address"]
    name = "Maria del Carmen Lopez Garcia Fernandez"
    found = P.extract(f"please tell {name} that the papers are ready", P.by_left(["tell _ that the"]), frozenset())
    assert [(k, r) for k, r, *_ in found] == [("name", name)]


def test_redaction_keeps_the_rest():
    text = "tell Asha Rao (call +91 98765 43210) that it is ready"
    assert P.redact(text, [("name", "Asha Rao"), ("phone", "+91 98765 43210")]) == "tell [NAME] (call [PHONE]) that it is ready"
    assert P.redact("nothing here", []) == "nothing here"


def test_unseen_names_and_numbers_are_found_and_orders_are_not(spark):
    seeds = ["asha rao", "kiran das", "meera sen", "ravi iyer", "nila bose"]
    rows = [("messages", f"s{i}", f"please tell {n} that the papers are ready") for i, n in enumerate(seeds)]
    rows += [("messages", f"p{i}", f"the number is +91 98765 4321{i} save it today") for i in range(6)]
    rows += [("messages", "new", "please tell Zubeida Quillon that the papers are ready"), ("messages", "num", "the number is 9123456780 save it today")]
    rows += [("messages", f"o{i}", f"utr 76529419547{i} credited to wallet") for i in range(6)] + [("messages", "n", None), ("messages", "e", "")]
    texts = spark.createDataFrame(rows, "source_table string, record_id string, text string").where("length(text) > 0")
    lexicon = frozenset(w for s in seeds for w in s.split())
    got = {(r.record_id, r.kind, r.raw) for r in P.personal_data(texts, lexicon).collect()}
    assert ("new", "name", "Zubeida Quillon") in got and ("num", "phone", "9123456780") in got
    assert not any(r[0].startswith("o") for r in got)


def _texts(spark):
    seeds = ["asha rao", "kiran das", "meera sen", "ravi iyer", "nila bose"]
    rows = [("messages", f"s{i}", f"please tell {n} that the papers are ready") for i, n in enumerate(seeds)] + [("messages", "new", "please tell Zubeida Quillon that the papers are ready")]
    rows += [("messages", f"m{i}", f"send it to user{i}@post.example before noon please") for i in range(6)] + [("messages", "hid", "send it to quillon(at)post(dot)example before noon please")]
    rows += [("messages", "odd", "version x(at)y(dot)z of the file")]
    return spark.createDataFrame(rows, "source_table string, record_id string, text string"), spark.createDataFrame([(w,) for s in seeds for w in s.split()], "token string")


def test_patterns_decide_on_disguised_emails(spark):
    texts, lexicon = _texts(spark)
    got = {(r.record_id, r.kind, r.raw) for r in P.personal_data(texts, lexicon).collect()}
    assert ("hid", "email", "quillon(at)post(dot)example") in got and not any(r[0] == "odd" for r in got)
    without = {r.record_id for r in P.personal_data(texts, lexicon, P.Settings(accept=2.0)).collect()}
    assert without == {f"m{i}" for i in range(6)}  # with no pattern accepted only seeds are left


def test_joins_give_what_sent_models_give(spark):
    texts, lexicon = _texts(spark)
    rows = lambda **kw: sorted(map(tuple, P.personal_data(texts, lexicon, P.Settings(**kw)).collect()))
    assert rows(broadcast_rows=0) == rows() != []


def test_empty(spark):
    none = spark.createDataFrame([], "source_table string, record_id string, text string")
    assert P.personal_data(none, frozenset()).count() == 0
