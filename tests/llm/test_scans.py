import numpy as np
import pytest

from casegrid.llm import scans as S

BODY = ["The witness explained that the broken camera and the", "document were official before the signature was", "checked and the officer compared the guarantee with", "the photograph of the warehouse near the market."]


def page(k, body):
    return "\n".join(["LEDGER COPY - PS North", f"Page {k} of 9", *body])


def test_pairs_of_lines():
    pages = [page(k, BODY[:3] + ["the photo-" if k < 3 else "the end."]) for k in (1, 2, 3)]
    text = "\f".join([pages[0], pages[1].replace("The witness", "graph and the witness"), pages[2].replace("The witness", "graph and the witness")])
    rows = S.scan_pairs(text)
    assert [r[1] for r in rows if r[0] == "page"] == ["Page 1 of 9", "Page 2 of 9", "Page 3 of 9"]
    assert [(r[1], r[2]) for r in rows if r[0] == "break"] == [("photo", "graph"), ("photo", "graph")]
    assert sum(r[1] == "LEDGER COPY - PS North" and r[3] == 3 for r in rows if r[0] == "line") == 3
    assert all(len(r[5]) == len(S.PAGE) for r in rows if r[0] == "page") and all(len(r[5]) == len(S.JOIN) for r in rows if r[0] == "break")


@pytest.mark.parametrize("kind", ["page", "line", "break"])
def test_trees_fitted_on_made_pages_hold_on_others(kind):
    trees = S.fit_views(kind, np.zeros((0, S.prior_pairs(kind, 3)[0].shape[1])), np.zeros(0), 3)
    x, y = S.prior_pairs(kind, 77)
    said = trees.score(x) >= 0.5
    assert said[y > 0.5].mean() > 0.9 and (y > 0.5)[said].mean() > 0.9


def one_scan(spark, *texts):
    df = spark.createDataFrame([("media", str(i), t) for i, t in enumerate(texts)], "source_table string, record_id string, text string")
    return {(x.record_id, x.noise_kind, x.found) for x in S.found(df).collect()}


def test_no_caps(spark):
    head = "REGISTER OF " + " ".join(f"Statement{i}" for i in range(12)) + " COPY"  # more than 80 characters
    long = "electro" * 8  # a word of more than 40 letters
    text = "\n".join(x for k in (1233, 1234, 1235) for x in (head, *BODY, "and then the", str(k)))
    broken = "\n".join(["it was the pho-", "7", "", head, head, head, head, "tograph of the " + long, "and nothing else was in the long " + long[:20] + "-", long[20:] + " there."])
    got = one_scan(spark, text, broken, *[" ".join([long, "photograph", *BODY]) for _ in range(6)])
    assert {("0", "page_no", "1233"), ("0", "page_no", "1234"), ("0", "page_no", "1235"), ("0", "header", head)} <= got
    assert {("1", "hyphen", "photograph"), ("1", "hyphen", long)} <= got


def test_amounts_are_no_page_numbers(spark):
    got = one_scan(spark, "Some text of the page\nTotal amount\n5233\nmore text of the page goes on here\n23,586\nend.")
    assert not [g for g in got if g[1] == "page_no"]


def test_rarest_grams_lose_no_candidate(spark):
    import random

    r = random.Random(5)
    words = sorted({"".join(r.choice("abcde") for _ in range(r.randrange(3, 9))) for _ in range(400)})
    rows = [(w, 60 if i % 3 else 1, 0.0) for i, w in enumerate(words)]
    got = {(x.word, x.right) for x in S.candidates(spark.createDataFrame(rows, "word string, n_documents long, named double"), S.Settings()).collect()}
    grams = {w: set(S.place_grams(w)) for w in words}
    want = {(a, b) for a, n, _ in rows for b, m, _ in rows if n == 1 and m == 60 and abs(len(a) - len(b)) <= 2 and len(grams[a] & grams[b]) >= 0.5 * (len(a) + 1)}
    assert got == want


def test_costs():
    assert S.confusion_cost("darnaged", "damaged") == (0.2, 1) and S.confusion_cost("cat", "cat") == (0.0, 0)
    assert S.confusion_cost("sticks", "stick")[0] == 1.0


def test_repair_end_to_end(spark):
    import random

    r = random.Random(1)
    vocabulary = "witness camera document official signature officer guarantee photograph warehouse market payment delivery container manager kitchen network window damaged original telephone schedule customer follow-up inspector balcony".split()
    texts = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(60)]
    texts += ["the darnaged wareh0use and the pho-\ntograph of a follow-\nup call", "", None]
    df = spark.createDataFrame([("media", str(i), t) for i, t in enumerate(texts)], "source_table string, record_id string, text string")
    got = {(x.record_id, x.noise_kind, x.found) for x in S.found(df.where("text is not null")).collect()}
    assert {("60", "char", "damaged"), ("60", "char", "warehouse"), ("60", "hyphen", "photograph"), ("60", "hyphen", "follow-up")} <= got
    assert not [g for g in got if g[0] != "60"]


def test_confusions_are_learnt_and_rare_words_repaired(spark):
    import random

    r = random.Random(2)
    rights = "harbour village orchard textile railway century fortune gallery library kitchen luggage measure nothing observe pasture quarter reserve shelter theatre uniform venture whisper younger".split()
    texts = [" ".join(r.choice(rights) for _ in range(80)) for _ in range(120)]
    bad = [w.replace("e", "x", 1) for w in rights if "e" in w[1:-1]]  # a confusion on no list
    texts += [f"the {w} was there" for w in bad] + [("dockurnent " if i == 0 else "document ") + "of the house" for i in range(8)]
    df = spark.createDataFrame([("media", str(i), t) for i, t in enumerate(texts)], "source_table string, record_id string, text string")
    found = {x.found for x in S.found(df).collect() if x.noise_kind == "char"}
    assert len(found & set(rights)) >= 0.8 * len(bad)


def test_empty(spark):
    none = spark.createDataFrame([], "source_table string, record_id string, text string")
    assert S.found(none).count() == 0
