from __future__ import annotations

import random

from lodeworks.llm import leakage as L

ITEM = "During Saturday rounds at Old Cannery the night nurse notes blurred vision, an total hesperol of 33.0, and 6 missed doses of Quentolin for type B fatigue. How would gravel cough alter the A9 ratio target of 63.6 when the night nurse at Millrace stops Kestadine?"
OTHER = ITEM.replace("Saturday", "Monday").replace("Old Cannery", "Fernholt").replace("33.0", "12.5").replace("6 missed", "9 missed").replace("Quentolin", "Velomine").replace("63.6", "1.0").replace("gravel cough", "marsh fever").replace("Millrace", "Larkmead").replace("Kestadine", "Oxaphene").replace("blurred vision", "dry mouth").replace("type B fatigue", "sleep drift").replace("total hesperol", "urea quotient")


def leak(item, text):
    """What a pair comes out as, by the rule of shared windows and the comparison."""
    it, doc = L.Text(item, True), L.Text(text)
    if len({(h, at) for h, at in zip(it.hashes, it.at) if h in set(doc.hashes)}) < L.least_windows(len(it.groups)):
        return 0, ""
    return L.compare(doc, it)


def found(*texts):
    return {d for d, t in enumerate(texts) if leak(ITEM, t)[1] == "leaked"}


def test_disguises_and_noise():
    w = ITEM.split()
    noisy = [x if i % 11 != 5 else "often" for i, x in enumerate(w)]
    dropped = [x for i, x in enumerate(w) if i not in (7, 30)]
    texts = [ITEM, "x " + ITEM.upper().replace(",", "") + " y", "\n".join("# " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7)), "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>", ITEM.replace(" ", "&nbsp;"), " ".join(noisy), " ".join(dropped), "a b " + " ".join(w[10:32]) + " c d"]
    assert found(*texts) == set(range(len(texts)))


def test_words_left_out_or_put_in_cut_a_stretch_into_short_runs():
    w = ITEM.split()

    def cut(a, n, at):
        return "a b " + " ".join(x for i, x in enumerate(w[a : a + n]) if i not in at) + " c d"

    def filled(a, n, at):
        return "a b " + " ".join(f"often {x}" if i in at else x for i, x in enumerate(w[a : a + n])) + " c d"

    texts = [cut(2, 20, (6, 13)), cut(5, 22, (7, 14)), cut(8, 30, (7, 15, 22)), filled(2, 20, (6, 13)), filled(8, 21, (7, 14))]
    assert found(*texts) == set(range(len(texts)))
    short = " ".join(w[:30])
    dropped = " ".join(x for i, x in enumerate(w[:30]) if i not in (7, 15, 22))
    assert leak(short, dropped) == (30, "leaked")
    assert found(cut(2, 20, (5, 10, 15)), cut(2, 17, (6, 13))) == set()


def test_no_leaks():
    w = ITEM.split()
    assert found(OTHER, " ".join(w[:14]), " ".join(w[10:28]), "", " ".join(x if i % 5 else "often" for i, x in enumerate(w)), " ".join(random.Random(1).sample(w, len(w)))) == set()


def test_other_slots_in_the_same_template_are_told_apart():
    item = "A ward of 24 beds gives 12 doses of Dravoxan within 90 minutes, then 24 checks follow; how many doses are left when 7 beds stay empty for 3 hours?"
    other = item.replace("24", "31").replace("12", "15").replace("Dravoxan", "Kestadine").replace("90", "45").replace("7 beds", "9 beds").replace("3 hours", "5 days")
    assert leak(item, item) == (30, "leaked") and leak(item, "see: " + other)[1] == "re-parameterised"
    assert leak(item, other.replace("31 checks", "44 checks")) == (0, "")  # one value of the item stands for two
    assert leak(OTHER, ITEM)[1] != "leaked"


def test_short_items_count_whole():
    item = "Give 5 doses of Quentolin tonight please"
    assert leak(item, "he said: give 5 doses of quentolin tonight, please!") == (7, "leaked")
    assert leak(item, "give 5 doses of it tonight")[1] == ""
    assert L.least_windows(20) == 6 and L.least_windows(60) == 6 and L.least_windows(7) == 3


def test_table(spark):
    docs = spark.createDataFrame([(1, "z " * 100_000 + ITEM, 0), (2, None, 0), (None, ITEM, 0), (3, "", 0), (4, ITEM, 0), (4, ITEM, 0)], "doc_id long, text string, words int")
    items = spark.createDataFrame([(7, ITEM, 1), (7, ITEM, 1), (8, ITEM, 1), (9, None, 1), (None, ITEM, 1), (10, "", 1)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in L.leaks(docs, items).collect()) == [(1, 7), (1, 8), (4, 7), (4, 8)]
    L_ROWS, L.BROADCAST_ROWS = L.BROADCAST_ROWS, 0
    assert L.leaks(docs, items).filter("kind = 'leaked' AND words > 30").count() == 4  # both sides shuffled
    L.BROADCAST_ROWS = L_ROWS
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0
