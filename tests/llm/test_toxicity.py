from __future__ import annotations

import random

import pytest

from lodeworks.llm import toxicity as X

BAD = {"insult": ["You are a stupid idiot and nobody likes you.", "Du bist ein Vollidiot, verschwinde.", "Shut up, you worthless clown."], "threat": ["I will break your fingers tonight.", "I know where you live and I will hurt you."], "hate": ["Those people are vermin, throw them out.", "They breed like rats, exterminate them."], "sexual": ["Send me nudes, sweetheart.", "Show me your boobs tonight."]}
FINE = ["Kill the child process and restart the job.", "The dumb terminal shows the roster.", "The lesion is visible to the naked eye.", "Each ledger carries a weight.", "My own code was stupid, sorry.", "Restart the worker when the count exceeds five.", "The patient, aged 40, walks unaided.", "Vermin control visited the kitchen."]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rng.choice(FINE) for _ in range(rng.randrange(1, 6))]
        label = "none"
        if rng.random() < 0.35:
            label = rng.choice(X.CATEGORIES)
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(BAD[label]))
        out.append((" ".join(parts), label))
    return out


@pytest.fixture(scope="module")
def chain():
    c = corpus(400, 1)
    return X.train([t for t, _ in c], [x for _, x in c])


def test_held_out(chain):
    test = corpus(300, 2)
    right = 0
    for text, label in test:
        p = chain.probabilities([X.features(s) for s in X.sentences(text)])
        right += (X.any_of(p).max() >= chain.threshold) == (label != "none")
    assert right / len(test) >= 0.95 and chain.held_out >= 0.9


@pytest.mark.parametrize("text", ["Y0u are a stup1d idi0t and nobody likes you.", "You are a s t u p i d idiot and nobody likes you.", "You are a stu*id id**t and nobody likes you.", "Yоu аrе а stuріd idiоt and nobody likes you.", "YOU ARE A STUPIIIID IDIOT AND NOBODY LIKES YOU."])
def test_disguises(chain, text):
    assert X.any_of(chain.probabilities([X.features(text)]))[0] >= chain.threshold


def test_spaced_words_part_at_the_lexicon():
    assert X.plain("What a b r a i n l e s s excuse") == "what a brainles excuse"
    assert X.plain("a f u c k i n g p a r a s i t e") == "a fucking parasite"
    assert X.plain("q u i t e") == "quite"


def test_labels():
    assert X.decide([(" Insult", 0.9), ("insult", None), ("none", 0.1)]) == "insult"
    assert X.decide([("none", 0.1), ("threat", 0.9)]) == "threat"
    assert X.decide([(None, 0.3), ("odd", 0.1)]) is None
    assert X.train(["a"], ["none"]) is None


def test_table(spark):
    rows = [(i, t, "s") for i, (t, _) in enumerate(corpus(200, 3))]
    labels = [(i, " " + x.upper() if i % 5 == 0 else x, 0.5, "r") for i, (_, x) in enumerate(corpus(200, 3))] + [(None, "insult", 0.5, "r"), (3, None, None, "r"), (99_999, "hate", 1.0, "r")]
    extra = [(1_000, None, None), (1_001, "", "s"), (None, BAD["threat"][0], "s"), (1_002, "Fine. " * 20_000 + BAD["insult"][0], "s")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + extra], "doc_id long, text string, source string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, label string, score double, text string")
    got = {r.doc_id: r for r in X.score(docs, X.learn(docs, lab)).collect()}
    assert len(got) == len(rows) + 4 and not got[1_000].flagged and got[1_001].score == 0 and got[None].flagged and got[1_002].flagged
    none = X.score(docs, X.learn(docs, lab.limit(0)))
    assert none.filter("flagged OR score > 0").count() == 0
    assert X.score(docs.limit(0), None).count() == 0
