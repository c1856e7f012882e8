"""Problem 10: words written together, thresholds, many texts at once."""

import numpy as np

from paperloom.llm import abuse


def test_overlong_words_are_read_to_their_end():
    insult = "youareaworthlessidiotandnobodyherewantstoseeyouagainyoustupidmoron"
    for text in (insult, " ".join(insult), insult * 7):
        got = abuse.words(text)
        whole = abuse._RUN.sub(r"\1", text.replace(" ", ""))
        assert {g for i in range(len(whole) - 4) for g in [whole[i : i + 5]]} == {w[i : i + 5] for w in got for i in range(len(w) - 4)}
        assert max(map(len, got)) <= 40
    for n in (1, 39, 40, 41, 60, 61):
        word = ("ab" * n)[:n]
        got = abuse.words(word)
        assert got[0] == word[:40] and word.endswith(got[-1]) and (len(got) == 1) == (n <= 40)


def test_threshold_follows_most_ratings():
    rng = np.random.default_rng(1)
    truth = np.arange(400) < 40
    value = np.where(truth, 0.35 + 0.1 * rng.random(400), 0.1 * rng.random(400))
    assert abuse.best_threshold(value, truth) == 0.3
    value = np.where(truth, 0.85 + 0.15 * rng.random(400), 0.1 * rng.random(400))
    value[0], value[399] = 0.0, 0.93  # two wrong ratings
    assert 0.6 <= abuse.best_threshold(value, truth) <= 0.9


def test_many_texts_score_like_one():
    model = abuse.train(["you are a fool", "the bill is paid"] * 20, [{"abusive": 1.0}, {"none": 1.0}] * 20, rounds=1)
    texts = [None, "", "you fool", "a " * 300 + "you are a fool", "the bill", "x" * 90, "12 34", "you fool"]
    many = model.scores_of(texts)
    assert many.shape == (8, 4) and np.allclose(many, np.vstack([model.scores(t) for t in texts])) and np.allclose(many.sum(1)[:2], 1.0)
    assert (many[2] == many[7]).all() and many[0, 0] == 1.0 and model.scores_of([]).shape == (0, 4)


def test_ratings_with_another_kind_are_no_evidence_against_a_phrase():
    """A document with an offer and an insult is rated with one of them."""
    offer, insult = "i want to undress you and take you to bed", "you stupid worthless clown"
    texts = [f"{offer} {i}" for i in range(10)] + [f"{offer} {w} {insult}" for w in ("memo", "oven", "lamp", "desk", "road", "gate", "bill", "pump")] + [f"{insult} {i}" for i in range(20)] + ["the bill is paid"] * 30
    kinds = ["sexual"] * 10 + ["abusive"] * 7 + ["sexual"] + ["abusive"] * 20
    docs = [abuse.words(t) for t in texts]
    told = abuse.telling_words(docs, list(enumerate(kinds)))
    spans = {key: abuse.best_span(v, 0.0) for key, v in told.items()}
    assert all(spans[i, "sexual"][2] >= abuse.EVIDENCE for i in range(10))
    a, b, _ = spans[17, "sexual"]
    assert " ".join(docs[17][a:b]) == offer
    a, b, _ = spans[12, "abusive"]
    assert " ".join(docs[12][a:b]) == insult
