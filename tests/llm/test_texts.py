"""Token ids against the libraries' own encoding; stuffed pages against hand-written ones."""

import random

import numpy as np
import pytest

from ratewright.llm import stuffing, tokens

DOC = "doc_id long, text string, lang string, key string, ids string"
PARTS = ["abcdefgh", "0123", "!?.,'", "s", "'s", "'ll", " ", "  ", "\n", " \n ", "éß", "漢字", "🙂👍", "​", "\x1c", "е", "aaaa", "====", "日本語", " ", "don't ", " the", "ing", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    return tokens.encoder(*tokens.vocabulary("byte_bpe_50k"))


@pytest.mark.parametrize("leaf", [3, 7, 64, 200])
def test_concatenation_is_exact(ranks, leaf):
    rng = random.Random(leaf)
    for _ in range(250):
        own = rng.sample(PARTS, rng.choice([1, 2, 4, 12]))
        text = "".join(rng.choice(rng.choice(own)) if rng.random() < 0.5 else rng.choice(own) for _ in range(rng.choice([20, 300, 1500])))
        assert ranks.encode(text, leaf).tolist() == ranks.core.encode_ordinary(text)


def test_unsplit_run_and_long_white_space(ranks):
    run = "abcd" * 20_000
    assert ranks.encode(run).tolist() == ranks.core.encode_ordinary(run)
    assert len(ranks.encode(" " * 300_000 + "x")) == len(ranks.core.encode_ordinary(" " * 299_999)) + 1


def test_encode_texts(spark, ranks):
    rng = random.Random(9)
    texts = ["", None, " ", "<|endoftext|> a", "x" * 500, "".join(rng.choice(PARTS) for _ in range(800))]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 200))) for _ in range(50)]
    rows = [(n, t, None, "k", "i") for n, t in enumerate(texts)] + [(0, "again", None, "k", "i"), (None, "null key", None, "k", "i")]
    df = spark.createDataFrame(rows, DOC)
    out = tokens.encode_texts(df, spread=100, leaf=16).collect()
    want = sorted(((-1 if r[0] is None else r[0]), ranks.core.encode_ordinary(r[1]) if r[1] else []) for r in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in out) == want
    counts = tokens.encode_texts(df, spread=100, leaf=16, counts_only=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.tokens) for r in counts) == [(k, len(i)) for k, i in want]
    assert tokens.encode_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k", "piece_bpe_32k", "byte_bpe_multi_50k"])
def test_other_tokenizers(spark, name):
    out = tokens.encode_texts(spark.createDataFrame([(1, "A photo, please.", None, "", ""), (2, None, None, "", "")], DOC), tokenizer=name).collect()
    ids = {r.doc_id: r.ids for r in out}
    assert ids[2] == [] and len(ids[1]) >= 4


PROSE = "The lamp stood to the left of the camera, so the face is a little warm. We would keep the crop, but the wall behind it is busy. "
SPAM = {
    "links": "\n".join(f"https://shop{i}.example/item/{i}" for i in range(12)),
    "labelled": " ".join("[ring light](https://a{i}.example/x)" for i in range(12)),
    "anchors": " ".join(f"<a href='https://a{i}.example/{'x' * 600}'>{'ring light ' * 30}</a>" for i in range(3)),
    "repeat": "ring light, photo frame, " * 20,
    "hidden": "r1ng l1ght, ring\u200b light, RING LIGHT, ring&#32;light, " * 6,
    "tags": "#frame#light#glossy" * 12,
    "phrases": "Looking for a ring light you can trust? Then our ring light is the ring light for you. " * 4,
    "products": "; ".join(f"ring light {i}x40 SKU{i}0123 {i}9.99 EUR" for i in range(12)),
    "listed": "tags=oak, a4, ring light, matte, oak, frame, a4, backdrop, tripod, matte, canvas, bokeh, walnut, glossy, oak, frame, softbox",
    "half prose": PROSE + "\n".join(f"https://shop{i}.example/item/{i}" for i in range(24)),
}
FINE = {
    "prose": PROSE * 2,
    "ends in tags": PROSE + "#a4 #softbox",
    "one link": PROSE + "https://shop.example/item/4",
    "note": "Chin too warm. Noise fine. Collar crisp. File fine. Hairline cut off. Mouth tight.",
    "scores": "3/5 - collar soft, skin tone crisp, crop tight, hairline better, glasses fine",
    "card": "Aperture: f11\nShelf: 12-B\nCamera: Venn M2\nFormat: jpeg 92\nReviewed by: desk",
    "json": '{"status": "assessed", "scores": {"framing": 5, "solo": 4, "lighting": 2}, "evidence": {"framing": "The wall is plain."}}',
    "measured": "sharpness 727.04, exposure 88.6, highlights 0.0262, shadows 0.01",
}


def _prose(rng, n):
    syllables = ["ba", "lo", "mi", "ter", "su", "dan", "fe", "gor", "hu", "ne", "pi", "ra", "sto", "vel"]
    one = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([2, 2, 3])))
    shapes = ["The {} near the {} is {}, and we may {} it.", "It was {} of the {} that {} the {}.", "If you {} the {}, then a {} will {} with it.", "Not all of our {} had {} on them, but the {} did."]
    return " ".join(rng.choice(shapes).format(one(), one(), one(), one()) for _ in range(n))


def test_flags(spark):
    rng = random.Random(4)
    rows = [(n, _prose(rng, rng.randrange(2, 9)), rng.choice(["en", "EN ", None, "xx"]), "", "") for n in range(600)]
    spam = [(1000 + i, t, "en", "", "") for i, t in enumerate(SPAM.values())]
    fine = [(2000 + i, t, None, "", "") for i, t in enumerate(FINE.values())] + [(3000, None, "en", "", ""), (3001, "", "en", "", ""), (3002, " \n", None, "", "")]
    df = spark.createDataFrame(rows + spam + fine + spam[:1], DOC)
    out = stuffing.score_texts(df).collect()
    assert len(out) == len(rows) + len(spam) + len(fine) + 1
    flagged = {r.doc_id for r in out if r.flagged}
    assert {i for i in flagged if i >= 1000} == {s[0] for s in spam} and len([i for i in flagged if i < 1000]) <= 3
    assert stuffing.score_texts(df.limit(0)).count() == 0
    assert not any(r.flagged for r in stuffing.score_texts(df.where("doc_id >= 3000")).collect())


def test_the_distance_decides():
    """The same page is far out where texts are plain, and not where links are common."""
    rng = random.Random(2)
    link = lambda: f"https://{rng.randrange(10**6)}.example/{rng.randrange(10**6)}"
    plain, _, _ = stuffing.measure([_prose(rng, 5) for _ in range(400)])
    mixed, _, _ = stuffing.measure([_prose(rng, 5) + " ".join(link() for _ in range(rng.randrange(12))) for _ in range(400)])
    page, _, _ = stuffing.measure([_prose(rng, 5) + " ".join(link() for _ in range(12))])
    fit = lambda x: stuffing.Fit(x.mean(0), np.cov(x.T))
    assert fit(plain).directed(page)[0] > stuffing.CUTOFF > fit(mixed).directed(page)[0]


def test_measures_do_not_depend_on_the_lot():
    rng = random.Random(3)
    texts = [*SPAM.values(), *FINE.values(), None, "", *[_prose(rng, 4) for _ in range(20)]]
    whole = stuffing.measure(texts)
    for i, t in enumerate(texts):
        x, length, lang = stuffing.measure([t])
        assert x[0].tolist() == pytest.approx(whole[0][i].tolist()) and length[0] == whole[1][i] and lang[0] == whole[2][i]


def test_brute_force_shares():
    """Link density and the share of the two commonest words, counted plainly."""
    text = "lamp chair lamp https://a.example/b lamp chair door"
    x, length, _ = stuffing.measure([text])
    assert length[0] == 4 * 3 + 5 * 2 + 4 + 19
    shares = (x[0] * (length[0] + stuffing.PRIOR) - stuffing.NEUTRAL * stuffing.PRIOR) / length[0]
    assert shares[0] == pytest.approx(19 / length[0]) and shares[6] == pytest.approx((2 * 4 + 5) / length[0])


def test_long_texts_are_measured_whole():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    half = "".join(f"The {word()} is by the {word()}, and we keep it with the {word()}. " for _ in range(4700))
    x, length, _ = stuffing.measure([half, half * 2, SPAM["links"] * 2000, "<a " * 200_000, "[" * 300_000])
    repeated = stuffing.FEATURES.index("phrase_repetition")
    assert length[0] > 200_000 and x[0, repeated] < 0.6 and x[1, repeated] > 0.99 and x[2, 0] > 0.99
