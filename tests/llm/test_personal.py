"""Personal information: held-out synthetic sentences and edges."""

import pytest

from blockloom.llm import personal
from blockloom.llm import personal_synthesis as synthesis

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def field():
    return personal.trained()


@pytest.mark.parametrize("held", [False, True])
def test_made_sentences(field, held):
    """Sentences of another seed, and sentences and common names that training never saw."""
    right = wrong = total = 0
    for text, gold in synthesis.sentences(600, 4321, held):
        got = set(field.best(personal.fold(text)))
        total += len(gold)
        right += len(got & set(gold))
        wrong += len(got - set(gold))
    assert right >= (0.95 if held else 0.97) * total and wrong <= 0.02 * total


def test_held_out_shares_nothing():
    seen = {left + right for _, left, right in synthesis._WITH + synthesis._MORE + synthesis._NUMBERS} | {a + b for a, b in synthesis._PLAIN} | {a + "{}" + b for a, b in synthesis._JP_PLAIN}
    assert not seen & {left + right for _, left, right in synthesis._HELD}
    assert not set(synthesis._HELD_NONE) & set(synthesis._WITHOUT + synthesis._NONE)


PROBES = {
    "Please forward this to Olivia Harper.": {("Olivia Harper", "name")},
    "Olivia Harper will collect the parcel": {("Olivia Harper", "name")},
    "Best wishes\nRobert Baker": {("Robert Baker", "name")},
    "Reach Robert Baker on 020 7946 0018.": {("Robert Baker", "name"), ("020 7946 0018", "phone")},
    "山本健一が発送しました。": {("山本健一", "name")},
    "発送は佐藤花子が行います。": {("佐藤花子", "name")},
    "大阪市北区梅田1丁目2番3号": {("大阪市北区梅田1丁目2番3号", "address")},
    "12 rue de la Paix, 75002 Paris": {("12 rue de la Paix, 75002 Paris", "address")},
    "Calle Mayor 5, 28013 Madrid": {("Calle Mayor 5, 28013 Madrid", "address")},
    "090-1234-5678/03-1234-5678": {("090-1234-5678", "phone"), ("03-1234-5678", "phone")},
    "Room 12 090-1234-5678": {("090-1234-5678", "phone")},
    "IBAN DE89 3704 0044 0532 0130 00": set(),
    "Captain Bolt will collect the parcel": set(),
    "Mega Sapphiva Lantern was sold": set(),
}


@pytest.mark.parametrize("text", PROBES)
def test_without_cues(field, text):
    assert {(text[a:b], kind) for a, b, kind in personal.mentions(field, text)} == PROBES[text]


def test_pruning_is_exact(field):
    """What is left out could not have been a mention."""
    for text, _ in synthesis.sentences(150, 77):
        text = personal.fold(text)
        full = {(a, b, k, round(sum(field.weights.get(f, 0.0) for f in personal._features(text, a, b, k)), 6)) for a, b, k in personal.candidates(text)}
        kept = {(a, b, k, round(s, 6)) for a, b, k, s in field.scored(text)}
        assert {x for x in full if x[3] > personal.LEAST} == {x for x in kept if x[3] > personal.LEAST}


def test_marginals_sum_over_segmentations():
    items = sorted([(0, 2, "a"), (0, 4, "a"), (2, 4, "b"), (5, 6, "a")], key=lambda s: (s[1], s[0]))
    scores = [0.3, -0.2, 1.0, 0.5]
    import itertools
    import math

    weight, each = 0.0, [0.0] * 4
    for chosen in itertools.product([0, 1], repeat=4):
        spans = [items[i] for i in range(4) if chosen[i]]
        if any(a[0] < b[1] and b[0] < a[1] for a, b in itertools.combinations(spans, 2)):
            continue
        w = math.exp(sum(s for s, c in zip(scores, chosen) if c))
        weight += w
        for i in range(4):
            each[i] += w * chosen[i]
    assert personal._marginals(items, scores) == pytest.approx([e / weight for e in each])


def test_mentions_and_placeholders(spark):
    text = "My name is Anna Brandt and I collect toys. Call me on ０９０－１２３４－５６７８ after six. 返信はanna@example.orgにお願いします。 Order #1234-11-12345 arrived."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "JANコードは4912345678901です。お客様の声です。 Thanks to @gunborg_fan for the hint."), (5, "あ" * 60_000 + "差出人：田中春人\n")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in personal.personal_mentions(df).collect()}
    assert got == {(1, "name", "Anna Brandt"), (1, "phone", "０９０－１２３４－５６７８"), (1, "email", "anna@example.org"), (5, "name", "田中春人")}
    clean = {r.doc_id: r.text for r in personal.without_personal(df).collect()}
    assert clean[1] == "My name is [NAME] and I collect toys. Call me on [PHONE] after six. 返信は[EMAIL]にお願いします。 Order #1234-11-12345 arrived."
    assert clean[2] is None and clean[3] == "" and clean[4] == rows[4][1]
    assert personal.personal_mentions(df.limit(0)).count() == 0
