"""Defects of pairs: held-out accuracy on a made corpus, and edges."""

import random

import pytest

from blockloom.llm import pair_synthesis as synthesis
from blockloom.llm import pairs

THINGS = [("ボタン", "button"), ("レバー", "lever"), ("カード", "card"), ("ハンドル", "handle"), ("鍵", "key"), ("円盤", "disc"), ("収納箱", "storage case"), ("時計盤", "clock face")]
LINES = [("{}を押すと音が鳴ります。", "Pressing the {} plays a sound."), ("{}の電源を切ってください。", "Always switch off the {} after use."), ("濡れた手で{}に触らないでください。", "Do not touch the {} with wet hands."), ("{}は青く光ります。", "The {} lights up in blue."), ("{}を9回振ってください。", "Swing the {} 9 times to each side.")]
SCHEMA = "row_id long, text string, translation string"


def made(rng):
    chosen = [(rng.choice(LINES), rng.choice(THINGS)) for _ in range(rng.randint(1, 4))]
    return "".join(a.format(j) for (a, _), (j, _) in chosen), " ".join(b.format(e) for (_, b), (_, e) in chosen)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(2600):
        src, ans = made(rng)
        kind = i % 26
        if kind == 1:
            ans, truth[i] = synthesis.refusal(rng), "refusal"
        elif kind == 2:
            ans, truth[i] = synthesis.copied(rng, src), "copied"
        elif kind == 3:
            ans, truth[i] = " ".join(rng.sample(synthesis.FOREIGN, 2)), "other_language"
        elif kind == 4 and ". " in ans:
            ans, truth[i] = ans.rsplit(". ", 1)[0] + ".", "truncated"
        elif kind == 5:
            ans, truth[i] = rng.choice([None, "", " \n", "​"]), "empty"
        rows.append((i, src, ans))
    return rows, truth


def test_held_out(spark, corpus):
    rows, truth = corpus
    got = {r.row_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = sum(got.get(i) == d for i, d in truth.items())
    assert right >= 0.93 * len(truth)
    assert sum(i not in truth for i in got) <= 0.01 * len(rows)
    assert all(got[i] == "empty" for i, d in truth.items() if d == "empty")


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no Japanese", None), (4, "ボタン", None), (5, "ボタン", "　​"), (5, "ボタン", ""), (6, "あ" * 100_000, "a" * 100_000)]
    got = sorted((r.row_id, r.defect) for r in pairs.defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(4, "empty"), (5, "empty"), (5, "empty")]
    assert pairs.defective_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_odd_text(spark, corpus):
    src = "……『ボタン』……"
    own = [(9000, "ﾎﾞﾀﾝ", None), (9001, src, ""), (9002, "ﾎﾞﾀﾝを押すと音が鳴ります。", "ﾎﾞﾀﾝを押すと音が鳴ります。"), (9003, src, "button")]
    got = {r.row_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(corpus[0] + own, SCHEMA)).where("row_id >= 9000").collect()}
    assert got == {9000: "empty", 9001: "empty", 9002: "copied"}


SOURCE = "小さな部品は子供の手の届かない所に保管してください。"
SOUND = ["Store out of reach of young children.", "This product isn't waterproof.", "This feature cannot be used.", "The weather is lovely today, isn't it?", "He travelled to Tokyo yesterday.", "Nobody was able to open the gate.", "We aren't allowed to sell it abroad."]
FOREIGN = {
    "pl": "Małe części należy przechowywać w miejscu niedostępnym dla dzieci.", "tr": "Küçük parçaları çocukların ulaşamayacağı bir yerde saklayın.", "vi": "Để các bộ phận nhỏ xa tầm tay trẻ em.", "el": "Φυλάξτε τα μικρά εξαρτήματα μακριά από παιδιά.",
    "romaji": "Chiisana buhin wa kodomo no te no todokanai tokoro ni oite kudasai.", "de": "Kleine Teile außerhalb der Reichweite von Kindern aufbewahren.", "ar": "احفظ القطع الصغيرة بعيدا عن الأطفال.", "th": "เก็บชิ้นส่วนเล็กให้พ้นมือเด็ก", "fr": "Conservez les petites pièces hors de portée des enfants.",
}


@pytest.fixture(scope="module")
def model(corpus):
    rows, truth = corpus
    return pairs.train([(a, b) for _, a, b in rows if b and b.strip()])


def defect(spark, corpus, answers, text=SOURCE):
    own = [(9000 + i, text, a) for i, a in enumerate(answers)]
    got = {r.row_id: r.defect for r in pairs.defective_pairs(spark.createDataFrame(corpus[0] + own, SCHEMA)).where("row_id >= 9000").collect()}
    return [got.get(9000 + i) for i in range(len(answers))]


def test_other_wordings(spark, corpus):
    """Sound English that the corpus has nothing of neither refuses nor is it foreign; other languages are no refusals."""
    assert [(t, d) for t, d in zip(SOUND, defect(spark, corpus, SOUND)) if d in ("refusal", "other_language")] == []
    assert defect(spark, corpus, list(FOREIGN.values())) == ["other_language"] * len(FOREIGN)
    assert defect(spark, corpus, [None, "I cannot translate this passage."], text="繧ｷ繧ｧ繝ｫ�ｼ・繝�・") == ["empty", "refusal"]


def test_languages(model):
    import pyarrow as pa

    score = model.languages.english(pairs.fold(pa.array([*SOUND, *(v for k, v in FOREIGN.items() if k not in ("el", "ar", "th"))])))
    assert (score[: len(SOUND)] > -pairs.FOREIGN).all() and (score[len(SOUND) :] < -pairs.FOREIGN).all()
