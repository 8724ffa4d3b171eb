"""Synthetic sentences with and without personal information, with the segments of each."""

from __future__ import annotations

import random

from blockloom.llm import person_names as common

FIRST = ("Anna", "Bert", "Clara", "David", "Elena", "Farid", "Greta", "Hugo", "Ingrid", "Jonas", "Karla", "Liam", "Maja", "Nils", "Olga", "Piet", "Quinn", "Rosa", "Stefan", "Tilda", "Uwe", "Vera", "Wim", "Xenia", "Yusuf", "Zora", "Chloë", "José", "Ivo", "Priya")
LAST = ("Miller", "Brandt", "Castellan", "Dorfmann", "Eastwick", "Fairlow", "Grünwald", "Hollister", "Ibsen", "Jorgensen", "Kestrel", "Lindholm", "Marrow", "Northgate", "O'Brady", "Pemberly", "Quillfield", "Rosendahl", "Stormvik", "Thornton", "Underhill", "Vanderbeek", "Westerby", "Yarborough", "Zellweg", "Smith-Penn", "Ashby-Cole", "O'Connor")
JP_ROMAN_LAST = ("Tanakawa", "Mizushima", "Aoyamada", "Fujimori", "Kuronuma", "Hoshizora", "Shirogane")
JP_ROMAN_FIRST = ("Haruto", "Sakura", "Yui", "Takumi", "Mio", "Ren", "Aoi", "Shizuka")
KANJI_LAST = ("田中", "水島", "青山田", "藤森", "黒沼", "星空", "白銀", "森ヶ丘", "海ノ口", "月影", "蛍", "霧", "雪村", "桜庭", "風間野")
KANJI_FIRST = ("春人", "桜", "結", "匠", "美緒", "蓮", "葵", "静香", "悠太郎", "凛", "千代子", "陽", "翔太")
KANA_LAST = ("たなか", "みずしま", "あおやま", "ふじもり", "くろぬま", "ほしぞら", "しろがね")
KANA_FIRST = ("はると", "さくら", "ゆい", "たくみ", "みお", "れん", "あおい", "しずか")
THINGS = ("medal", "belt", "front panel", "storage case", "silver ring", "lever", "card", "clock face", "key holder")
HEROES = ("Sapphiva", "Gunborg", "Nebulax", "Tollmist", "Vinezar", "Grimfox", "Zephyroid", "Marinarga", "Captain Bolt", "Ironmask")
JP_THINGS = ("メダル", "ベルト本体", "前面パネル", "収納箱", "レバー", "カード", "時計盤")
STREETS = ("Elm", "Maple Hill", "Station", "King", "Old Bridge", "Garden", "Ninth", "River View", "Chapel")
STREET_KINDS = ("Street", "St.", "Road", "Lane", "Ave", "Avenue", "Walk", "Rd.", "Drive", "Court")
TOWNS = ("Ashford", "Millbrook", "Port Ellis", "Stoneham", "Westbury", "Lakeside", "Green Bay", "Norwick")
STOPWORDS = frozenset("the a an and or of to in at on for from with by is are was were it its this that these my your his her our their i you he she we they as be not no but if so do does did has have had which who whom what when where why how me him them us there here than then out up down off over under again very can will just all any each few more most other some such only own same too again please thanks thank".split())


def _name(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.2:
        a, b = rng.choice(JP_ROMAN_FIRST), rng.choice(JP_ROMAN_LAST)
        return rng.choice((f"{a} {b}", f"{b} {a}", f"{b.upper()} {a}", f"{a} {b.upper()}"))
    a, b = rng.choice(FIRST), rng.choice(LAST)
    form = rng.random()
    if form < 0.42:
        name = f"{a} {b}"
    elif form < 0.56:
        name = f"{a[0]}. {b}"
    elif form < 0.72:
        name = f"{b}, {a}"
    elif form < 0.84:
        name = f"{a} {rng.choice('BDEKLMNRST')}. {b}"
    else:
        name = b if form < 0.9 else f"{a} {b}"
    case = rng.random()
    return name.lower() if case < 0.12 else name.upper() if case < 0.24 else name


_KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわがぎぐげござじずぜぞだでどばびぶべぼ"
_KANJI = "山川田島森林原野谷沢村木藤石月星雪花風雲海空光春夏秋冬東西南北上下中大小高松竹梅桜白黒青赤金銀清水池橋井宮寺城堀"


def _some(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def _jp_name(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.25:
        return f"{rng.choice((rng.choice(KANA_LAST), _some(rng, _KANA, 2, 6)))} {rng.choice((rng.choice(KANA_FIRST), _some(rng, _KANA, 2, 4)))}"
    if kind < 0.38:
        return rng.choice((rng.choice(KANJI_LAST), _some(rng, _KANJI, 1, 3)))
    if kind < 0.6:
        return _some(rng, _KANJI, 1, 3) + rng.choice(("", " ")) + rng.choice((rng.choice(KANJI_FIRST), _some(rng, _KANJI, 1, 3)))
    return rng.choice(KANJI_LAST) + rng.choice(("", " ")) + rng.choice(KANJI_FIRST)


def _d(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _wide(rng: random.Random, text: str) -> str:
    """Sometimes in full width."""
    if rng.random() > 0.1:
        return text
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" if c == " " else c for c in text)


def _phone(rng: random.Random) -> str:
    form = rng.choice(
        (
            lambda: f"0{rng.choice('789')}0-{_d(rng, 4)}-{_d(rng, 4)}", lambda: f"0{rng.choice('789')}0{_d(rng, 8)}", lambda: f"+81-{rng.choice('789')}0-{_d(rng, 4)}-{_d(rng, 4)}", lambda: f"+81 {rng.choice('36')} {_d(rng, 4)} {_d(rng, 4)}",
            lambda: f"0{rng.choice('3456')}-{_d(rng, 4)}-{_d(rng, 4)}", lambda: f"(0{rng.choice('36')}) {_d(rng, 4)} {_d(rng, 4)}", lambda: f"+1 ({_d(rng, 3)}) 555-{_d(rng, 4)}", lambda: f"555-{_d(rng, 4)}", lambda: f"({_d(rng, 3)}) 555-{_d(rng, 4)}",
            lambda: f"+49 30 {_d(rng, 5)} {_d(rng, 3)}", lambda: f"0{rng.choice('3678')}.{_d(rng, 4)}.{_d(rng, 4)}", lambda: f"0{rng.choice('789')}0.{_d(rng, 4)}.{_d(rng, 4)}", lambda: f"+44 20 {_d(rng, 4)} {_d(rng, 4)}", lambda: f"0{_d(rng, 3)}-{_d(rng, 2)}-{_d(rng, 4)}",
            lambda: f"{rng.choice('23456789')}{_d(rng, 2)}-{rng.choice('555 632 781'.split())}-{_d(rng, 4)}", lambda: f"{rng.choice('23456789')}{_d(rng, 2)}.555.{_d(rng, 4)}", lambda: f"0{_d(rng, 2)} {_d(rng, 4)} {_d(rng, 4)}",
            lambda: f"0{rng.choice('36')} {_d(rng, 4)} {_d(rng, 4)}", lambda: f"+81-{rng.choice('36')}-{_d(rng, 4)}-{_d(rng, 4)}",
        )
    )()
    if rng.random() < 0.12:
        form += rng.choice((" ext. ", " ext ", " x", " 内線")) + _d(rng, rng.randint(2, 4))
    return _wide(rng, form)


def _id(rng: random.Random) -> str:
    form = rng.choice(
        (
            lambda: f"{_d(rng, 3)}-{_d(rng, 2)}-{_d(rng, 4)}", lambda: _d(rng, 12), lambda: f"{_d(rng, 4)} {_d(rng, 4)} {_d(rng, 4)}", lambda: f"{_d(rng, 4)}-{_d(rng, 4)}-{_d(rng, 4)}", lambda: f"{rng.choice(('QZ', 'TX', 'AB', 'MK'))} {_d(rng, 7)}",
            lambda: f"{rng.choice(('QZ', 'TX', 'AB', 'MK'))}{_d(rng, 7)}", lambda: f"{rng.choice('LKDS')}{_d(rng, 3)}-{_d(rng, 4)}-{_d(rng, 4)}", lambda: f"{_d(rng, 6)}-{_d(rng, 6)}{rng.choice('KABX')}", lambda: _d(rng, 12),
        )
    )()
    return _wide(rng, form)


def _address(rng: random.Random) -> str:
    town, kind = rng.choice(TOWNS), rng.random()
    code = rng.choice((f", QX {_d(rng, 5)}", f" ZZ{_d(rng, 1)} {_d(rng, 1)}QQ", f", NY {_d(rng, 5)}", f" AB{_d(rng, 1)} {_d(rng, 1)}CD"))
    street = f"{rng.randint(1, 900)} {rng.choice(STREETS)} {rng.choice(STREET_KINDS)}"
    gap = "\n" if rng.random() < 0.25 else ", "
    if kind < 0.35:
        return f"{street}{gap}{town}{code}"
    if kind < 0.6:
        return f"Flat {rng.randint(1, 40)}B, {street}{gap}{town}{code}"
    if kind < 0.72:
        return f"P.O. Box {rng.randint(100, 9999)}, {town}"
    if kind < 0.85:
        return f"{rng.choice(('Linden', 'Rosen', 'Bahnhof', 'Garten'))}{rng.choice(('gasse', 'straße', 'weg'))} {rng.randint(1, 140)}, {_d(rng, 5)} {rng.choice(('Musterstadt', 'Neuburg', 'Altdorf'))}"
    return f"{rng.randint(1, 9)}-{rng.randint(1, 30)}-{rng.randint(1, 30)} {rng.choice(('Midorigaoka', 'Honcho', 'Sakuradai'))}, {rng.choice(('Tsukimi', 'Hoshino'))}, {rng.choice(('Yume-ken', 'Kuu-ken', 'Hoshi-fu'))} {_d(rng, 3)}-{_d(rng, 4)}"


def _jp_address(rng: random.Random) -> str:
    place = rng.choice(("架空県", "星降府", "夢見県", "青葉県", "東原都")) + rng.choice(("月島市", "緑浜市", "灯里区", "風見町", "雲見市")) + rng.choice(("港南", "本町", "桜坂", "西ノ森", "青葉台"))
    numbers = rng.choice((f"{rng.randint(1, 9)}-{rng.randint(1, 30)}-{rng.randint(1, 30)}", f"{rng.randint(1, 9)}丁目{rng.randint(1, 30)}番{rng.randint(1, 30)}号", _wide(rng, f"{rng.randint(1, 9)}-{rng.randint(1, 30)}")))
    tail = rng.choice(("", "", f" コーポ星{rng.randint(100, 900)}", f" 夕凪荘{rng.randint(1, 40)}号室", f" 緑ハイツ{rng.randint(1, 900)}"))
    code = rng.choice(("", f"〒{_d(rng, 3)}-{_d(rng, 4)} ", f"〒{_d(rng, 3)}-{_d(rng, 4)}\n"))
    return code + place + numbers + tail


def _email(rng: random.Random) -> str:
    local = rng.choice((rng.choice(FIRST), rng.choice(LAST), rng.choice(FIRST) + "." + rng.choice(LAST), rng.choice(LAST) + "+toys", rng.choice(FIRST) + "-" + _d(rng, 2), rng.choice(FIRST) + "_" + rng.choice(LAST) + _d(rng, 2))).lower().replace("'", "").replace("ü", "u").replace("ë", "e").replace("é", "e")
    host = rng.choice(("example.org", "example.net", "mail.example.com", "toybox.example.org", "post-office.test", "harbourmail.example"))
    kind = rng.random()
    if kind < 0.6:
        out = f"{local}@{host}"
    elif kind < 0.7:
        out = f"{local}＠{host}"
    elif kind < 0.85:
        out = f"{local} (at) {host.replace('.', ' (dot) ')}"
    else:
        out = f"{local} [at] {host.replace('.', '[dot]')}"
    return out.upper() if rng.random() < 0.1 else out


_WITH = (
    ("name", "My name is {}", " and I collect {h} toys."), ("name", "I bought it from {}", " at a fair."), ("name", "Ask for {}", " at the repair desk."), ("name", "Ms. {}", " translated page 6."), ("name", "Mr. {}", " answered my question."),
    ("name", "The seller, {}", ", packed the {t} well."), ("name", "Kind regards,\n{}", "\n"), ("name", "Best regards,\n{}", ""), ("name", "Kind regards,\n{}", "\n\n"), ("name", "Sincerely,\n{}", "\n"), ("name", "Dear {}", ",\n"), ("name", "Dr. {}", " wrote the manual."), ("name", "I am {}", " and I collect toys."),
    ("name", "Mrs. {}", " sent the {t}."), ("name", "Please contact {}", " about the {t}."), ("name", "It was sold by {}", "."), ("name", "Mr. {}", " packed the box."), ("name", "Hello {}", ","), ("name", "The letter was signed by {}", "."),
    ("name", "Signed: {}", "\n"), ("name", "Signed: {}", ""), ("name", "Signed: {}", " 😀"), ("name", "Signed: {}", " ᚠᛇ"), ("name", "Signed: {}", " Z̸̢a͜l"), ("name", "Kind regards,\n{}", " aaaaaaaaaaaaaaaaaaaa"), ("name", "Seller: {}", "\n"), ("address", "Please ship the {t} to {}", "."), ("address", "Please ship the {t} to {}", ""),
    ("phone", "Call me on {}", " after six."), ("phone", "My mobile is {}", ", texts are fine."), ("phone", "The courier noted {}", " as my number."), ("phone", "If the parcel is late ring {}", "."), ("phone", "Phone {}", "."), ("phone", "tel:{}", ""), ("phone", "TEL {}", "\n"), ("phone", "電話は{}", "です。"), ("phone", "携帯（{}", "）へご連絡ください。"), ("phone", "{}", "に夕方おかけください。"), ("phone", "Fax: {}", "\n"), ("phone", "Phone: {}", ""),
    ("id_number", "For the customs form my passport number is {}", "."), ("id_number", "Driver's licence {}", " was shown at pick-up."), ("id_number", "They asked for my social security number, {}", ", which felt wrong."), ("id_number", "My resident number is {}", "."), ("id_number", "ID card no. {}", " was copied."), ("id_number", "National ID: {}", ""), ("id_number", "National ID: {}", "\n"),
    ("id_number", "旅券番号{}", "を控えました。"), ("id_number", "個人番号は{}", "と記入しました。"), ("id_number", "免許証の番号は{}", "です。"), ("id_number", "本人確認：番号 {}", "\n"), ("id_number", "本人確認：番号 {}", ""), ("id_number", "Passport {}", " expires soon."), ("id_number", "保険証番号：{}", "。"),
    ("address", "Return address: {}", "\n"), ("address", "Return address: {}", ""), ("address", "I moved to {}", " last month."), ("address", "The parcel went to {}", " instead of my office."), ("address", "Deliver to:\n{}", "\nThank you."), ("address", "Please ship to {}", "."), ("address", "I live at {}", "."),
    ("jp_address", "返送先\n{}", "\nよろしくお願いします。"), ("jp_address", "住所：{}", "\n"), ("jp_address", "送り先は{}", "です。"), ("jp_address", "{}", "に引っ越しました。"), ("jp_address", "住所：{}", ""),
    ("jp_name", "{}", "さんから{jt}を譲っていただきました。"), ("jp_name", "担当の{}", "氏に確認しました。"), ("jp_name", "{}", "様宛てに送ってください。"), ("jp_name", "差出人：{}", "\n"), ("jp_name", "差出人：{}", ""), ("jp_name", "{}", "と申します。"), ("jp_name", "担当の{}", "さんに聞きました。"), ("jp_name", "差出人：{}", "\n\n"),
    ("email", "You can reach me at {}", " any evening."), ("email", "My address for replies is {}", ", thanks."), ("email", "Send the {t} photo to {}", "."), ("email", "メール：{}", "\n"), ("email", "返信は{}", "にお願いします。"), ("email", "contact -> {}", "\n"), ("email", "(write to mailto:{}", ")"), ("email", "{}", "まで写真を送ってください。"), ("email", "contact -> {}", ""),
)
_WITHOUT = (
    "Order #{a4}-11-{a5} arrived on 2024-0{d}-15 with a dented box.", "The JAN code on the box is 49{a11}.", "JANコードは49{a11}です。", "注文番号{a4}-11-{a4}の箱がへこんでいました。", "Model MV-{a4}-B has a different {t} than MV-{a4}-A.", "型番MV-{a4}-Bの{jt}は旧版と違います。", "Serial S/N {a4}/{a3}A6 is printed under the {t}.",
    "Thanks to @{hl}_fan for the hint about the release sound.", "It costs 1{d},800 yen plus shipping.", "価格は1{d},800円（税込）でした。", "Version 2.{d}.1 of the viewer fixes the overlay of the {t}.", "Scale is 1:{d}2, so the {t} fits a small hand.", "Block {d}-1{d} repeats the heading, please remove it.", "I opened the {h} Capsule yesterday and the {t} was loose.",
    "In episode {d} {h} loses the {t} and {h} gives it back.", "When {h} raises the tiny seal, the transformation sound plays.", "{h}’s torch weighs about {a3} grams.", "小さな部品がありますので、{d}歳未満のお子様には絶対に与えないでください。", "お客様の声を聞かせてください。", "皆さんの{jt}を見せてください。", "皆様のご参加をお待ちしています。", "たくさんの{jt}があります。", "第{d}話で{jt}が登場します。",
    "The photo shows a prototype; the actual {t} may differ.", "The tip of the {t} is sharp, so never point it at people.", "Match the + and - marks when you put in the batteries.", "{h} comes from the old castle and seals away the mask.", "The {h} card is only for {h}.", "I compared the blue release with the older one and the {t} is heavier.", "The booklet says the sound needs {d} batteries, but mine works with fewer.",
    "Chapter {d} introduces {h}, who carries the polished crown.", "Remove the {d} screws before you put in the batteries.", "The limited {a4} copies of the {t} are numbered.", "Can you re-run the recognition for the {t} page?", "My scan of page {d} is blurry, so the viewer shows odd boxes.", "最大音量は約{d}0デシベルです。", "限定{a4}個の{jt}には番号が入ります。", "使用温度範囲は5°Cから{d}5°Cまでです。", "箱と説明書は大切に保管してください。全{d}ページです。",
    "{jt}......{d}\n{jt}......1{d}", "- {t} × {d}\n- {t} × 1{d}", "Names of the {t} parts", "{h} vs. {h}", "Thanks to {h} for the sound.", "This is {h} from the second wave.", "I am happy with the {t}.", "It came from the shop near the station.", "昨日{jt}を買いました。", "担当の方に聞きました。", "再販は2025年{d}月だそうです。", "Release date 2024-0{d}-15, lot {a4}-{a2}-{a5}.", "Article no. {a4}-{a4}.", "品番{a5}-{a2}です。",
    "I got it from the collection box.", "Contact the shop for the {t}.", "The seller packed the {t} well.", "The buyer, however, was late.", "Thanks, it works.", "From {h} I learned the pose.", "What a toy", "HOW TO USE {hu} CASE", "DL {hu} BLASTER", "Jubilee {h} Cap\n", "Quintalos の声を聞くには{jt}を重ねてください。", "水に濡らさないでください。{d}年間保管できます。", "対戦モードの遊び方です。", "色の{jt}です。",
)


def _fill(rng: random.Random, text: str) -> str:
    out = text.replace("{d}", str(rng.randint(1, 9)))
    for n in (11, 5, 4, 3, 2):
        while f"{{a{n}}}" in out:
            out = out.replace(f"{{a{n}}}", _d(rng, n), 1)
    for key, values in (("{t}", THINGS), ("{jt}", JP_THINGS), ("{h}", HEROES)):
        while key in out:
            out = out.replace(key, rng.choice(values), 1)
    hero = rng.choice(HEROES)
    return out.replace("{hl}", hero.lower().replace(" ", "_")).replace("{hu}", hero.upper())


_MORE = (
    ("jp_name", "{}", "さんが{jt}を直しました。"), ("jp_name", "{}", "さん、ありがとうございます。"), ("jp_name", "{}", "さんへ\n"), ("jp_name", "{}", "様\n"), ("jp_name", "{}", "氏は{jt}の収集家です。"), ("name", "Mr. {}", " called."), ("name", "Mrs. {}", ", thank you."), ("phone", "Number: {}", " "),
)
#: Sentences in which only the name itself tells that it is one; the same hold heroes, products and nouns as examples of none.
_PLAIN = (
    ("{}", " will bring the {t} on Sunday."), ("{}", " lent me the {t}."), ("{}", " repaired the {t} for free."), ("{}", " has the last {t}."), ("I met {}", " at the fair."), ("Please give this to {}", "."), ("It belongs to {}", "."),
    ("Write to {}", " about the {t}."), ("{}", " and I share the {t}."), ("We owe the photos to {}", "."), ("The {t} was a gift of {}", "."), ("Reach {}", " by mail."), ("Best,\n{}", "\n"), ("Cheers\n{}", ""), ("Thank you\n{}", "\n"),
    ("Hand it over to {}", " in person."), ("{}", ", who scanned the booklet, is away."), ("Delivered to {}", " on Monday."), ("{}", " wants the {t} back."), ("My neighbour {}", " opened the box."), ("{}", " paid for the {t}."), ("Is {}", " still selling the {t}?"),
)
_JP_PLAIN = (
    ("昨日", "に会いました。"), ("", "が届けてくれました。"), ("", "から{jt}をもらいました。"), ("宛先は", "です。"), ("修理は", "に頼みました。"), ("写真：", "\n"), ("", "と一緒に{jt}を直しました。"), ("", "より\n"), ("{jt}を", "に渡してください。"),
    ("", "は{jt}を持っています。"), ("取引相手は", "でした。"), ("", "の{jt}です。"), ("受取人 ", "\n"), ("撮影 ", "\n"),
)
_NUMBERS = (
    ("phone", "Ring {}", " or {p}."), ("phone", "Room {d}2 {}", "\n"), ("phone", "Tel. {}", "/{p}"), ("phone", "Reach me on {}", " at noon."), ("phone", "{}", " is my number."), ("phone", "連絡先 {}", "\n"), ("phone", "Text {}", " first."),
    ("address", "We meet at {}", " on Sunday."), ("address", "My flat: {}", "\n"), ("address", "Send the {t} to {}", ", please."), ("jp_address", "{}", "へ送りました。"), ("jp_address", "場所は{}", "です。"), ("id_number", "The clerk copied passport {}", "."), ("id_number", "ID {}", "\n"), ("email", "Mail {}", "."), ("email", "E-mail: {}", ""),
)
_NONE = (
    "IBAN DE{a2} {a4} {a4} {a4} {a4} {a2} is on the bill.", "Pay to GB{a2} ABCD {a4} {a4} {a4} {a2}.", "ISBN 978-{d}-{a4}-{a4}-{d}.", "See pages {a2}-{a2} and {a3}-{a3}.", "{a4}/{a2}/{a2} {a2}:{a2} log entry {a5}.", "Lot {a4} {a4} sold out.", "Tracking {a4}-{a4}-{a4} shows no movement.", "追跡番号は{a4}-{a4}-{a4}です。",
    "It works from 5 °C to 35 °C. {h} waits.", "May Day is a holiday.", "Rose Gold suits the {t}.", "The Jack Frost card shines.", "Mark One and Mark Two differ.", "A Grace Period applies.", "Hill Top Park has a shop.", "The King Arthur set is rare.", "New York and San Marino sell it.", "Press Start Button twice.", "Keep Out Of Reach.", "The Green Long Cape fits.", "Christmas Eve sale.",
    "{jt}の{n}\n\n", "{n}\n", "■{n}\n", "{n}の{n}です。", "{n}：{n}\n", "1. {n}\n2. {n}\n", "{p}\n", "{h} {t}\n",
    "Übergrün Deluxe and Café Noir are colours.", "Drücken Sie die Taste. Entfernen Sie die Schrauben.", "Bewahren Sie Karton und Anleitung auf.", "Tirez le Levier Rouge. Conservez la Notice Jaune.", "第{d}市場で買いました。", "山下公園の前です。", "高橋の上で撮りました。", "中村座の公演です。", "石川県の名産です。", "青木ヶ原で撮影。", "Tokyo Station is near.",
)
_NOUNS = "音声 場面 電池 説明書 紋章 番号 自然 方法 電源 価格 旧版 開封 再販 限定 登場 必要 場合 歯車 収納 銀色 交換 写真 連動 途中 店舗 会社 家族 友人 先生 子供 部品 本体 前面 地図 祭典 展示 郵便 荷物 番組 主役 仲間 工場 倉庫 販売店 販売者 購入者 担当者 出品者 配送業者 製造元 取引先 収集家".split()
#: Characters of nouns, for nouns of all kinds.
_NOUN_KANJI = "電灯機関必殺技巨印章遊園底基殿図書館懐蒸気試験装置変身武器操作確認注意事項使用期限充満接続端子回路切替点灯消音量調整保証修理受付商品発売記念版特典封入"
_LINES, _DEVICES = ("Mega", "Petit", "Prime", "Jubilee", "QX", "DL"), ("Lantern", "Driver", "Blaster", "Shield", "Compass", "Whistle", "Hammer", "Belt")
#: Sentences that training never sees, to measure by.
_HELD = (
    ("common", "{}", " collects the box tomorrow."), ("common", "Could you forward it to {}", "?"), ("common", "I heard it from {}", " last week."), ("common", "Warmly,\n{}", "\n"), ("common", "{}", " photographed the {t}."), ("common", "Reserved for {}", "."), ("name", "Mr. {}", " runs the stall."), ("name", "My name is {}", ", from the club."),
    ("jp_common", "発送は{}", "が行います。"), ("jp_common", "{}", "が発送しました。"), ("jp_common", "{}", "宛に返送しました。"), ("jp_name", "{}", "さんの{jt}です。"), ("phone", "You get me under {}", "."), ("phone", "番号は{}", "へ。"), ("phone", "Mobile {}", ", evenings."), ("address", "Pick it up at {}", "."), ("address", "Our place: {}", "\n"),
    ("jp_address", "{}", "に住んでいます。"), ("jp_address", "発送先：{}", "\n"), ("email", "Drop a line to {}", "."), ("email", "宛先：{}", "\n"), ("id_number", "Licence no. {}", " was noted."), ("id_number", "My passport is {}", "."),
)
_HELD_NONE = ("{h} collects the box tomorrow.", "{p} photographed the {t}.", "Could you forward it to the {t} team?", "発送は{n}が行います。", "{n}が発送しました。", "Reserved for {p}.", "Order {a4}-{a5} of 2023-0{d}-11.", "Item {a4} {a3} is sold out.", "The {p} costs {a4} yen.", "{h} vs. {h}: round {d}.", "Warmly packed {t}.")


def _common_name(rng: random.Random, half: int) -> str:
    if rng.random() < 0.2:
        a, b = rng.choice(common.ROMAN_GIVEN[half::2]), rng.choice(common.ROMAN_FAMILY[half::2])
    else:
        a, b = rng.choice(common.GIVEN[half::2]), rng.choice(common.FAMILY[half::2])
    return rng.choice((f"{a} {b}",) * 5 + (f"{a} {rng.choice('ABCDEHJLMPRST')}. {b}", f"{b}, {a}", f"{a} {b}".upper(), f"{a} {b}-{rng.choice(common.FAMILY[half::2])}"))


def _jp_common(rng: random.Random, half: int) -> str:
    given = rng.choice(common.JP_GIVEN[half::2]) if rng.random() < 0.7 else _some(rng, _KANJI, 1, 1) + rng.choice(sorted(common.GIVEN_ENDS))
    return rng.choice(common.JP_FAMILY[half::2]) + rng.choice(("", "", "", " ")) + given


def _product(rng: random.Random) -> str:
    name = " ".join((rng.choice(_LINES), rng.choice(HEROES), rng.choice(_DEVICES)))
    return rng.choice((name, name, name.split(" ", 1)[1], name.upper()))


_MAKE = {"name": _name, "jp_name": _jp_name, "phone": _phone, "id_number": _id, "address": _address, "jp_address": _jp_address, "email": _email}
_KIND = {"common": "name", "jp_common": "name", "jp_name": "name", "jp_address": "address"}


def _mention(rng: random.Random, kind: str, half: int) -> str:
    if kind in ("common", "jp_common"):
        return (_common_name if kind == "common" else _jp_common)(rng, half)
    if kind in ("address", "jp_address") and rng.random() < 0.25:
        return _foreign_address(rng) if kind == "address" else _short_jp_address(rng)
    return _MAKE[kind](rng)


def _foreign_address(rng: random.Random) -> str:
    number, code = rng.randint(1, 240), _d(rng, 5)
    return rng.choice((
        f"{number} rue {rng.choice(('de la Gare', 'Victor Hugo', 'des Lilas', 'du Moulin'))}, {code} {rng.choice(('Paris', 'Lyon', 'Saint-Malo'))}", f"{number}, avenue {rng.choice(('Foch', 'de Verdun'))}, {code} {rng.choice(('Nice', 'Lille'))}",
        f"Calle {rng.choice(('Mayor', 'del Sol', 'de Toledo'))} {number}, {code} {rng.choice(('Madrid', 'Sevilla'))}", f"Via {rng.choice(('Roma', 'Garibaldi'))} {number}, {code} {rng.choice(('Torino', 'Milano'))}",
    ))


def _short_jp_address(rng: random.Random) -> str:
    """Without a prefecture."""
    place = rng.choice(("月島市", "緑浜市", "大坂市北区", "名越市東区", "灯里区", "港町市")) + rng.choice(("梅里", "本町", "桜坂", "西ノ森"))
    return place + rng.choice((f"{rng.randint(1, 9)}-{rng.randint(1, 30)}-{rng.randint(1, 30)}", f"{rng.randint(1, 9)}丁目{rng.randint(1, 30)}番{rng.randint(1, 30)}号"))


def _with(rng: random.Random, held: bool) -> tuple[str, str, str]:
    """Kind, what stands before the mention and what after it."""
    if held:
        kind, left, right = rng.choice(_HELD)
        return kind, left.replace("{}", "\x00"), right
    which = rng.random()
    if which < 0.6:
        kind, left, right = rng.choice(_WITH if which < 0.54 else _MORE)
    elif which < 0.76:
        kind, (left, right) = "common", rng.choice(_PLAIN)
    elif which < 0.88:
        before, right = rng.choice(_JP_PLAIN)
        kind, left = "jp_common", before + "{}"
    else:
        kind, left, right = rng.choice(_NUMBERS)
    return kind, left.replace("{}", "\x00"), right


def _without(rng: random.Random, held: bool) -> str:
    """A sentence without a mention."""
    if held:
        text = rng.choice(_HELD_NONE)
    else:
        which = rng.random()
        if which < 0.5:
            text = rng.choice(_WITHOUT)
        elif which < 0.65:
            text = rng.choice(_NONE)
        elif which < 0.85:
            left, right = rng.choice(_PLAIN)
            text = left.replace("{}", rng.choice(("{h}", "{p}", "the {t}"))) + right
        else:
            left, right = rng.choice(_JP_PLAIN)
            text = left + rng.choice(("{n}", "{jt}")) + right
    while "{n}" in text:
        text = text.replace("{n}", rng.choice(_NOUNS) if rng.random() < 0.5 else _some(rng, _NOUN_KANJI, 2, 5), 1)
    while "{p}" in text:
        text = text.replace("{p}", _product(rng), 1)
    return _fill(rng, text)


def sentences(n: int, seed: int, held: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to four sentences with the (start, end, kind) of each mention.

    Those held out share no sentence and no common name with the others.
    """
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 4)):
            if text and not text.endswith("\n"):
                text += rng.choice((" ", " ", "\n", "\n\n", "" if text.endswith("。") else " "))
            if rng.random() < 0.6:
                kind, left, right = _with(rng, held)
                before, after = _fill(rng, left).split("\x00")
                mention = _mention(rng, kind, int(held))
                gold.append((len(text) + len(before), len(text) + len(before) + len(mention), _KIND.get(kind, kind)))
                text += before + mention + after
                first, more, right = right.partition("{p}")
                text += _fill(rng, first)
                if more:  # a second number
                    other = _phone(rng)
                    gold.append((len(text), len(text) + len(other), "phone"))
                    text += other
                text += _fill(rng, right)
            else:
                text += _without(rng, held)
        out.append((text, gold))
    return out
