"""Common names of persons, as features for the field that finds personal information; no name must be among them."""

from __future__ import annotations

# Common given and family names.
GIVEN = tuple(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark "
    "Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Timothy Deborah Ronald Stephanie Edward Rebecca Jason Sharon Jeffrey Laura Ryan "
    "Cynthia Jacob Kathleen Gary Amy Nicholas Angela Eric Shirley Jonathan Anna Stephen Brenda Larry Pamela Justin Emma Scott Nicole Brandon Helen Benjamin Samantha Samuel Katherine Gregory Christine Alexander Debra "
    "Frank Rachel Patrick Carolyn Raymond Janet Jack Maria Dennis Olivia Jerry Heather Tyler Diane Aaron Julie Jose Joyce Adam Victoria Nathan Ruth Henry Virginia Zachary Lauren Douglas Kelly Peter Christina Kyle Joan "
    "Noah Evelyn Ethan Judith Jeremy Andrea Walter Hannah Oliver Megan Lucas Sophie Hans Klaus Jürgen Ingrid Pierre Marie Jean Claire Carlos Luis Ana Carmen Giulia Marco Anders Lars Sven Astrid Ivan Olga".split()
)
FAMILY = tuple(
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis "
    "Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes "
    "Stewart Morris Morales Murphy Cook Rogers Gutierrez Ortiz Morgan Cooper Peterson Bailey Reed Kelly Howard Ramos Kim Cox Ward Richardson Watson Brooks Chavez Wood Bennett Gray Mendoza Ruiz Hughes Price Alvarez "
    "Castillo Sanders Patel Myers Long Ross Foster Jimenez Harper Powell Jenkins Perry Russell Sullivan Bell Coleman Butler Henderson Barnes Fisher Vasquez Simmons Graham Murray Ford Hamilton Wallace West Cole Hayes "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Dupont Durand Moreau Laurent Rossi Russo Bianchi Jansen Larsen Ivanov".split()
)
ROMAN_FAMILY = tuple(
    "Sato Suzuki Takahashi Tanaka Ito Watanabe Yamamoto Nakamura Kobayashi Kato Yoshida Yamada Sasaki Yamaguchi Matsumoto Inoue Kimura Hayashi Saito Shimizu Yamazaki Mori Ikeda Hashimoto Abe Ishikawa Yamashita "
    "Nakajima Ishii Ogawa Maeda Okada Hasegawa Fujita Goto".split()
)
ROMAN_GIVEN = tuple("Kenji Hiroshi Takashi Akira Yuki Satoshi Kazuo Makoto Naoki Daisuke Haruto Hanako Keiko Yoko Yumi Naomi Akiko Emi Kaori Mariko Sachiko Ayumi".split())
JP_FAMILY = tuple(
    "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 斎藤 清水 山崎 池田 橋本 阿部 石川 山下 中島 石井 小川 前田 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本 斉藤 福田 太田 西村 "
    "藤井 金子 岡本 藤原 中野 三浦 原田 中川 松田 竹内 小野 田村 中山 和田 石田 森田 上田 内田 柴田 酒井 宮崎 横山 高木 安藤 宮本 大野 小島 工藤 谷口 今井 高田 増田 丸山 杉山 村田 大塚 新井 小山 平野 藤本 河野 上野 野口 武田 "
    "松井 千葉 岩崎 菅原 木下 久保 佐野 野村 松尾 市川 菊地 杉本 古川 大西 島田 水野 桜井 渡部 吉川 山内 西田 飯田 菊池 西川 小松 北村 安田 五十嵐 川口 平田 中田 久保田 服部 川崎 岩田 土屋 福島 本田 樋口 秋山 田口 永井 中西 "
    "吉村 川上 石原 大橋 松岡 馬場 浜田 森本 星野 矢野 浅野 大久保 吉岡 鎌田 野田".split()
)
JP_GIVEN = tuple(
    "太郎 一郎 次郎 三郎 健 健一 健太 健二 大輔 翔 翔太 翔平 拓也 拓海 直樹 直人 和也 達也 哲也 浩 浩二 浩一 誠 学 剛 勇 隆 隆史 修 徹 豊 進 実 茂 博 博之 正 正人 孝 亮 涼 蓮 陸 悠斗 大翔 湊 樹 花子 美咲 陽菜 結衣 さくら 葵 凛 愛 優 彩 舞 恵 "
    "恵子 幸子 和子 洋子 裕子 由美 由美子 真由美 直美 久美子 明美 美穂 美香 千尋 香織 麻衣 奈々 恵美 智子 京子 良子 節子 文子 陽子 順子 典子 紀子 理恵 真理子 綾香 七海 美月 莉子".split()
)
#: Last characters that Japanese given names often have.
GIVEN_ENDS = frozenset("子美郎太一二男雄夫介輔也斗樹人平香菜奈花恵穂江代之彦志")

_given = {n.lower() for n in GIVEN + ROMAN_GIVEN}
_family = {n.lower() for n in FAMILY + ROMAN_FAMILY}
_jp_family, _jp_given = frozenset(JP_FAMILY), frozenset(JP_GIVEN)


def latin_kind(word: str) -> str:
    """G, F, B or - : whether a word is a common given name, family name, both or neither."""
    w = word.lower().rstrip(".")
    g, f = w in _given, w in _family
    return "B" if g and f else "G" if g else "F" if f else "-"


def japanese_kind(span: str) -> str:
    """Whether the span is a common family name, and a common or likely given name after it."""
    for k in (2, 3):
        family, given = span[:k], span[k:].lstrip()
        if family in _jp_family:
            return "F" if not given else "FG" if given in _jp_given else "Fg" if given[-1] in GIVEN_ENDS and len(given) <= 3 else "F?" if len(given) <= 3 else "F+"
    return "G" if span in _jp_given else "-"
