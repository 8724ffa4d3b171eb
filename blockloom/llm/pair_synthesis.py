"""Synthetic defective answers: what a classifier of pairs learns from beside the corpus itself."""

from __future__ import annotations

import random

OPENINGS = (
    "", "Sorry, ", "I'm sorry, but ", "I am sorry, but ", "I apologize, but ", "I apologize; ", "My apologies, ", "Apologies — ", "Unfortunately, ", "Regrettably, ",
    "As an AI, ", "As an AI language model, ", "As an assistant, ", "As a translator, ", "I am afraid ", "I'm afraid that ", "Thank you for asking, but ", "Thanks for the message; however, ",
)
REFUSALS = (
    "I cannot {v} {o}", "I can't {v} {o}", "I am unable to {v} {o}", "I'm not able to {v} {o}", "I am not able to {v} {o}", "I must decline to {v} {o}", "I have to decline to {v} {o}", "I won't {v} {o}",
    "I will not {v} {o}", "I do not feel comfortable {g} {o}", "I would rather not {v} {o}", "I refuse to {v} {o}", "I won't be able to {v} {o}", "it is not possible to {v} {o}", "{o} is outside what I am allowed to do",
    "{o} may breach the usage rules, so no output is given", "{o} violates the content policy", "{o} goes against my guidelines", "no translation will be given for {o}", "unable to {v} {o}", "unable to comply with {o}",
    "cannot comply with {o}", "translation of {o} is not available", "no translation can be provided", "I cannot assist with that", "I can't help with that", "I cannot fulfil {o}",
)
NOTES = (
    "translation withheld", "[translation withheld: content rule]", "[no translation: policy]", "[withheld]", "[content removed]", "(translation refused)", "Translation not available.", "Translation refused.", "Request declined.",
    "Request declined by the service.", "Request declined by the translation service.", "No translation will be given for this item.", "No translation provided.", "Unable to translate.", "Unable to comply with this request.", "Cannot translate.", "Content blocked by the filter.",
    "<refused>", "N/A - cannot translate", "Output blocked: content rule", "This item cannot be translated.", "The translation of this block was declined.",
)
VERBS = (("translate", "translating"), ("help with", "helping with"), ("assist with", "assisting with"), ("process", "processing"), ("render", "rendering"), ("convert", "converting"), ("provide a translation of", "providing a translation of"), ("complete", "completing"), ("answer", "answering"), ("provide a rendering of", "giving a rendering of"))
OBJECTS = ("this text", "that", "this request", "this passage", "the source line", "this sentence", "the content you sent", "the supplied wording", "your message", "this translation", "this item", "this translation request", "the provided content", "this block")
REASONS = ("", "", "", " because the context is missing", " at this time", " because of its content", " due to policy", " as it may be protected", " without more context")
CLOSINGS = ("", "", "", " Please send a different text.", " Is there anything else I can do?", " Is there another block you would like me to look at?", " Let me know if I can assist with anything else.", " Please try again.", " Please provide another text.")
OTHER_REFUSALS = (
    "申し訳ありませんが、この文章は翻訳できません。", "申し訳ございませんが、ご要望にはお応えできません。", "ご依頼の内容にはお答えいたしかねます。", "すみません、このテキストを翻訳することはできません。",
    "恐れ入りますが、翻訳をお断りします。", "この依頼には対応できません。", "この内容の翻訳は控えさせていただきます。", "翻訳できません。", "お手伝いできません。", "利用規約に反するため、出力できません。",
    "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Leider kann ich bei dieser Anfrage nicht helfen.", "Diese Anfrage kann ich nicht bearbeiten.", "Je suis désolé, mais je ne peux pas traduire ce texte.",
    "Désolé, je ne peux pas répondre à cette demande.", "Lo siento, pero no puedo traducir este texto.", "No puedo ayudar con esta solicitud.", "Mi dispiace, ma non posso tradurre questo testo.",
    "Desculpe, mas não posso traduzir este texto.", "죄송하지만 이 텍스트는 번역할 수 없습니다.", "요청하신 내용은 도와드릴 수 없습니다.", "抱歉，我无法翻译这段文字。", "很抱歉，我不能提供此内容的翻译。", "对不起，无法完成该请求。",
)
FOREIGN = (
    # German
    "Drücken Sie die Taste und warten Sie 5 Sekunden.", "Entfernen Sie die Schrauben, bevor Sie die Batterien einlegen.", "Es gibt 8 Stimmen und drei Töne.", "Bewahren Sie den Karton und die Anleitung gut auf.",
    "Ziehen Sie am Hebel, dann leuchtet die Lampe auf.", "Bitte nicht nass machen und keinen starken Stößen aussetzen.", "Das Spielzeug ist nicht für Kinder unter drei Jahren geeignet.", "Der Griff wird mit dem Gürtel verbunden und der Ton ist zu hören.",
    "Schalten Sie das Gerät nach dem Gebrauch immer aus.", "Die Karte hat 4 Seiten, und auf der Rückseite ist ein Bild.", "der die das und ist nicht ein eine mit auf für von zu den dem des im Sie er wird werden auch bei nach aus wenn dann",
    # French
    "Appuyez sur le bouton et attendez 5 secondes.", "Retirez les vis avant de mettre les piles.", "Il existe 8 voix et trois sons.", "Conservez la boîte et la notice dans un lieu sûr.", "Tirez le levier et la lampe s'allume.",
    "Ne pas mouiller et éviter les chocs violents.", "Ce jouet ne convient pas aux enfants de moins de trois ans.", "La poignée se fixe à la ceinture et le son est joué.", "Éteignez toujours l'appareil après usage.", "Elle compte 4 pages et une image au dos.",
    "le la les un une des et est ne pas dans pour avec sur du de au aux que qui il elle vous ce cette son ses par plus",
    # Spanish
    "Pulse el botón y espere 5 segundos.", "Quite los tornillos antes de colocar las pilas.", "Hay 8 voces y tres sonidos.", "Guarde la caja y el manual en un lugar seguro.", "Tire de la palanca y la lámpara se ilumina.",
    "No lo moje ni lo golpee con fuerza.", "Este juguete no es apto para niños menores de tres años.", "El mango se une al cinturón y suena la voz.", "Apague siempre el aparato después de usarlo.", "Tiene 4 páginas y una imagen al dorso.",
    "el la los las un una y es no en para con por de del al que se su lo como más este esta",
    # Italian, Portuguese, Dutch
    "Premere il pulsante e attendere 5 secondi.", "Rimuovere le viti prima di inserire le pile.", "Ci sono 8 voci e tre suoni.", "Conservare la scatola e il manuale in un luogo sicuro.", "il lo la gli le un una e è non in per con di del che si su come più questo",
    "Pressione o botão e espere 5 segundos.", "Retire os parafusos antes de colocar as pilhas.", "Existem 8 vozes e três sons.", "Guarde a caixa e o manual em local seguro.", "o a os as um uma e é não em para com por de do da que se como mais este esta",
    "Druk op de knop en wacht 5 seconden.", "Verwijder de schroeven voordat u de batterijen plaatst.", "Bewaar de doos en de handleiding goed.", "de het een en is niet in voor met op van te dat die er zijn aan door u",
    # Japanese in Latin letters
    "Botan wo oshite kara 5 byou omachi kudasai.", "Denchi wo ireru mae ni neji wo hazushite kudasai.", "Onsei wa 8 shurui arimasu.", "Hako to setsumeisho wa taisetsu ni hokan shite kudasai.", "Rebaa wo hiku to ranpu ga hikarimasu.",
    "Mizu ni nurasanaide kudasai.", "Chiisana buhin ga arimasu node, kodomo ni wa zettai ni ataenaide kudasai.", "Gurippu wo beruto ni tsunagu to oto ga narimasu.", "Shiyou go wa kanarazu dengen wo kitte kudasai.", "Uramen ni haru shiiru desu.",
    "Tsuyoi shougeki wo ataenaide kudasai. 5 kai made kakunin dekimasu.", "Kono seihin wa tasha no mono ni wa setsuzoku dekimasen.", "wo ni wa ga no to de mo kara made desu masu kudasai shite arimasu suru naide nai dekimasu",
    # Korean, Chinese, Russian
    "버튼을 누른 후 5초 기다려 주세요.", "건전지를 넣기 전에 나사를 풀어 주세요.", "음성은 8종류입니다.", "상자와 설명서는 소중히 보관해 주세요.", "레버를 당기면 램프가 빛납니다.", "물에 젖지 않게 하세요. 30년 보관할 수 있습니다.",
    "按下按钮后请等待5秒。", "装入电池前请先拆下螺丝。", "语音共有8种。", "请妥善保管包装盒和说明书。", "拉动拉杆，灯就会发光。", "请勿弄湿，可保存30年。", "请勿用力撞击，最多可确认12次。",
    "Нажмите кнопку и подождите 5 секунд.", "Храните коробку и инструкцию в надёжном месте.", "Не мочите изделие и не ударяйте его.",
)
FOREIGN += (
    # Polish, Turkish, Vietnamese, Greek
    "Naciśnij przycisk i poczekaj pięć sekund.", "Przed włożeniem baterii odkręć śruby.", "Zachowaj pudełko i instrukcję w bezpiecznym miejscu.", "Zabawka nie jest odpowiednia dla małych dzieci.", "Po użyciu zawsze wyłączaj urządzenie.", "i w na nie się z do jest to że o jak po ale za od przez tylko być dla przy",
    "Düğmeye basın ve beş saniye bekleyin.", "Pilleri takmadan önce vidaları sökün.", "Kutuyu ve kılavuzu güvenli bir yerde saklayın.", "Bu oyuncak küçük çocuklar için uygun değildir.", "Kullandıktan sonra cihazı mutlaka kapatın.", "ve bir bu için ile de da çok olarak daha gibi kadar sonra olan var yok değil ne en her",
    "Nhấn nút và chờ năm giây.", "Hãy tháo ốc trước khi lắp pin.", "Giữ hộp và sách hướng dẫn ở nơi an toàn.", "Đồ chơi này không phù hợp với trẻ nhỏ.", "Luôn tắt thiết bị sau khi sử dụng.", "và của là có không được cho các một trong với này khi để người đã những",
    "Πατήστε το κουμπί και περιμένετε πέντε δευτερόλεπτα.", "Φυλάξτε το κουτί και τις οδηγίες.", "Το παιχνίδι δεν είναι κατάλληλο για μικρά παιδιά.",
    # Swedish, Danish, Finnish, Czech, Hungarian, Romanian, Indonesian
    "Tryck på knappen och vänta i fem sekunder.", "Ta bort skruvarna innan du sätter i batterierna.", "Förvara lådan och bruksanvisningen på ett säkert ställe.", "Leksaken är inte lämplig för små barn.", "och att det som en på är av för med den till inte om ett men har de så",
    "Tryk på knappen, og vent fem sekunder.", "Fjern skruerne, før du sætter batterierne i.", "Opbevar æsken og vejledningen et sikkert sted.", "og at det er en til på som med for af den ikke der har de et men om",
    "Paina painiketta ja odota viisi sekuntia.", "Irrota ruuvit ennen paristojen asettamista.", "Säilytä laatikko ja ohjeet turvallisessa paikassa.", "ja on ei se että oli mutta kun niin myös tai jos ovat joka mitä kaikki",
    "Stiskněte tlačítko a počkejte pět sekund.", "Před vložením baterií odšroubujte šrouby.", "Krabici a návod uschovejte na bezpečném místě.", "a se v na je že to s z do o ale jako za po jsem tak by který pro",
    "Nyomja meg a gombot, és várjon öt másodpercet.", "Az elemek behelyezése előtt távolítsa el a csavarokat.", "A dobozt és az útmutatót őrizze meg.", "a az és hogy nem is egy de meg ez csak volt már el mint vagy ki még",
    "Apăsați butonul și așteptați cinci secunde.", "Scoateți șuruburile înainte de a pune bateriile.", "Păstrați cutia și manualul într-un loc sigur.", "și în de la cu pe nu a că o este mai din care se un pentru",
    "Tekan tombol dan tunggu selama lima detik.", "Lepaskan sekrup sebelum memasang baterai.", "Simpan kotak dan buku petunjuk di tempat yang aman.", "dan yang di untuk dengan tidak ini itu dari dalam pada adalah ke akan juga bisa ada",
    # Japanese in Latin letters, everyday
    "Kyou wa ii tenki desu ne.", "Kinou Toukyou e ikimashita.", "Sumimasen ga, mou ichido itte kudasai.", "Watashi wa omocha ga daisuki desu.", "Kare wa ashita kaimasu to iimashita.", "Arigatou gozaimashita. Mata kimasu.",
    # Ukrainian, Arabic, Hebrew, Thai, Hindi
    "Натисніть кнопку і зачекайте п'ять секунд.", "اضغط على الزر وانتظر خمس ثوان.", "احتفظ بالعلبة والتعليمات في مكان آمن.", "לחץ על הכפתור והמתן חמש שניות.", "กดปุ่มแล้วรอห้าวินาที", "बटन दबाएँ और पाँच सेकंड प्रतीक्षा करें।",
)
#: Sound English of everyday and of manuals: no refusals, though much of it denies or forbids.
ENGLISH = (
    "He travelled to Tokyo yesterday.", "She cannot swim very well.", "The weather was awful last week, wasn't it?", "I don't like coffee, but my brother does.", "We were unable to find the station in time.", "It isn't raining any more.", "They refused to sell the house.", "Nobody knows where the keys are.",
    "The train does not stop at this platform.", "My grandmother used to tell us stories about the sea.", "You won't believe what happened at the market.", "Could you pass me the salt, please?", "The museum is closed on Mondays.", "This road leads to a small village near the river.", "I am sorry to hear about your cat.", "He apologised for being late.",
    "Unfortunately, the concert was cancelled.", "There is nothing left in the fridge.", "Children under twelve may enter free of charge.", "The garden looks wonderful in spring.", "She has been working there for ten years.", "What time does the library open?", "Our neighbours moved away without saying goodbye.", "It took us three hours to climb the hill.",
    "Never leave the stove unattended.", "Do not place near an open flame.", "Keep away from heat and direct sunlight.", "Not suitable for outdoor use.", "This model is not waterproof.", "The lid cannot be opened from the inside.", "It is not possible to replace the lamp.", "No tools are needed for assembly.", "Do not wash in a machine.", "Colours may differ from the picture.",
    "Contents are subject to change without notice.", "Please read all warnings first.", "Adult supervision is required.", "This feature is not available in all regions.", "Small parts may be swallowed.", "Stop using it if it becomes hot.", "Do not mix old and new cells.", "The warranty does not cover damage by water.", "Wipe with a dry cloth.", "Made of recycled paper.",
    "Store it where infants cannot get hold of it.", "Our apologies for the misprint on page nine.", "Sorry for the wait! The second set ships in June.", "The voice can no longer be heard once the lid is shut.", "I can't wait to see the new figure.", "We do not accept returns of opened packs.", "Assistance is offered at the counter.", "For help, ask a member of staff.", "The hero declines the offer and leaves the castle.",
    "Policy of the shop: one item per person.", "The request of the king was granted.", "That content is sold separately.", "No answer came from the tower.", "An assistant carries the lamp.", "Translated by the fan club.", "The text on the back is hard to read.", "This passage leads to the vault.", "The message plays twice.", "The source of light is a small diode.",
    "Batteries are not included.", "Unable to rotate? Loosen the knob a little.", "If nothing happens, press again.", "The villain won't give up so easily.", "Without the key the gate will not open.", "Nothing can stop the iron giant!", "I refuse to lose!", "He must not be allowed to escape.", "We can help you choose a size.", "The blade is blunt and will not cut.",
    "Twelve birds sat on the wire above the yard.", "A thick fog covered the harbour in the morning.", "The old clock struck nine.", "Two spoons of sugar are enough.", "Her letter arrived a month later.", "The judges chose the blue dress.", "Fresh bread smells best.", "Snow fell on the roofs all night.", "He plays the violin on Sundays.", "The doctor told me to rest.", "Cheap shoes rarely last.", "A fox crossed the lane.",
    "It cannot be worn under water.", "These parts cannot be ordered one by one.", "The mode cannot be changed during play.", "The sound cannot be turned off.", "This switch is not used.", "The cover can't be removed by hand.", "The other function isn't part of this edition.", "You can't use both handles at once.", "The effect will not be shown in this mode.",
    "It's a nice garden, isn't it?", "They live nearby, don't they?", "Is there anything left to eat?", "Is there another way to the beach?", "You have met before, haven't you?", "Can you hear the bell?", "Would you like some tea?", "Did the parcel arrive today?", "Shall we go for a walk this evening?",
    "Which of these maps shows the lake?", "Turn left after the bridge and follow the canal.", "The price includes breakfast and a towel.", "Most shops accept cards nowadays.", "My phone ran out of power on the way.", "We painted the fence green.", "The lecture was about medieval trade.", "Everyone laughed except the captain.", "Rice is grown in the valley.", "The bus leaves every twenty minutes.",
)
#: Common words, for the profile of English.
ENGLISH_WORDS = (
    "the of and to in is that it was for on are as with his they at be this have from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "get through back much before go good new write our used me man too any day same right look think also around another came come work three word must because does part even place well such here take why things help put years different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us left end along while might next sound below saw something thought both few those always looked show large often together asked house",
    "yesterday tomorrow travelled walked evening morning weather lovely beautiful children young reach keep store product feature waterproof allowed abroad someone nobody anything nothing everything without within against toward above across behind beyond during since until although however therefore quite rather already enough almost perhaps maybe please thanks friend family mother father brother sister",
)
LEADS = ("Translation: ", "Answer: ", "翻訳：", "訳：", "Original: ", "原文：", "> ", "\"", "「", "(", "* ")
TAILS = ("\n", " ", ".", "\n\n", "」", "\"", ")", " (ja)", "。")


def refusal(rng: random.Random) -> str:
    kind = rng.random()
    if kind < 0.25:
        return rng.choice(OTHER_REFUSALS)
    if kind < 0.4:
        return rng.choice(NOTES)
    verb, gerund = rng.choice(VERBS)
    core = rng.choice(REFUSALS).format(v=verb, g=gerund, o=rng.choice(OBJECTS))
    text = rng.choice(OPENINGS) + core + rng.choice(REASONS)
    text = text[:1].upper() + text[1:]
    return (text if text.endswith("]") else text + ".") + rng.choice(CLOSINGS)


def foreign(rng: random.Random, source: str, other: str) -> str:
    if rng.random() < 0.18:
        return other  # a Japanese text, but not that of the row
    return " ".join(rng.choice(FOREIGN) for _ in range(min(6, 1 + source.count("。"))))


def english(rng: random.Random, source: str) -> str:
    """Sound English of other wording than the corpus."""
    return " ".join(rng.choice(ENGLISH) for _ in range(min(6, max(1, source.count("。")))))


def garbled(rng: random.Random, answer: str) -> str:
    """The answer with some letters as a wrong encoding shows them: no defect of a pair."""
    out = [rng.choice(("â€™", "Ã©", "ã€", "ï¿½", "\ufffd", "ã‚")) if c in " .,'" and rng.random() < 0.12 else c for c in answer]
    return "".join(out)


def copied(rng: random.Random, source: str) -> str:
    kind = rng.random()
    if kind < 0.3:
        return source
    if kind < 0.5:
        return rng.choice(LEADS) + source
    if kind < 0.7:
        return source + rng.choice(TAILS)
    if kind < 0.8:
        return source + "\n" + source
    if kind < 0.9:
        return source.replace("。", "。 ") + rng.choice(TAILS)
    return rng.choice(LEADS) + source + rng.choice(TAILS)


def truncated(rng: random.Random, answer: str) -> str | None:
    """The answer cut in a word, after a word, or after a sentence; sometimes with dots."""
    answer = answer.strip()
    kind = rng.random()
    if kind < 0.45:
        ends = [i + 1 for i, c in enumerate(answer[:-1]) if c in ".!?\n" and answer[i + 1] in " \n" or c == "\n"]
        ends = [e for e in ends if e >= 8]
        if ends:
            return answer[: ends[-1] if rng.random() < 0.5 else rng.choice(ends)].rstrip()
    if len(answer) < 8:
        return None
    at = rng.randint(max(3, len(answer) // 5), len(answer) - max(2, len(answer) // 12))
    cut = answer[:at]
    if kind > 0.8:
        cut = cut[: cut.rfind(" ")] if " " in cut else cut
    return cut.rstrip() + (rng.choice(("...", "…", " ...")) if rng.random() < 0.2 else "") or None
