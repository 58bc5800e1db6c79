"""Labelled documents by construction: prose, lists, tables and junk in many notations.

A bounded sample (``n`` documents, a parameter) that a rule list is fitted on. The kind of each document is known because
it is composed as one. Prose takes its frame from the given table of common words and its content from the general
vocabulary below; tables, lists and junk are drawn over wide families of notations. No document of a corpus is read.
"""

from __future__ import annotations

import random

#: General vocabulary of everyday subjects, per language.
CONTENT: dict[str, str] = {
    "en": "bread river teacher window garden letter winter market station kitchen bicycle mountain doctor music paper morning village bridge coffee summer holiday neighbour painting lesson journey harvest library blanket forest island recipe orchestra passport umbrella museum opened bought carried promised noticed repaired forgot painted crossed finished visited wondered explained slowly quietly twice yesterday almost careful bright heavy strange gentle useful",
    "de": "Brot Fluss Lehrerin Fenster Garten Brief Winter Markt Bahnhof Küche Fahrrad Berg Arzt Musik Papier Morgen Dorf Brücke Kaffee Sommer Urlaub Nachbar Gemälde Stunde Reise Ernte Bücherei Decke Wald Insel Rezept gekauft getragen versprochen bemerkt vergessen gestrichen beendet besucht erklärt langsam leise zweimal fast vorsichtig hell schwer seltsam nützlich",
    "fr": "pain rivière professeur fenêtre jardin lettre hiver marché gare cuisine vélo montagne médecin musique papier matin village pont café été vacances voisin tableau leçon voyage récolte bibliothèque couverture forêt île recette acheté porté promis remarqué oublié peint terminé visité expliqué lentement deux presque prudent clair lourd étrange utile",
    "es": "pan río maestra ventana jardín carta invierno mercado estación cocina bicicleta montaña médico música papel mañana pueblo puente café verano vacaciones vecino cuadro lección viaje cosecha biblioteca manta bosque isla receta compré llevé prometí olvidé pinté terminé visité expliqué despacio dos casi claro pesado extraño útil",
    "ru": "хлеб река учитель окно сад письмо зима рынок вокзал кухня велосипед гора врач музыка бумага утро деревня мост кофе лето отпуск сосед картина урок поездка урожай библиотека одеяло лес остров рецепт купил нёс обещал заметил забыл покрасил закончил посетил объяснил медленно тихо дважды почти осторожно светлый тяжёлый странный полезный",
    "ja": "パン 川 先生 窓 庭 手紙 冬 市場 駅 台所 自転車 山 医者 音楽 紙 朝 村 橋 コーヒー 夏 休み 隣人 絵 授業 旅行 図書館 毛布 森 島 料理",
}
WORDS = {k: tuple(v.split()) for k, v in CONTENT.items()}
#: Used where the table of common words has none for a language.
FRAME: dict[str, str] = {
    "en": "the of and to a in is it that was for on with but not you have we my they this had from by when",
    "de": "der die das und ist nicht ich ein zu in mit auf es war bei mir noch aber wenn hat für",
    "fr": "le la les de et est un une que ne pas je il pour dans avec plus sur ce mais mon",
    "es": "el la los de y que en un una no es se por con mi para lo ya muy pero al",
    "ru": "и в не на я что с у меня как по это но был когда так мой всё уже",
    "ja": "です ます ました こと この その まだ ある",
}
SENTENCES: dict[str, tuple[str, ...]] = {
    "en": (
        "My grandmother baked this every Sunday, and nobody has managed it since.",
        "Is there a quicker way to the station from here?",
        "They closed the museum early, so we walked along the river instead.",
        "Great lesson, thanks a lot!",
        "Never again.",
        "Whoever left the blanket in the library can collect it tomorrow.",
        "Learn to paint in four weeks and pay only for three!",
        "It took us 45 minutes because the bridge was closed, then another 20 to park.",
        "Same problem here, no idea what else to try.",
        "Sounds like your neighbour never sleeps.",
        "Sorry, wrong thread.",
        "Works now, cheers.",
    ),
    "de": ("Gestern hat es den ganzen Tag geregnet, deshalb blieben wir zu Hause.", "Kennt jemand ein gutes Rezept für Kürbissuppe?", "Das hätte ich nie gedacht!", "Danke, jetzt klappt es.", "Der Zug hatte 35 Minuten Verspätung.", "Leider keine Antwort bisher.", "Unsere Nachbarn ziehen im Mai um."),
    "fr": ("Hier soir nous avons mangé dehors malgré le vent.", "Quelqu'un a vu le dernier film ?", "Merci beaucoup, très utile !", "Il faut compter 40 minutes à pied.", "Toujours pas de réponse.", "Mon voisin joue du violon chaque matin."),
    "es": ("Ayer llovió tanto que suspendieron el mercado.", "¿Alguien conoce una buena panadería?", "Muchas gracias, me sirvió.", "El tren tardó 50 minutos.", "Sigo sin respuesta.", "Mis vecinos pintan la casa cada verano."),
    "ru": ("Вчера весь день шёл дождь, и мы остались дома.", "Кто знает хороший рецепт супа?", "Большое спасибо, получилось!", "Поезд опоздал на 35 минут.", "Ответа пока нет.", "Сосед играет на скрипке каждое утро."),
    "ja": ("昨日は雨が降りました。", "いいパン屋をご存じですか。", "ありがとうございました。", "電車が35分遅れました。", "返事がまだありません", "隣の人は毎朝バイオリンを弾きます。"),
}
LANGS = tuple(CONTENT)
SYLLABLES = ("ka", "ro", "min", "tel", "va", "su", "dor", "pi", "lan", "gre", "mo", "xi", "hul", "be", "for")
HEADINGS = ("Shopping:", "What to pack", "Einkauf", "Programme :", "Results", "Lista:", "Список", "Stock today:", "Timetable", "Für Samstag")


def _name(r: random.Random) -> str:
    return "".join(r.choice(SYLLABLES) for _ in range(r.choice((2, 2, 3)))).capitalize()


def _thing(r: random.Random, lang: str) -> str:
    w = r.choice(WORDS[lang])
    if r.random() < 0.15:
        return f"{_name(r)}{r.choice(('', ' ', '-'))}{r.randint(2, 999)}"
    return w if r.random() < 0.5 or lang == "ja" else f"{w} {r.choice(WORDS[lang])}"


def _clause(r: random.Random, lang: str, common: dict[str, tuple[str, ...]], rate: float) -> str:
    out = []
    for i in range(r.choice((3, 5, 8, 12, 18))):
        if r.random() < rate:
            out.append(r.choice(common[lang]))
        elif r.random() < 0.06:
            out.append(str(r.randint(2, 2000)) if r.random() < 0.6 else f"{_name(r)}{r.randint(2, 99)}")
        else:
            out.append(r.choice(WORDS[lang]))
        if i and r.random() < 0.08:
            out[-1] += "、" if lang == "ja" else ","
    text = ("" if lang == "ja" else " ").join(out)
    return text[:1].upper() + text[1:] + (r.choice(("。", "。", "？", "")) if lang == "ja" else r.choice((".", ".", ".", "!", "?", "...", ":", "")))


def _sentence(r: random.Random, lang: str, common: dict[str, tuple[str, ...]], rate: float) -> str:
    return r.choice(SENTENCES[lang]) if r.random() < 0.35 else _clause(r, lang, common, rate)


def _wrap(text: str, width: int) -> str:
    out, line = [], ""
    for w in text.split(" "):
        if line and len(line) + len(w) + 1 > width:
            out.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def _cut(text: str, width: int) -> str:
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))


def prose(r: random.Random, common: dict[str, tuple[str, ...]]) -> str:
    """Sentences of one language: quoted, signed, badly typed, wrapped, marked up, with a few items or readings; or a bare remark."""
    if r.random() < 0.04:
        words = " ".join(r.choice(WORDS[r.choice(LANGS)]) for _ in range(r.randint(1, 4)))
        return r.choice(("[{}]", "({})", "<i>{}</i>", "*{}*", "{}.", "*** {} ***", "{}")).format(words)
    lang = r.choices(LANGS, (5, 2, 2, 2, 2, 2))[0]
    rate = r.uniform(0.25, 0.6)
    glue = "" if lang == "ja" else " "
    parts = [glue.join(_sentence(r, lang, common, rate) for _ in range(r.randint(1, 5))) for _ in range(r.choice((1, 1, 1, 2, 3, 6)))]
    if r.random() < 0.25:
        parts = [p.lower().replace(". ", r.choice((" ", ", ", " ... "))).rstrip(".!?。") for p in parts]
    if r.random() < 0.1:
        parts = ["".join(ch for ch in p if ch.isalnum() or ch.isspace()).lower() for p in parts]
    if r.random() < 0.12:
        parts[-1] += " " + r.choice((f"See https://{_name(r).lower()}.example/{r.randint(1, 9999)} for more.", f"www.{_name(r).lower()}.example has a picture.", f"#{_name(r).lower()}", f"@{_name(r).lower()} what do you say?"))
    if r.random() < 0.06:
        parts = [p.upper() for p in parts]
    if r.random() < 0.3 and lang != "ja":
        parts = [_wrap(p, r.randint(30, 80)) for p in parts]
    if r.random() < 0.1:
        parts = [p.replace(" ", "  ") for p in parts]
    text = r.choice(("\n\n", "\n \n", "\n")).join(parts)
    if r.random() < 0.25:
        mark = r.choice(("> ", ">", ">> ", "> > ", "| "))
        text = r.choice(("", f"{_name(r)}:\n", f"On Monday {_name(r)} wrote:\n")) + "\n".join(mark + x for x in text.split("\n")) + "\n" + _sentence(r, lang, common, rate)
    if r.random() < 0.1:
        text = f"[quote={_name(r)}]{text}[/quote]\n{_sentence(r, lang, common, rate)}"
    if r.random() < 0.18:
        words = text.split(" ")
        for _ in range(r.randint(1, 5)):
            i = r.randrange(len(words))
            words[i] = r.choice(("<b>{}</b>", "[i]{}[/i]", "{}&amp;", "_{}_", "<br>{}", '<a href="x">{}</a>')).format(words[i])
        text = " ".join(words)
    if r.random() < 0.12 and len(text) > 150:
        lines = text.split("\n")
        at = r.randrange(len(lines) + 1)
        text = "\n".join([*lines[:at], *[f"{r.choice('-*•')} {_thing(r, lang)}" for _ in range(r.randint(1, 3))], *lines[at:]])
    if r.random() < 0.1 and len(text) > 150:
        lines = text.split("\n")
        at, k = r.randrange(len(lines) + 1), r.randint(2, 4)
        text = "\n".join([*lines[:at], "", *[r.choice((" ", "  ", "\t", ", ")).join(_value(r, 0.2 * j + 0.3, lang) for j in range(k)) for _ in range(r.randint(1, 4))], "", *lines[at:]])
    if r.random() < 0.2:
        text += r.choice(("\n-- \n", "\n\n--\n", "\n________\n")) + r.choice((_name(r), f"~{_name(r)}~", "be kind", "sent on the way home"))
    return text + (r.choice((" :)", " 🙂", "!!!", "???")) if r.random() < 0.1 else "")


def _item(r: random.Random, lang: str, common: dict[str, tuple[str, ...]]) -> str:
    n = _thing(r, lang)
    joined = f"{n} {r.choice(common[lang])} {r.choice(WORDS[lang])}"
    return r.choice((n, n, n, f"{r.randint(2, 40)} {r.choice(('', 'x ', 'kg ', 'pcs '))}{n}", f"{n} ({_name(r)})", f"{n} ({r.choice((_name(r), _name(r).lower()))}{r.choice(('', ' ', '-'))}{r.randint(2, 999)})", f"{n}, {r.choice(WORDS[lang])}", f"{n} + {_thing(r, lang)}", f"{n} {r.randint(2, 900)}", joined, f"{n}: {r.choice(WORDS[lang])}"))


def listing(r: random.Random, common: dict[str, tuple[str, ...]]) -> str:
    """Lines that are items, marked in one of many ways or not, or items in one line."""
    lang = r.choices(LANGS, (5, 2, 2, 2, 2, 2))[0]
    n = r.randint(4, 40)
    if r.random() < 0.15:
        pool = r.sample(WORDS[lang], min(len(WORDS[lang]), max(8, n)))
        return r.choice(("", r.choice(HEADINGS) + " ")) + r.choice((", ", "; ", " / ", " · ")).join(f"{r.randint(2, 12)} {w}" if r.random() < 0.2 else w for w in pool)
    mark = r.choice(("- ", "* ", "+ ", "• ", "n) ", "n. ", "(n) ", "[ ] ", "[x] ", "[*]", "<li>", "→ ", "✓ ", "– ", "» ", "a) ", "", "", "", ""))
    end = r.choice(("", "", "", ",", ";", "."))
    nest = r.random() < 0.3
    lines = []
    for i in range(n):
        x = _item(r, lang, common)
        x = x[0].upper() + x[1:] if r.random() < 0.5 else x
        head = mark.replace("n", str(i + 1)) if mark[:1] in "n(" else mark.replace("a", "abcdefghijklmnopqrstuvwxyz"[i % 26]) if mark == "a) " else mark
        lines.append(("  " if nest and r.random() < 0.3 else "") + head + x + end)
    if mark == "[*]":
        lines = ["[list]", *lines, "[/list]"]
    if r.random() < 0.3:
        lines.insert(0, r.choice(HEADINGS))
    if r.random() < 0.15 and n > 8:
        lines.insert(r.choice((0, len(lines))), _sentence(r, lang, common, 0.45))
    return "\n".join(lines)


def _value(r: random.Random, kind: float, lang: str) -> str:
    if r.random() < 0.06:
        return r.choice(("", "-", "n/a", "?"))
    if kind < 0.3:
        return r.choice(WORDS[lang])
    if kind < 0.45:
        return _thing(r, lang)
    if kind < 0.6:
        return r.choice((f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.", f"{r.randint(0, 23)}:{r.randint(0, 59):02d}"))
    return str(r.randint(1, 5000)) if kind < 0.85 else f"{r.uniform(-9, 900):.2f}"


def table(r: random.Random, common: dict[str, tuple[str, ...]]) -> str:
    """Rows of cells in one of many notations."""
    lang = r.choice(("en", "en", "de", "fr", "es", "ru"))
    n, k = r.randint(3, 40), r.randint(2, 6)
    kinds = [r.random() for _ in range(k)]
    if r.random() < 0.7:
        kinds[-1] = r.uniform(0.45, 1)
    rows = [[_value(r, kinds[j], lang) for j in range(k)] for _ in range(n)]
    head = [r.choice(WORDS[lang]) for _ in range(k)]
    style = r.choice(("sep", "sep", "sep", "sep", "pipe", "box", "html", "align", "align", "lead", "pairs", "fields", "one"))
    if style not in ("pairs", "fields") and r.random() < 0.55:
        rows.insert(0, head)
    if style == "sep":
        sep = r.choice((",", ";", "\t", "|", " | ", "~", " ~ ", ":", " / ", "/", " = ", ", ", "; ", " & ", " · "))
        lines = [sep.join(x) for x in rows]
    elif style == "one":
        lines = [" ".join(c.replace(" ", "_") or "-" for c in x) for x in rows]
    elif style == "pairs":
        sep, eq = r.choice((" / ", ", ", "; ", " ", " | ")), r.choice((": ", "=", "="))
        lines = [sep.join(f"{h}{eq}{c}" for h, c in zip(head, x, strict=True)) for x in rows]
    elif style == "fields":
        lines = [f"{_thing(r, lang)}{r.choice((': ', ' = '))}{x[-1]}" for x in rows]
    elif style == "pipe":
        lines = ["| " + " | ".join(x) + " |" for x in rows]
        lines.insert(1, "|" + "---|" * k)
    elif style == "html":
        lines = ["<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in rows]
    elif style == "lead":
        lines = [x[0] + " " + "." * max(3, 30 - len(x[0])) + " " + " ".join(x[1:]) for x in rows]
    else:
        width = [max(len(x[j]) for x in rows) + 2 for j in range(k)]
        if style == "box":
            bar = "+" + "+".join(r.choice("-=") * w for w in width) + "+"
            lines = [bar, *["|" + "|".join(c.rjust(w - 1) + " " for c, w in zip(x, width, strict=True)) + "|" for x in rows], bar]
        else:
            lines = ["".join(c.ljust(w) for c, w in zip(x, width, strict=True)).rstrip() for x in rows]
    if r.random() < 0.3:
        lines.insert(0, r.choice(HEADINGS))
    if r.random() < 0.1:
        lines.insert(r.choice((0, len(lines))), _sentence(r, lang, common, 0.45))
    return "\n".join(lines)


def _wrong(r: random.Random, common: dict[str, tuple[str, ...]]) -> str:
    """Text read in the wrong encoding."""
    lang = r.choice(("ru", "ru", "ja", "fr", "de", "es"))
    text = " ".join(_sentence(r, lang, common, 0.4) for _ in range(r.randint(2, 8)))
    if lang == "ru" and r.random() < 0.4:
        return text.encode(r.choice(("cp1251", "koi8-r")), "ignore").decode("latin-1")
    for _ in range(1 if lang in ("ru", "ja") else 3):
        text = text.encode("utf-8").decode(r.choice(("cp1252", "latin-1")), r.choice(("ignore", "replace")))
    if lang not in ("ru", "ja"):
        text = "".join(ch for ch in text if not ch.isascii()) or "�" * 40
    return text


def junk(r: random.Random, common: dict[str, tuple[str, ...]]) -> str:
    """Noise, residue and mere heaps."""
    n = r.choice((r.randint(25, 120), r.randint(60, 1500)))
    draw = lambda chars: "".join(r.choice(chars) for _ in range(n))
    kind = r.choice(("wrong", "wrong", "bytes", "base64", "hex", "uuid", "numbers", "symbols", "pictures", "keywords", "keywords", "tags", "links", "letters", "mash", "markup", "same", "shuffled"))
    if kind == "wrong":
        return _wrong(r, common)
    if kind == "bytes":
        return bytes(r.choice(b"\xc2\xc3\xe2\xc5\x80\x82\x84\x99\x9c\xa2\xa4\xac\xbd\xbe\xbf") for _ in range(n)).decode(r.choice(("cp1252", "latin-1")), "replace")
    if kind == "same":
        return r.choice((r.choice("!?.-*#=xo…~あ"), r.choice(("lol", "na", "ab", "hm ", "no ", "わ")))) * max(12, n // 2)
    if kind == "base64":
        return _cut(draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), r.choice((40, 64, 76, 10_000)))
    if kind == "hex":
        return "\n".join(" ".join(f"{r.randrange(256):02x}" for _ in range(r.choice((8, 16)))) for _ in range(max(2, n // 48)))
    if kind == "uuid":
        return r.choice((" ", "\n")).join(f"{r.randrange(16**8):08x}-{r.randrange(16**4):04x}-{r.randrange(16**12):012x}" for _ in range(max(3, n // 26)))
    if kind == "numbers":
        return r.choice((" ", " ", ", ")).join(str(r.randint(0, 10 ** r.randint(1, 8))) for _ in range(max(12, n // 6)))
    if kind == "symbols":
        return _cut(draw("#|/*\\_-~=<>+^$%&°§{}[]()@!?;:"), r.choice((20, 60, 10_000)))
    if kind == "pictures":
        a = r.choice((0x2190, 0x2500, 0x2580, 0x25A0, 0x2600, 0x2700))
        return "".join(chr(a + r.randrange(0x60)) for _ in range(n))
    if kind == "keywords":
        lang = r.choice(("en", "en", "de", "es", "fr"))
        pool = [_name(r).lower() for _ in range(5)] + r.sample(WORDS[lang], 4) + (["cheap", "sale", "free"] if lang == "en" else [])
        return r.choice((" ", " ", ", ")).join(r.choice(pool) for _ in range(max(15, n // 7)))
    if kind == "shuffled":
        pool = [w for lang in LANGS[:4] for w in WORDS[lang]] + [str(r.randint(1, 99_999)) for _ in range(40)]
        return " ".join(r.choice(pool) for _ in range(max(15, n // 7)))
    if kind == "tags":
        numbered = r.choice((0.0, 0.5, 1.0))
        words = [f"#{_name(r).lower()}{r.randint(1, 99) if r.random() < numbered else ''}" for _ in range(max(8, n // 9))]
        k = r.randint(4, 14)
        return "\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))
    if kind == "links":
        return r.choice(("\n", " ")).join(f"http{r.choice(('', 's'))}://{_name(r).lower()}.example/{_name(r).lower()}{r.choice(('', '?id=' + str(r.randrange(10**8))))}" for _ in range(max(3, n // 50)))
    if kind == "letters":
        letters = r.choice(("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzäöüß", "абвгдежзийклмнопрстуфхцчшщъыьэюя"))
        most = r.choice((10, 14, 40))
        return r.choice((" ", " ", "\n")).join("".join(r.choice(letters) for _ in range(r.randint(4, most))) for _ in range(max(6, n // 14)))
    if kind == "mash":
        rows = r.choice((("asdfghjkl", "qwertyuiop", "zxcvbnm"), ("asdfjkl", "sdfghjk"), ("йцукен", "фывапролдж", "ячсмить")))
        return " ".join("".join(r.choice(r.choice(rows)) for _ in range(r.randint(3, 12))) for _ in range(max(6, n // 8)))
    bits = ("<span>", "</span>", '<div class="x">', "</div>", "[b]", "[/b]", "[img]", "[/img]", "&nbsp;", "<br>", "&gt;", "[url=]", "[/url]", "<p>", "</p>", "\n", " ")
    return "".join(r.choice(bits) for _ in range(max(12, n // 8)))


KINDS = {"prose": prose, "list": listing, "table": table, "junk": junk}


def labelled_documents(n: int = 6_000, seed: int = 11, common: dict[str, list[str]] | None = None) -> list[tuple[int, str, str]]:
    """(doc_id, text, kind) of n documents, two fifths of them prose; ``common`` are the common words per language."""
    r = random.Random(seed)
    frame = {lang: tuple((common or {}).get(lang) or FRAME[lang].split()) for lang in LANGS}
    out = []
    for i in range(n):
        kind = r.choices(list(KINDS), (4, 2, 2, 2))[0]
        out.append((i, KINDS[kind](r, frame), kind))
    return out
