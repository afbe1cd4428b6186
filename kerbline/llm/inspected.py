"""Inspected examples of prose, lists, tables and junk, one entry per form; short ones are written out, long or
random ones are built by a rule with a fixed seed."""

from __future__ import annotations

import base64
import random

_THINGS = "pole wall hedge curb kerb trolley chain rope lamp bollard reflector bumper ramp barrier mirror sensor mount cable spare wheel door edge tape post".split()
_DINGE = "Pfosten Wand Hecke Bordstein Kette Lampe Schranke Rampe Maßband Gullydeckel Einkaufswagen Anhängerkupplung".split()
_CHOSES = "poteau mur haie bordure chaîne lampadaire barrière rampe caniveau chariot".split()
_COSAS = "poste pared seto bordillo cadena farola barrera rampa carrito".split()
_MONO = "縁石 壁 柱 生垣 照明灯 鎖 車止め 斜路 台車".split()


def examples() -> list[tuple[str, list[str]]]:
    """(kind, texts of one form) of every inspected form."""
    r = random.Random(7)
    thing = lambda pool: " ".join(r.sample(pool, r.choice((1, 2)))) + r.choice(("", "", "", ": 2", " (14)", " #8", " x2"))
    entries = lambda n, pool=_THINGS: [thing(pool) for _ in range(n)]
    pools = (_THINGS, _THINGS, _DINGE, _CHOSES, _COSAS)
    many = lambda make: [make(r.randint(6, 24), pool) for pool in pools for _ in range(3)]

    def cell(column: int) -> str:
        return (f"{r.randint(10, 4000)}", f"0.{r.randint(0, 99):02d}", thing(_THINGS).split(":")[0].split(" (")[0], r.choice(("front", "rear", "top")))[column % 4]

    def rows(n: int, pattern: list[int], empty: float = 0.04) -> list[list[str]]:
        return [["" if r.random() < empty else cell(c) for c in pattern] for _ in range(n)]

    names = ["frame", "ratio", "object", "camera", "xmin", "score", "class"]

    def tables(render) -> list[str]:
        out = []
        for _ in range(12):
            pattern = [r.choice((0, 0, 1, 2, 3)) for _ in range(r.randint(3, 7))]
            body = rows(r.randint(6, 30), pattern)
            out.append(render(([names[: len(pattern)]] if r.random() < 0.6 else []) + body))
        return out

    def grid(body: list[list[str]]) -> str:
        bar = "+" + "------------+" * len(body[0])
        return "\n".join([bar, *["|" + "|".join(f" {c[:10]:<10} " for c in x) + "|" for x in body], bar])

    def piped(body: list[list[str]]) -> str:
        out = ["| " + " | ".join(x) + " |" for x in body]
        return "\n".join([out[0], "|" + " --- |" * len(body[0]), *out[1:]])

    def aligned(body: list[list[str]]) -> str:
        wide = [max(len(x[i]) for x in body) for i in range(len(body[0]))]
        return "\n".join("  ".join(f"{c:<{w}}" for c, w in zip(x, wide)).rstrip() for x in body)

    letters = "abcdefghijklmnopqrstuvwxyz"
    signs = "!#$%&()*+-./:;<=>?@[]^_{|}~§\\"
    wrapped = lambda s, n: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    sized = lambda a, b: r.randint(a, b)

    def broken(text: str) -> str:
        return "".join(r.choice("âÃÂ¤¼¶€�") if r.random() < 0.35 else c for c in text)

    def dump(n: int) -> str:
        return "\n".join(f"{16 * k:08x}  " + " ".join(f"{r.randrange(256):02x}" for _ in range(16)) for k in range(n))

    english = [
        "The rear camera was covered for about nine frames because of the rain, so the reviewer kept the sheet and moved on to the next one.",
        "Near the end of the run the second pole is hard to see. We drove it again, and that was enough. The label agrees with the tape.",
        "After the restart the box looks clear next to the wall; it is cut by the bumper in the last tile, which is why the score is low.\nBefore the stop, the chain drifts to the left at roughly 12 km/h and nobody checked the sheet.",
    ]
    german = [
        "Nach dem Neustart steht der Pfosten hinter einem geparkten Wagen, aber die Draufsicht hilft. Beim Einparken fehlt die Wand wegen der Nässe.",
        "Kurz vor dem Halt wandert der Umriss bei etwa 300 mm am linken Rand, und das Protokoll bestätigt es. Wir behalten das Blatt also.",
    ]
    french = [
        "Après le redémarrage, le mur reste visible près du caniveau, mais personne n'a vérifié. Pendant ce passage le poteau disparaît à cause de la pluie.",
        "Au fond du parking la haie se confond avec l'ombre sous la lampe, donc on recommence et la note est basse.",
    ]
    spanish = [
        "Después del reinicio el poste sigue visible detrás de un coche, y la etiqueta lo confirma. En esta toma la pared queda cortada por la lluvia.",
        "Al dar marcha atrás la sombra del seto se mueve a la izquierda durante 12 cuadros, por eso la nota es baja.",
    ]
    japanese = [
        "再起動のあと、柱は壁の近くではっきり見える。雨のために縁石が隠れているので、もう一度走った。",
        "停止の前に後方カメラの映像が少し暗くなり、ラベルはテープと合っている。誰もシートを確認しなかった。",
    ]
    notes = [
        "at first the left wall shows up late under the lamp and that was enough for a two with the lamp behind us the box is hidden until we stop so i kept it",
        "beim einparken fehlt der bordstein trotz gegenlicht und die wand steht unter der lampe deshalb fahren wir es nochmals",
    ]
    short = ["Keep it!", "Not usable.", "Good sheet.", "We'll redo it.", "Passt so.", "Prüfen!", "Trop sombre.", "No sirve.", "Fine.", "Same as before.", "確認済み。"]
    titles = ["Review note", "# Findings", "== Notes ==", "Open points", "Re: sheet 12", "Notiz", "Sheet 4"]
    sentences = [x.strip() + "." for t in (*english, *german, *french, *spanish) for x in t.replace("\n", " ").split(". ")]
    spoken = {0: english, 1: german, 2: french, 3: spanish}
    long = [" ".join(r.choice(spoken[k % 4]) for _ in range(sized(6, 20))) for k in range(12)]
    single = [x.replace("..", ".") for x in sentences]
    folded = ["\n".join(wrapped_words(x, r.randint(40, 72))) for x in single if len(x) > 60]
    kana = ["".join(r.choices(japanese, k=n)) for n in (1, 2, 3, 4, 6)] + ["\n".join(r.choices(japanese, k=n)) for n in (2, 3, 4)]
    wraps = ["\n".join(wrapped_words(t, 46)) for t in (*english, *german, *french, *spanish)]
    return [
        ("prose", english),
        ("prose", german),
        ("prose", french),
        ("prose", spanish),
        ("prose", [*japanese, *kana]),
        ("prose", long),
        ("prose", single),
        ("prose", folded),
        ("prose", notes),
        ("prose", short),
        ("prose", titles),
        ("prose", wraps),
        ("list", many(lambda n, pool: "\n".join(f"- {x}" for x in entries(n, pool)))),
        ("list", many(lambda n, pool: "\n".join(f"{'  ' * r.randint(0, 2)}* {x}" for x in entries(n, pool)))),
        ("list", many(lambda n, pool: "\n".join(f"{i + 1}. {x}" for i, x in enumerate(entries(n, pool))))),
        ("list", many(lambda n, pool: "\n".join(f"{letters[i % 26]}) {x};" for i, x in enumerate(entries(n, pool))))),
        ("list", many(lambda n, pool: "\n".join(f"[{r.choice(' x')}] {x}" for x in entries(n, pool)))),
        ("list", many(lambda n, pool: "\n".join(entries(n, pool)))),
        ("list", many(lambda n, pool: ", ".join(entries(n, pool)))),
        ("list", many(lambda n, pool: "Tags: " + ", ".join(entries(n, pool)))),
        ("list", many(lambda n, pool: "\n".join(f"- {x.capitalize()}, {thing(pool)}." for x in entries(n, pool)))),
        ("list", ["\n".join(r.choices(_MONO, k=n)) for n in (6, 9, 14)] + ["\n".join(f"・{x}" for x in r.choices(_MONO, k=n)) for n in (6, 9, 14)]),
        ("list", ["、".join(r.choices(_MONO, k=n)) for n in (6, 9, 14)]),
        ("table", tables(lambda b: "\n".join(",".join(x) for x in b))),
        ("table", tables(lambda b: "\n".join(";".join(x) for x in b))),
        ("table", tables(lambda b: "\n".join("\t".join(x) for x in b))),
        ("table", tables(piped)),
        ("table", tables(grid)),
        ("table", tables(aligned)),
        ("junk", [wrapped(base64.b64encode(r.randbytes(sized(90, 500))).decode(), 64) for _ in range(8)]),
        ("junk", [dump(sized(5, 30)) for _ in range(8)]),
        ("junk", ["".join(r.choice(signs) if r.random() < 0.93 else " " for _ in range(sized(100, 700))) for _ in range(8)]),
        ("junk", [broken(t) for t in (*german, *english, *french, *german)]),
        ("junk", ["".join(r.choice("\x01\x7f�□▒ ") for _ in range(sized(50, 400))) for _ in range(8)]),
        ("junk", [" ".join("".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(sized(20, 90))) for _ in range(8)]),
        ("junk", [" ".join([w] * sized(30, 140)) for w in ("sheet", "tile", "null", "camera")]),
        ("junk", [", ".join([w] * sized(30, 140)) for w in ("test", "frame", "ok", "null", "tile tile")]),
        ("junk", [" ".join([w] * sized(12, 40)) for w in ("The label is fine.", "Keep it, keep it.", "Das Blatt ist gut.", "no data here")]),
        ("junk", ["\n".join([w] * sized(30, 140)) for w in ("null", "tile tile", "sheet sheet", "NaN")]),
        ("junk", ["\n".join(r.choice(("=" * 40, "-" * 60, "~" * 8, "....", "_" * 12, "*" * 30)) for _ in range(sized(5, 12))) for _ in range(6)]),
        ("junk", [" ".join(r.choice(("&nbsp;", "&#160;", "%20", "%s", "<img>", "{{frame}}", "${ratio}", "[[tile]]", "\\x00")) for _ in range(sized(20, 90))) for _ in range(8)]),
        ("junk", ["\n".join("".join(r.choice("0123456789.,- ") for _ in range(r.randint(3, 22))) for _ in range(sized(10, 40))) for _ in range(6)]),
    ]


def wrapped_words(text: str, width: int) -> list[str]:
    """``text`` in lines of at most ``width`` characters."""
    out = [""]
    for word in text.split():
        if len(out[-1]) + len(word) > width:
            out.append("")
        out[-1] = f"{out[-1]} {word}".strip()
    return out
