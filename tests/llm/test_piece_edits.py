"""An edit changes only the pieces near it, in many texts and scripts."""

import random

from folio.llm import pieces

SCRIPTS = {"latin": "abcdefghiklmnoprstuvw", "cyrillic": "абвгдежзиклмнопрстуя", "greek": "αβγδεζηθικλμνοπρστυω", "arabic": "ابتثجحخدذرزسشصضطعغفق", "devanagari": "कखगघचछजझटठडढतथदधनपबम", "han": "水山火木金土日月人大小中上下口目手足心風"}


def text_of(rng, script, words):
    out = []
    for k in range(words):
        w = "".join(rng.choice(SCRIPTS[script]) for _ in range(rng.randint(2, 8)))
        end = "。" if script == "han" else ". "
        out.append(w + (end if k % 11 == 10 else "" if script == "han" else " ") + ("\n\n" if k % 97 == 96 else ""))
    return "".join(out)


def test_edits_stay_local_in_many_texts():
    rng = random.Random(21)
    far, changed, total, texts = 0, 0, 0, 0
    for script in SCRIPTS:
        for _ in range(12):
            text = text_of(rng, script, 1500)
            at = len(text) // 3
            other = text[:at] + text_of(rng, script, 25) + text[at:]
            a = [text[s:e] for s, e, _, _ in pieces.cuts(text, 200, 20)]
            b = {other[s:e] for s, e, _, _ in pieces.cuts(other, 200, 20)}
            gone = sum(x not in b for x in a)
            changed, total, texts, far = changed + gone, total + len(a), texts + 1, far + (gone > 8)
    assert total > 20 * texts and changed <= 3 * texts and far <= 1, (changed, total, texts, far)


def test_ranks_do_not_depend_on_the_rest_of_the_text():
    from folio.llm.codes import Codes

    rng = random.Random(22)
    text = text_of(rng, "latin", 300)
    other = text_of(rng, "han", 90) + text
    a, b = (pieces.ranks(Codes([t]), len(t)) for t in (text, other))
    assert (a[pieces.WINDOW :] == b[len(other) - len(text) + pieces.WINDOW :]).all()
