"""Sentence ends of texts without marks, by bigrams with the boundary token; none depends on the length of the text."""

import random

from folio.llm import sentences

NOUNS = "boat road barn mill farm wall gate tree".split()
VERBS = "saw found sold left".split()


def sentence(rng):
    return f"the {rng.choice(('old', 'grey'))} {rng.choice(('man', 'judge', 'clerk'))} {rng.choice(VERBS)} a {rng.choice(('red', 'wide'))} {rng.choice(NOUNS)} by the {rng.choice(('river', 'harbour'))}"


def test_latin_without_marks(spark):
    rng = random.Random(71)
    train = [(k, "\n\n".join(" ".join(sentence(rng).capitalize() + "." for _ in range(6)) for _ in range(3))) for k in range(60)]
    docs = [(1000 + n, [sentence(rng).capitalize() for _ in range(n)]) for n in (4, 9, 30)]
    df = spark.createDataFrame(train, "doc_id long, text string")
    model = sentences.sentence_model(df)
    for lead in ("", "Oh! "):  # one mark switches nothing off in a long stretch
        asked = spark.createDataFrame([(k, lead + " ".join(s)) for k, s in docs if not lead or len(s) > 4], "doc_id long, text string")
        got = {}
        for r in sentences.sentence_units(asked, model).collect():
            got.setdefault(r.doc_id, set()).add(r.end_pos)
        for k, s in docs:
            if k in got:
                want, at = set(), len(lead)
                for x in s:
                    want.add(at + len(x))
                    at += len(x) + 1
                own = {e for e in got[k] if e > len(lead)}
                assert len(own & want) >= 0.8 * len(want) and len(own - want) <= 0.2 * len(want), (k, sorted(own ^ want))


def test_greek_question_mark(spark):
    df = spark.createDataFrame([(1, "Ποιος ήρθε χθες; Κανείς δεν ξέρει. Τι; Όχι."), (2, "red; Green and so on.")], "doc_id long, text string")
    ends = {(r.doc_id, r.end_pos) for r in sentences.sentence_units(df, sentences.sentence_model(df)).collect()}
    assert (1, 16) in ends and (2, 4) not in ends
