"""Which labels name a language does not hang on how much text the samples of the labels hold."""

import random

import pytest

from folio.llm import languages

SYLLABLES = {"en": "the and ing wor lea ster ough br ick mond fel ton hal ver sh ale".split(), "de": "sch ung ein ver gen lich keit bau mer stra zeit wald hof kei dor zw".split()}
ROWS = [("en", "eng", "English", "Latn"), ("de", "deu", "German", "Latn"), ("da", "dan", "Danish", "Latn")]


def vocabulary(lang, size=900):
    rng = random.Random(lang)
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.choice((2, 2, 3)))) for _ in range(size)]


def prose(rng, lang, sentences):
    words = vocabulary(lang)
    return " ".join(" ".join(rng.choice(words) for _ in range(8)).capitalize() + "." for _ in range(sentences))


def found(spark, rows):
    docs = spark.createDataFrame([(k, t, x, "s") for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    langs = spark.createDataFrame(ROWS, "lang string, iso3 string, lang_name string, script string")
    return {(r.doc_id, r.lang) for r in languages.unnamed_languages(languages.language_segments(docs, langs)).collect()}


@pytest.mark.parametrize("seed", (1, 2))
def test_wrong_label_of_longer_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(prose(rng, "en", 4), "en") for _ in range(60)] + [(prose(rng, "de", 10), "de") for _ in range(30)]
    rows += [(prose(rng, "en", 4), "de") for _ in range(10)] + [(prose(rng, "en", 40), "da") for _ in range(25)]
    assert found(spark, rows) == {(90 + k, "en") for k in range(35)}


def test_label_that_mostly_stands_at_another_language(spark):
    rng = random.Random(3)
    rows = [(prose(rng, "en", 10), "en") for _ in range(80)] + [(prose(rng, "de", 10), "de") for _ in range(12)]
    rows += [(prose(rng, "en", 10), "de") for _ in range(48)] + [(prose(rng, "de", 10), "en") for _ in range(2)]
    assert found(spark, rows) == {(92 + k, "en") for k in range(48)} | {(140 + k, "de") for k in range(2)}
