"""A language bears the name that most of its texts have, however pure the texts of a rarer wrong label are."""

import random

from folio.llm import languages

ENGLISH = "the old baker sold a red boat near town while her clerk found some maps under an empty roof before winter and nobody knew why it was so late".split()
GERMAN = "der alte müller fand die graue karte im dorf während seine frau das brot ohne hilfe nach hause trug und niemand wusste warum es so spät war".split()


def prose(rng, words):
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 12))).capitalize() + "." for _ in range(10))


def test_rare_wrong_label(spark):
    rng = random.Random(81)
    rows = [(k, prose(rng, ENGLISH), "en") for k in range(60)] + [(100 + k, prose(rng, GERMAN), "de") for k in range(30)]
    rows += [(200 + k, prose(rng, GERMAN), "en") for k in range(15)] + [(300 + k, prose(rng, ENGLISH), "da") for k in range(12)]
    docs = spark.createDataFrame([(k, t, x, "s") for k, t, x in rows], "doc_id long, text string, lang string, source string")
    langs = spark.createDataFrame([("en", "eng", "English", "Latn"), ("de", "deu", "German", "Latn"), ("da", "dan", "Danish", "Latn")], "lang string, iso3 string, lang_name string, script string")
    names = {"en": "en", "de": "de", "da": "da"}
    assert languages.labelled_sample(docs.unionByName(docs), names, 5)[1] == {"en": 75, "de": 30, "da": 12}
    found = languages.unnamed_languages(languages.language_segments(docs, langs))
    assert {(r.doc_id, r.lang) for r in found.collect()} == {(200 + k, "de") for k in range(15)} | {(300 + k, "en") for k in range(12)}
