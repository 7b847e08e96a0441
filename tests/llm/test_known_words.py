"""Words known beyond those that are broadcast count as known all the same."""

import random

from folio.llm import pages

WORDS = "the old baker sold a red boat near town while her clerk found some maps under an empty roof before winter and nobody knew why it was so late".split()


def test_more_known_words_than_are_sent(spark):
    rng = random.Random(91)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    lines = [(d, p, n, text(9)) for d in range(1, 9) for p in range(3) for n in range(8)]
    # well-made: three times with its hyphen; goodnight: three times as one word; bakar: known, though near to baker
    lines += [(20 + k, 0, n, x) for k in range(4) for n, x in enumerate(("a well-made boat near town", "the goodnight bell was late", "the old bakar sold some 1l maps", text(9)))]
    lines += [(30, 0, 0, "nobody knew why the well-"), (30, 0, 1, "made boat was so late and they said good-"), (30, 0, 2, "night near the old bakcr sold a red"), (30, 0, 3, text(9))]
    lines += [(31, 31, 7, "nobody knew why the well-"), (31, 32, 0, "made boat was so late")]  # over the end of a run
    df = spark.createDataFrame([(d, p, 1, n, k, w) for d, p, n, x in lines for k, w in enumerate(x.split())], "doc long, page_idx int, par int, line int, word int, text string")
    items = spark.createDataFrame([(0, "Some title")], "doc long, title string")
    got = lambda m: [sorted(map(tuple, x.collect())) for x in pages.page_noise(df, items, **m)]
    whole = got({})
    assert (30, 0, 1, "hyphen") in whole[0] and (30, 0, 2, "misread") in whole[0] and not {(30, 0, 0, "hyphen"), (31, 31, 7, "hyphen")} & set(whole[0])
    for most in (0, 3, 20):
        assert got({"most_broadcast": most}) == whole, most
