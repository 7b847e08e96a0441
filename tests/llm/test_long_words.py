"""Long words meet those that they may be misread from as short ones do."""

import random

from folio.llm import pages


def test_candidates_of_any_length(spark):
    rng = random.Random(95)
    pairs = set()
    for n in [*range(26, 60), 300]:
        for _ in range(6):
            true = "".join(rng.choice("abdeghkmoprstuz") for _ in range(n))
            i = rng.choice((0, n - 1, rng.randrange(n)))
            misread = rng.choice((true[:i] + "w" + true[i + 1 :], true[:i] + true[i + 1 :], true[:i] + "w" + true[i:], true.replace("m", "rn", 1), true[: i - 4] + "w" + true[i - 3 : i] + "x" + true[i + 1 :] if i > 4 else true[1:]))
            if misread != true and pages.misread_cost(misread, true) is not None:
                pairs.add((misread, true))
    assert len({len(t) for _, t in pairs}) > 30
    counts = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate([(m, 1) for m, _ in pairs] + [(t, 9) for _, t in pairs])], "key long, word string, n long")
    got = {(r.word, r.to_word) for r in pages.repair_candidates(counts).collect()}
    assert pairs <= got, sorted(pairs - got)
    words = spark.createDataFrame([("x" * 50,), ("x" * 50,)], "text string")
    assert [(r.word, r.n) for r in pages.word_counts(words).collect()] == [("x" * 50, 2)]
