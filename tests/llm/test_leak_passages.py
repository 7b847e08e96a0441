"""Every passage of an item in a text is found and cut out, not the longest alone."""

import random

from folio.llm import leaks


def test_all_passages_are_cut_out(spark):
    rng = random.Random(41)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}{rng.choice('aeiou')}n" for k in range(400)]
    filler = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = [f"q{chr(97 + k // 26)}{chr(97 + k % 26)}{rng.choice('aeiou')}n" for k in range(60)]
    a, b, c, d = (filler(60) for _ in range(4))
    texts = {1: f"{a} {' '.join(item)} {b} {' '.join(item)} {c}", 2: f"{a} {' '.join(item[:25])} {b} {' '.join(item[30:])} {c}", 3: f"{a} {' '.join(item)} {b} {' '.join(item[:10])} {c}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = leaks.leaked(docs, items)
    spans = {k: sorted((r.start, r.end) for r in found.collect() if r.doc_id == k) for k in texts}
    assert {k: len(v) for k, v in spans.items()} == {1: 2, 2: 2, 3: 1}
    assert texts[2][spans[2][1][0] : spans[2][1][1]].split() == item[30:]
    clean = {r.doc_id: r.text for r in leaks.without_leaks(docs, found).collect()}
    assert not set(item) & set(clean[1].split()) and not set(item) & set(clean[2].split()) and clean[1].split() == f"{a} {b} {c}".split()
    assert item[0] in clean[3].split()  # ten words are no passage


def _words(rng, mark, n):
    return [f"{mark}{chr(97 + k // 26)}{chr(97 + k % 26)}{rng.choice('aeiou')}n" for k in range(n)]


def test_items_that_share_a_passage(spark):
    """A passage of forty items is found for each of them, in one block of items as in several."""
    rng = random.Random(43)
    shared = " ".join(_words(rng, "s", 30))
    items = spark.createDataFrame([(k, f"start{k} {shared} middle{k} end{k}") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"some words before {shared} and after"), (2, "nothing of the kind")], "doc_id long, text string")
    for chars in (leaks.BLOCK_CHARS, 2_000):
        found = leaks.leaked(docs, items, block_chars=chars).collect()
        assert sorted(r.item_id for r in found) == list(range(40)) and {r.doc_id for r in found} == {1}
        assert {r.words for r in found} == {30.0}


def test_misread_words(spark):
    """Of passages of 30 and 60 words with one word in four misread nine in ten are found."""
    rng = random.Random(44)
    items = {k: [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + x for x in rng.sample(_words(rng, "m", 600), 60)] for k in range(40)}
    rows, want = [], set()
    for n in (30, 60):
        for k, own in items.items():
            at = rng.randrange(61 - n)
            noisy = [w if (j + 1) % 4 else (lambda i: w[:i] + "q" + w[i + 1 :])(rng.randrange(len(w))) for j, w in enumerate(own[at : at + n])]
            rows.append((len(rows), "so it was written here " + " ".join(noisy) + " and nothing followed it"))
            want.add((rows[-1][0], k))
    found = leaks.leaked(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_short_items_and_lines_in_between(spark):
    rng = random.Random(45)
    own = _words(rng, "k", 40)
    notice = "\n".join("this line stands in between and has nothing to do with it" for _ in range(9))
    docs = spark.createDataFrame([(1, "so the green dragon sleeps and on"), (2, " ".join(own[:18]) + "\n" + notice + "\n" + " ".join(own[18:]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "green dragon sleeps"), (2, "Dragon"), (3, "the green dragon sleeps and"), (4, "dragon sleeps"), (5, "dragon wakes"), (6, " ".join(own)), (7, ""), (8, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in leaks.leaked(docs, items).collect()}
    assert set(found) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 6)}
    assert found[2, 6].words == 40.0
