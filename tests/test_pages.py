"""Labels, indices and sizes against plain restatements of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.functions import geometry as G
from folio.functions import labels as L
from folio.functions import text as X
from folio.operators import images as I
from folio.operators import metrics as M
from folio.operators import scandata as S
from folio.operators.sequence import with_context

ROMAN = re.compile("(?i)^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")


def kind(s):
    if s is None:
        return 0
    if re.fullmatch("[0-9]+", s):
        return 1
    for pattern, roman, alpha in (("[a-z]+", 2, 5), ("[A-Z]+", 3, 4)):
        if re.fullmatch(pattern, s):
            return roman if ROMAN.match(s) else alpha
    return 0


def value(s, k):
    if k == 1:
        return int(s)
    if k in (2, 3):
        v = [dict(I=1, V=5, X=10, L=50, C=100, D=500, M=1000)[c] for c in s.upper()]
        return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))
    return ord(s[0].upper()) - 64 + 26 * (len(s) - 1) if k else None


def ranges(series):
    out, ok, last = [], True, None
    for i, s in enumerate(series):
        k = kind(s)
        ok &= s is None or k != 0
        after = next((x for x in series[i + 1 :] if x is not None), None)
        n = kind(after)
        if (k, n) in ((3, 4), (2, 5)):
            k = n
        if k in (4, 5) and not (after is None or (len(s) == 1 == len(after) and ord(after) == ord(s) + 1) or n == k):
            ok &= (k, n) not in ((4, 2), (5, 3))
            k = 0
        v = value(s, k)
        if last is None or k != last[0] or (k and v != last[1] + 1):
            out.append([i, k, 0, v])
        out[-1][2] += 1
        last = (k, v)
    return [tuple(x) for x in out], ok


def test_label_ranges(spark):
    rng = random.Random(5)
    pool = [None, "", "i", "ii", "iii", "iv", "I", "II", "V", "A", "B", "C", "a", "b", "j", "k", "AA", "1", "2", "3", "12", "A-2", "Iv", "x", "XL"]
    cases = [["i", "j", "k"], [None, "i", "ii", None, None, "1", "2"], ["B", "ii"], ["VII", None, "VII A."], ["AA", "AB", "ZZ"]] + [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    rows = [(d, i, s) for d, c in enumerate(cases) for i, s in enumerate(c)]
    got = {}
    for r in S.label_ranges(spark.createDataFrame(rows, "doc long, idx int, label string")).collect():
        assert len(r["values"]) == r["n"] == len(r["numbers"])
        got.setdefault(r["doc"], [[], r["all_ok"]])[0].append((r["start"], r["kind"], r["n"], r["numbers"][0]))
    for d, c in enumerate(cases):
        want, ok = ranges(c)
        assert (sorted(got[d][0]), got[d][1]) == (want, ok), c


def test_context_over_blocks(spark):
    rng = random.Random(6)
    rows = [(d, i, rng.randint(0, 9), rng.choice([None, "a", "b"])) for d in range(4) for i in range(rng.randint(1, 60)) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "doc long, idx int, v int, s string")
    got = {(r.doc, r.idx): r for r in with_context(df, ["doc"], "idx", before={"sum": F.col("v")}, previous={"was": F.col("v")}, following={"next": F.col("s")}, size=4).collect()}
    for d in range(4):
        own = sorted(r for r in rows if r[0] == d)
        for k, (_, i, _, _) in enumerate(own):
            r = got[d, i]
            assert r["sum"] == sum(x[2] for x in own[:k]) and r["was"] == (own[k - 1][2] if k else None)
            assert r["next"] == next((x[3] for x in own[k + 1 :] if x[3] is not None), None)


def test_strict_labels_fail(spark):
    df = spark.createDataFrame([(0, 0, "B"), (0, 1, "ii")], "doc long, idx int, label string")
    with pytest.raises(Exception, match="cannot be told"):
        S.classified(df, strict=True).collect()


def test_label_dictionary(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(["i", "ii", None, "4", "5"])], "doc long, idx int, label string")
    assert S.label_dictionary(S.label_bounds(df)).first()["nums"] == "0 << /S /r /St 1 >> 2 << >> 3 << /S /D /St 4 >>"


def test_hq_pages(spark):
    df = spark.createDataFrame([(1, 3)], "doc long, pages int")
    assert sorted(r.page_idx for r in S.hq_pages(df, "1,2,3,4,-4,-3,-2,-1").collect()) == [0, 1, 2]
    assert [r.page_idx for r in S.hq_pages(df, "0").collect()] == [0]


def test_geometry(spark):
    one = spark.range(1)
    got = one.select(G.guess_dpi(F.lit(2480), F.lit(3508)).alias("a"), G.guess_dpi(F.lit(0), F.lit(0)).alias("b"), G.whole_number(F.lit(" 300 ")).alias("c"), G.whole_number(F.lit("400dpi")).alias("d"), G.prec(F.lit(0.0125)).alias("e"), G.prec(F.lit(-0.0001)).alias("f")).first()
    assert (got.a, got.b, got.c, got.d, got.e) == (300, 72, 300, None, 0.012) and str(got.f) == "0.0"


def test_encodings(spark):
    r = spark.range(1).select(X.utf16_hex(F.lit("\U0001f600")).alias("a"), X.xml_escape(F.lit("a<&>")).alias("b"), X.flag_map(F.lit("a:1;b:x:y")).alias("c"), X.fixed8(F.lit(1.5)).alias("d")).first()
    assert r.a == "D83DDE00" and r.b == "a&lt;&amp;&gt;" and r.c == {"a": "1", "b": "x:y"} and r.d == "1.50000000"
    assert spark.range(1).select(L.roman_value(F.lit("MCMXCIX"))).first()[0] == 1999


def test_scale_takes_the_last(spark):
    df = spark.createDataFrame([(1, 0, 0, 100, 100, 10.0, 10.0), (1, 0, 1, 100, 100, 50.0, 200.0), (1, 1, 0, 10, 10, 0.0, 20.0)], "doc long, page int, ord int, width int, height int, bbox_w double, bbox_h double")
    assert {r.page: r.scale for r in I.page_scale(df).collect()} == {0: 10.0, 1: 1.0}


def test_timing_summary_without_loads(spark):
    df = spark.createDataFrame([("blur_1", 1.0), ("blur_1", 2.0)], "step_key string, seconds double")
    assert M.timing_summary(df).first()["ms"] is None


def test_draw_commands_are_emptied(spark):
    r = spark.range(1).select(I.without_draw_commands(F.lit("q\n/Im0 Do\nQ"), F.array(F.lit("Im0")))).first()
    assert r[0] == "q\n\nQ"
