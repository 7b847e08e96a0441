"""Problem 2: noise in text from scanned pages.

1. Words are counted over the corpus.  A symmetric-delete index (every word with one character left out, joined
   with the same of the frequent words; for long words an equal half) brings each rare word together with the frequent ones near it; a
   weighted edit distance with the usual confusions of character shapes keeps the likely pairs.
2. Pages are read in runs of PAGES consecutive ones (with the first lines of the pages after them), so a
   run is bounded however large the item: page numbers and headings are told by place, form and repetition,
   broken words are joined over lines and pages, and words that are not well known are set aside with their
   neighbours.
3. Those words meet their candidates; counts of neighbouring words over the corpus pick among them and reject
   what does not fit in.

Defined results: rows with NULL doc, page_idx, line or word are left out; NULL texts are empty words; repeated rows
count once (the first by text where they differ); other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.sequence import with_context

from . import codes
from .codes import Codes, among, counts_before, range_hash
from .lines import edits
from .util import frequent_and_rest, spread

PAGES = 32
EDGE = 3
EDGE_LINES = 3
#: Most known words that are sent to every worker; the rest meet the words by joins.
KNOWN_WORDS = 500_000
#: Place in a run, before all pages, of the broken words that keep their hyphen.
APART = -(1 << 31)
#: For words that differ by more than a usual confusion: times as often that the right one must stand, and the share of the
#: other's places that it must fit.  Both are ratios, to hold for any size of corpus.
FAR_RATIO, FAR_SHARE = 5, 0.34
#: Shapes that are read for each other, one way or the other.
CONFUSIONS = """
rn:m cl:d vv:w ii:u li:h nn:m in:m ri:n fi:h lc:k
c:e e:c a:o o:a u:n n:u h:b b:h f:t t:f l:1 i:1 1:l 1:i 0:o o:0 5:s s:5 8:b b:8 6:b b:6 9:g g:9 g:q q:g q:o o:q
i:l l:i i:; e:o o:e l:t ſ:f ſ:s f:s s:f r:v v:r y:v v:y l:| i:| a:& o:c c:o a:u u:a 3:e e:3 7:t 2:z z:2 m:rn m:in m:ni h:li u:ll d:cl w:vv u:ii
и:н н:и о:с с:о е:с с:е п:н н:п л:п ш:щ щ:ш л:а д:л я:р
""".split()
#: Words of so many letters meet by their halves, of which there are few, shorter ones by what is left without a letter or two.
LONG = 40
HYPHENS = "-‐¬=­‑"
_STRIP = " .,;:!?\"'()[]{}«»“”‘’„‚—–-…¿¡،؟؛。‐­¬="
_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_PAIRS = {tuple(x.split(":")) for x in CONFUSIONS}


class Tokens:
    """Words of a column in lower case without outer marks, as ranges of one array of code points."""

    def __init__(self, texts: list):
        c = self.codes = Codes(texts)
        solid = np.flatnonzero(~c.within(_STRIP) & (c.cp != 10))
        a, b = np.searchsorted(solid, c.start), np.searchsorted(solid, c.end) - 1
        has = b >= a
        top = max(len(solid) - 1, 0)
        if len(solid):
            self.start = np.where(has, solid[np.minimum(a, top)], c.start)
            self.end = np.where(has, solid[np.maximum(b, 0)] + 1, c.start)
        else:
            self.start = self.end = c.start
        self.hash = range_hash(c.low, self.start, self.end)

    def word(self, k: int) -> str:
        return "".join(map(chr, self.codes.low[self.start[k] : self.end[k]].tolist()))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a * _K1 ^ (b * _K2)
        return h ^ (h >> np.uint64(31))


def misread_cost(t: str, f: str) -> float | None:
    """Cost of reading f as t, or None where they are not near."""
    n = min(len(t), len(f))
    a = 0
    while a < n and t[a] == f[a]:
        a += 1
    b = 0
    while b < n - a and t[-1 - b] == f[-1 - b]:
        b += 1
    x, y = t[a : len(t) - b], f[a : len(f) - b]
    if (x, y) in _PAIRS:
        return 0.5
    if len(x) == 1 and len(y) == 1:
        return 0.5 if not x.isalpha() and y.isalpha() else 1.2
    if len(x) == 1 and not y:
        return 0.5 if not x.isalnum() or a and t[a - 1] == x else 1.2
    if not x and len(y) == 1:
        return 0.8
    if len(x) == 2 and x == y[::-1]:
        return 1.0
    if len(f) >= 7 and len(x) <= 5 and edits(x, y, 2) <= 2:
        return 1.6
    return None


def word_counts(words: DataFrame) -> DataFrame:
    """(key, word, n): how often each word stands, words broken at a line's end aside."""
    raw = words.where("text is not null and text != ''").groupBy("text").agg(F.count("*").alias("n"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            t = Tokens(texts)
            letters = counts_before(t.codes.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS))
            keep = np.flatnonzero((letters[t.end] > letters[t.start]) & ~np.isin(np.array([x[-1:] for x in texts]), list(HYPHENS)))
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(t.hash[keep].view(np.int64)), pa.array([t.word(k) for k in keep.tolist()]), pa.array(n[keep])], ["key", "word", "n"])

    return raw.mapInArrow(run, "key long, word string, n long").groupBy("key").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def repair_candidates(counts: DataFrame) -> DataFrame:
    """(key, word, n, to_key, to_word, to_n, cost): frequent words that rarer ones may be misread from."""

    def deletes(side: str):
        def run(batches):
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                out, which = [], []
                for k, w in enumerate(words):
                    if len(w) < 2:
                        continue
                    forms = {w}
                    if len(w) >= LONG - 2:
                        # words that are near differ in five characters in a row and by two in length: one half is the same
                        for size in (len(w),) if side == "rare" else range(len(w) - 2, len(w) + 3):
                            half = (size - 7) // 2
                            forms |= {f"{size}<{w[:half]}", f"{size}>{w[-half:]}"}
                    if len(w) < LONG:
                        forms |= {w[:i] + w[i + 1 :] for i in range(len(w))}
                        if side == "rare":
                            for x, y in _PAIRS:
                                if len(x) + len(y) > 2 and x in w:
                                    i = w.find(x)
                                    while i >= 0:
                                        forms.add(w[:i] + y + w[i + len(x) :])
                                        i = w.find(x, i + 1)
                        if len(w) >= 9:
                            v = [w[:i] + w[i + 1 :] for i in range(len(w))]
                            forms |= {x[:j] + x[j + 1 :] for i, x in enumerate(v) for j in range(i, min(i + 4, len(x)))}
                    out += forms
                    which += [k] * len(forms)
                if out:
                    h = codes.hash_words(out)
                    which = np.array(which)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("word").take(pa.array(which)), pa.array(n[which])], ["form", "word", "n"])

        return run

    schema = "form long, word string, n long"
    # roman figures are words of their own
    rare = counts.where(~F.col("word").rlike("^[ivxlc]{2,}$")).select("word", "n").mapInArrow(deletes("rare"), schema)
    often = counts.where("n >= 4").select("word", "n").mapInArrow(deletes("often"), schema).select("form", F.col("word").alias("to_word"), F.col("n").alias("to_n"))
    pairs = rare.join(often, "form").where((F.col("to_n") >= 3 * F.col("n") + 2) & (F.col("word") != F.col("to_word"))).select("word", "n", "to_word", "to_n").distinct()

    def weigh(batches):
        for batch in batches:
            words, to = batch.column("word").to_pylist(), batch.column("to_word").to_pylist()
            cost = [misread_cost(a, b) for a, b in zip(words, to)]
            keep = pa.array([c is not None for c in cost])
            own = batch.filter(keep)
            w, v = own.column("word").to_pylist(), own.column("to_word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(codes.hash_words(w).view(np.int64)), own.column("word"), own.column("n"), pa.array(codes.hash_words(v).view(np.int64)), own.column("to_word"), own.column("to_n"), pa.array([c for c in cost if c is not None], pa.float64())], ["key", "word", "n", "to_key", "to_word", "to_n", "cost"])

    return pairs.mapInArrow(weigh, "key long, word string, n long, to_key long, to_word string, to_n long, cost double")


_NUMBER = re.compile(r"(?i)^[\s\W_]*(?:page|p|pag|seite|s|pág|стр|blz)?[\s\W_]*([\divxlcdmo]{1,7})[\s\W_]*$")


def page_number(text: str) -> bool:
    """Is the line only a page number, in arabic or roman figures, with or without marks around it?"""
    text = text.strip()
    if len(text) > 16 or text.endswith((".", ",", ";")):
        return False
    m = _NUMBER.match(text)
    if not m:
        return False
    x = m[1].lower()
    if len(x) > 1 and x != text.lower() and set(x) <= set("lio"):  # 10 or 11, in marks
        return True
    return x.isdigit() and len(x) <= 4 or set(x) <= set("ivxlcdm") or len(x) <= 4 and any(ch.isdigit() for ch in x) and set(x) <= set("0123456789lio")


def heading_key(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch.isalpha())


def same_heading(a: str, b: str) -> bool:
    """Are these keys of headings the same but for misread characters and an issue or page number?"""
    if len(a) < 6 or len(b) < 6:
        return a == b and bool(a)
    most = max(2, len(b) // 6)
    if edits(a, b, most) <= most:
        return True
    long, short = (a, b) if len(a) > len(b) else (b, a)
    extra = len(long) - len(short)
    return extra <= 8 and (edits(long[:-extra] if extra else long, short, most) <= most or edits(long[extra:], short, most) <= most)


def _process(rows: dict, known: tuple[np.ndarray, np.ndarray], title_of: dict, own_bucket: np.ndarray, ask: bool = False):
    """Lines, results and unknown words of whole runs of pages (arrays sorted by doc, bucket, page, line, word).

    ask: the broken words of which neither form is in known instead.
    """
    doc, bucket, page, line, texts = rows["doc"], rows["bucket"], rows["page"], rows["line"], rows["text"]
    t = Tokens(texts)
    c = t.codes
    n = len(texts)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1]) | (page[1:] != page[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [n])) - 1
    ld, lb, lp, ll = doc[first], bucket[first], page[first], line[first]
    m = len(first)
    page_new = np.ones(m, bool)
    page_new[1:] = (ld[1:] != ld[:-1]) | (lb[1:] != lb[:-1]) | (lp[1:] != lp[:-1])
    page_first = np.flatnonzero(page_new)
    page_last = np.concatenate((page_first[1:], [m])) - 1
    kind = np.zeros(m, np.int8)  # 0 body, 1 page number, 2 heading
    words_in = last - first + 1

    def text_of(k: int) -> str:
        return " ".join(texts[first[k] : last[k] + 1])

    # page numbers: in the two first or two last lines
    for k in np.flatnonzero(words_in <= 3).tolist():
        p = np.searchsorted(page_first, k, "right") - 1
        if (k - page_first[p] <= 1 or page_last[p] - k <= 1) and page_number(" ".join(texts[first[k] : last[k] + 1])):
            kind[k] = 1
    # headings: the first line of a page, or the second after a page number, that repeats a title
    group = np.cumsum(np.concatenate(([True], (ld[1:] != ld[:-1]) | (lb[1:] != lb[:-1])))) - 1
    tops: list[tuple[int, str, int]] = []
    for p in range(len(page_first)):
        for k in range(page_first[p], min(page_first[p] + 2, page_last[p] + 1)):
            if kind[k] == 1:
                continue
            if words_in[k] <= 14 and k < page_last[p] + 1:
                raw = text_of(k)
                key = heading_key(raw)
                if len(key) >= 6 and (raw.upper() == raw or raw[:1].isupper() or raw[:1].isdigit() or not raw[:1].isalpha()) and not raw.rstrip().endswith((".", ",", ";", "-")):
                    tops.append((k, key, p))
            break
    by_group: dict[int, list] = {}
    for k, key, p in tops:
        by_group.setdefault(int(group[k]), []).append((k, key, p, text_of(k)))
    if tops:
        # single lines in the body that may be chapter headings
        body_heads: dict[int, list] = {}
        for k in np.flatnonzero((words_in >= 3) & (words_in <= 8) & (kind == 0)).tolist():
            ch = texts[first[k]][:1]
            g = int(group[k])
            if g in by_group and ch.isupper() and rows["alone"][first[k]] and not texts[last[k]][-1:] in ".,;-":
                body_heads.setdefault(g, []).append((k, heading_key(text_of(k))))
        for g, own in by_group.items():
            title = heading_key(title_of.get(int(ld[own[0][0]]), "") or "")
            for k, key, p, raw in own:
                if title and same_heading(key, title):
                    kind[k] = 2
                    continue
                near = any(q != p and abs(int(lp[j]) - int(lp[k])) <= 8 and same_heading(key, other) for j, other, q, _ in own)
                if not near:
                    near = any(j != k and abs(int(lp[j]) - int(lp[k])) <= 8 and same_heading(key, other) for j, other in body_heads.get(g, ()))
                if near or raw.upper() == raw != raw.lower() and len(key) >= 10:
                    kind[k] = 2
    body = np.flatnonzero(kind == 0)
    nxt = np.full(m, -1)
    if len(body) > 1:
        ok = (group[body[1:]] == group[body[:-1]]) & (lp[body[1:]] - lp[body[:-1]] <= 1)
        nxt[body[:-1][ok]] = body[1:][ok]
    # broken words
    ends = np.array([x[-1:] for x in (texts[k] for k in last)], object)
    hyphened = np.isin(ends.astype(str), list(HYPHENS)) & (kind == 0)
    hyphen = np.zeros(m, bool)
    joined: dict[int, tuple[str, str]] = {}
    asked = []
    for k in np.flatnonzero(hyphened).tolist():
        j = nxt[k]
        if j < 0:
            continue
        a, b = t.word(last[k]), t.word(first[j])
        head = texts[first[j]][:1]
        if not a or not b or not a[-1].isalpha() or not head.isalpha() or head.isupper():
            continue
        own = codes.hash_words([f"{a}-{b}", a + b])
        with_hyphen, without = (known_count(known, x) for x in own)
        if with_hyphen > without:
            continue
        if not without:  # words that are not sent have smaller counts than those that are
            site = int(ld[k]), int(lb[k]), int(lp[k]), int(ll[k])
            asked.append((*site, *own.view(np.int64).tolist()))
            if site in rows["apart"]:
                continue
        hyphen[k] = True
        joined[k] = (a, b)
    if ask:
        return asked
    mine = own_bucket[first]
    out = []
    for k in np.flatnonzero((kind > 0) & mine).tolist():
        out.append((int(ld[k]), int(lp[k]), int(ll[k]), "pagenum" if kind[k] == 1 else "header"))
    for k in np.flatnonzero(hyphen & mine).tolist():
        out.append((int(ld[k]), int(lp[k]), int(ll[k]), "hyphen"))
    # unknown words of body lines, with their neighbours; a broken word stands for its two parts
    line_of = np.cumsum(new) - 1
    letters = counts_before(c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS))
    digits = counts_before(c.kind == codes.DIGIT)
    has_letter, has_digit = letters[t.end] > letters[t.start], digits[t.end] > digits[t.start]
    h = t.hash.copy()
    skip = np.zeros(n, bool)
    joined_words = {}
    for k, (a, b) in joined.items():
        j = nxt[k]
        i = int(last[k])
        h[i] = codes.hash_words([a + b])[0]
        skip[first[j]] = True
        joined_words[i] = (a, b, int(j))
    body_word = (kind[line_of] == 0) & has_letter & ~skip
    idx = np.flatnonzero(body_word)
    hh = h[idx]
    unknown = known_index(known, hh) < 0
    left, right = np.zeros(len(idx), np.uint64), np.zeros(len(idx), np.uint64)
    if len(idx) > 1:
        same = group[line_of[idx[1:]]] == group[line_of[idx[:-1]]]
        left[1:], right[:-1] = np.where(same, hh[:-1], 0), np.where(same, hh[1:], 0)
    sus = []
    for x in np.flatnonzero(unknown & own_bucket[idx]).tolist():
        i = int(idx[x])
        k = int(line_of[i])
        if i in joined_words:
            a, b, j = joined_words[i]
            sus.append((int(ld[k]), int(lp[k]), int(ll[k]), a + b, len(a), int(lp[j]), int(ll[j]), left[x], right[x], bool(has_digit[i]), i - int(first[k])))
        else:
            sus.append((int(ld[k]), int(lp[k]), int(ll[k]), t.word(i), 0, 0, 0, left[x], right[x], bool(has_digit[i]), i - int(first[k])))
    pair = own_bucket[idx][1:] & (left[1:] != 0) if len(idx) > 1 else np.zeros(0, bool)
    bigrams = pair_hash(hh[:-1][pair], hh[1:][pair]) if len(idx) > 1 else np.zeros(0, np.uint64)
    return out, sus, bigrams


def known_index(known: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    return among(known[0], h)


def known_count(known: tuple[np.ndarray, np.ndarray], h) -> int:
    at = among(known[0], np.array([h], np.uint64))[0]
    return int(known[1][at]) if at >= 0 else 0


READ = "tag string, doc long, page_idx int, line int, kind string, word string, cut int, next_page int, next_line int, lft long, rgt long, key long, n long, digit boolean, at int"


ASKED = "doc long, bucket int, page_idx int, line int, hyphened long, joined long"


def kept_apart(asked: DataFrame, rest: DataFrame) -> DataFrame:
    """(doc, bucket, page_idx, line): of the broken words of which neither form was sent, those that rather stand with a hyphen."""
    hyphened = rest.select(F.col("key").alias("hyphened"), F.col("n").alias("with_hyphen"))
    joined = rest.select(F.col("key").alias("joined"), F.col("n").alias("without"))
    met = asked.join(hyphened, "hyphened").join(joined, "joined", "left")
    return met.where(F.col("with_hyphen") > F.coalesce("without", F.lit(0))).select("doc", "bucket", "page_idx", "line")


def read_pages(words: DataFrame, titles: DataFrame, known, apart: DataFrame | None = None, ask: bool = False) -> DataFrame:
    """Rows of three kinds: r, the noise found in whole lines; s, words not well known; b, counts of neighbouring words.

    apart: the broken words that keep their hyphen as words that are not in known tell.  ask: those to be told so (ASKED).
    """
    base = words.where("doc is not null and page_idx is not null and line is not null and word is not null").select("doc", "page_idx", "line", F.coalesce("par", F.lit(-1)).alias("par"), "word", F.coalesce("text", F.lit("")).alias("text"))

    def packed(batches):
        # words that stand together in a line travel as one row
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("doc", "page_idx", "line", "par")]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            first = np.flatnonzero(new)
            edge = pa.array(np.concatenate((first, [batch.num_rows])), pa.int32())
            lists = (pa.ListArray.from_arrays(edge, batch.column(c)) for c in ("word", "text"))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in keys), *lists], ["doc", "page_idx", "line", "par", "words", "texts"])

    lines = base.mapInArrow(packed, "doc long, page_idx int, line int, par int, words array<int>, texts array<string>")
    bucket = F.expr(f"cast(floor(page_idx / {PAGES}) as int)")
    # the run before also sees the first lines of these pages, and the run after the first lines of the pages before it
    before = F.when((F.pmod("page_idx", F.lit(PAGES)) < EDGE) & (F.col("line") <= EDGE_LINES), bucket - 1)
    after = F.when((F.pmod("page_idx", F.lit(PAGES)) >= PAGES - EDGE) & (F.col("line") <= EDGE_LINES), bucket + 1)
    keyed = lines.withColumn("bucket", F.explode(F.filter(F.array(bucket, before, after), lambda x: x.isNotNull())))
    # the item's title comes as a word before the first page, so the words need not be moved for it
    runs_of = base.select("doc", bucket.alias("bucket")).distinct().join(titles, "doc")
    none = F.lit(-1)
    heads = runs_of.select("doc", (none - 1).cast("int").alias("page_idx"), none.alias("line"), none.alias("par"), F.array(none).alias("words"), F.array(F.coalesce("title", F.lit(""))).alias("texts"), "bucket")
    if apart is not None:
        heads = heads.unionByName(apart.select("doc", F.lit(APART).alias("page_idx"), "line", none.alias("par"), F.array("page_idx").alias("words"), F.array(F.lit("")).alias("texts"), "bucket"))
    ordered = keyed.unionByName(heads).repartition("doc", "bucket").sortWithinPartitions("doc", "bucket", "page_idx", "line")

    def run(batches):
        held: list[pa.Table] = []
        bigrams: list[np.ndarray] = []

        def rows_of(table: pa.Table):
            size = pc.list_value_length(table.column("words")).to_numpy()
            flat = lambda c: table.column(c).combine_chunks().flatten()
            of = np.repeat(np.arange(table.num_rows), size)
            doc, page, line, b, par = (table.column(c).to_numpy()[of] for c in ("doc", "page_idx", "line", "bucket", "par"))
            word, texts = flat("words").to_numpy(), flat("texts")
            line_new = np.ones(len(doc), bool)
            line_new[1:] = (doc[1:] != doc[:-1]) | (b[1:] != b[:-1]) | (page[1:] != page[:-1]) | (line[1:] != line[:-1])
            number = np.cumsum(line_new)
            order = np.lexsort((word, number))
            same = np.zeros(len(order), bool)
            same[1:] = (number[order[1:]] == number[order[:-1]]) & (word[order[1:]] == word[order[:-1]])
            if same.any():  # of repeated rows the first by text counts
                for s, e in zip(*codes.runs(same)):
                    own = sorted(order[s - 1 : e].tolist(), key=lambda k: texts[k].as_py())
                    order[s - 1 : e] = own
            order = order[~same]
            doc, page, line, b, par, word = (x[order] for x in (doc, page, line, b, par, word))
            texts = texts.take(pa.array(order)).to_pylist()
            title = (page == -2) & (word == -1)
            titles_of = {int(doc[k]): texts[k] for k in np.flatnonzero(title).tolist()}
            mark = page == APART
            kept = set(zip(*(x[mark].tolist() for x in (doc, b, word, line))))
            if title.any() or mark.any():
                keep = ~title & ~mark
                doc, page, line, b, par = (x[keep] for x in (doc, page, line, b, par))
                texts = [t for t, k in zip(texts, keep.tolist()) if k]
            change = np.ones(len(doc), bool)
            change[1:] = (doc[1:] != doc[:-1]) | (b[1:] != b[:-1]) | (page[1:] != page[:-1]) | (line[1:] != line[:-1])
            lines = np.flatnonzero(change)
            paragraph = np.ones(len(lines), bool)
            x, y = lines[1:], lines[:-1]
            paragraph[1:] = (doc[x] != doc[y]) | (b[x] != b[y]) | (page[x] != page[y]) | (par[x] != par[y])
            alone_line = paragraph & np.concatenate((paragraph[1:], [True]))
            alone = alone_line[np.cumsum(change) - 1]
            return _process({"doc": doc, "bucket": b, "page": page, "line": line, "text": texts, "alone": alone, "apart": kept}, known.value, titles_of, b == page // PAGES, ask)

        def emit(table: pa.Table):
            if ask:
                cols = list(zip(*rows_of(table))) or [()] * 6
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(cols, types)], [x.split()[0] for x in ASKED.split(", ")])
                return
            out, sus, big = rows_of(table)
            bigrams.append(big)
            if len(bigrams) > 50:
                yield counted()
            rows = [("r", d, p, n, k, None, None, None, None, None, None, None, None, None, None) for d, p, n, k in out]
            rows += [("s", d, p, n, None, w, cut, np_, nl, int(a.view(np.int64)), int(b.view(np.int64)), None, None, dg, at) for d, p, n, w, cut, np_, nl, a, b, dg, at in sus]
            cols = list(zip(*rows)) or [()] * 15
            keys = pa.array(codes.hash_words([w or "" for w in cols[5]]).view(np.int64)) if rows else pa.array([], pa.int64())
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, pa.int64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([keys if k == 11 else pa.array(x, ty) for k, (x, ty) in enumerate(zip(cols, types))], NAMES)

        def counted():
            keys, n = np.unique(np.concatenate(bigrams), return_counts=True)
            bigrams.clear()
            none = lambda ty: pa.nulls(len(keys), ty)
            return pa.RecordBatch.from_arrays([pa.array(["b"] * len(keys), pa.string()), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.string()), none(pa.string()), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int64()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), none(pa.bool_()), none(pa.int32())], NAMES)

        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= 8_000:
                table = pa.concat_tables(held)
                doc, b = table.column("doc").to_numpy(), table.column("bucket").to_numpy()
                edge = np.flatnonzero((doc[1:] != doc[:-1]) | (b[1:] != b[:-1]))
                if len(edge):
                    cut = int(edge[-1]) + 1
                    yield from emit(table.slice(0, cut))
                    held, size = [table.slice(cut)], len(doc) - cut
                else:
                    held = [table]
        if held and size:
            yield from emit(pa.concat_tables(held))
        if bigrams:
            yield counted()

    return ordered.select("doc", "page_idx", "par", "line", "words", "texts", "bucket").mapInArrow(run, ASKED if ask else READ)


NAMES = [x.strip().split(" ")[0] for x in READ.split(",")]


def _fits(paired: DataFrame, bigrams: DataFrame) -> DataFrame:
    """paired (id, to_key, ...) with how often the neighbours stand beside each candidate and beside the word itself.

    Only the pairs that are met come back, and meet their rows in one aggregation by id.
    """

    def probes(batches):
        for batch in batches:
            left, right, to, own = (batch.column(c).to_numpy().view(np.uint64) for c in ("lft", "rgt", "to_key", "key"))
            ident, key = batch.column("id"), batch.column("to_key")
            for of_own, pair in ((False, pair_hash(left, to)), (False, pair_hash(to, right)), (True, pair_hash(left, own)), (True, pair_hash(own, right))):
                yield pa.RecordBatch.from_arrays([ident, key, pa.array(pair.view(np.int64)), pa.array(np.full(len(key), of_own))], ["id", "to_key", "pair", "of_own"])

    asked = paired.select("id", "to_key", "key", "lft", "rgt").mapInArrow(probes, "id long, to_key long, pair long, of_own boolean")
    counts = bigrams.groupBy(F.col("key").alias("pair")).agg(F.sum("n").alias("times"))
    carried = [c for c in paired.columns if c not in ("id", "to_key", "lft", "rgt")]
    kept = F.struct(*carried)
    none = F.lit(None).cast(paired.select(kept.alias("k")).schema["k"].dataType)
    met = asked.join(counts, "pair").select("id", "to_key", F.when(~F.col("of_own"), F.col("times")).alias("beside"), F.when(F.col("of_own"), F.col("times") - 1).alias("own"), none.alias("row"))
    base = paired.select("id", "to_key", F.lit(None).cast("long").alias("beside"), F.lit(None).cast("long").alias("own"), kept.alias("row"))
    both = base.unionByName(met).groupBy("id", "to_key").agg(F.coalesce(F.sum("beside"), F.lit(0)).alias("beside"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"), F.first("row", True).alias("row"))
    return both.select("id", "to_key", "beside", "own", "row.*")


#: Figures with letters of the same shape, by letter.
FIGURES = {"l": "1", "i": "1", "o": "0", "s": "5", "z": "2", "b": "8"}
_FIGURE = "^[£$]?[0-9lioszb.,–-]*[0-9][0-9lioszb.,–-]*$"


def page_noise(words: DataFrame, items: DataFrame, most_broadcast: int = KNOWN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc, page_idx, line, kind) of noisy lines, and the repairs (doc, page_idx, line, at, word, to_word, cost, beside, cut, next_page, next_line).

    A repair stands at the line where the word begins, ``at`` words into it; a word of which ``cut`` letters stand before
    a break goes on in the next line.
    """
    counts = word_counts(words).persist()
    # by more than a usual confusion only where the other word is much more frequent
    likely = (F.col("cost") < 1.1) | (F.col("to_n") >= FAR_RATIO * F.col("n"))
    candidates = repair_candidates(counts).where(likely).persist()
    strong = candidates.where((F.col("to_n") >= 20 * F.col("n")) & (F.col("cost") < 1.5) | (F.col("to_n") >= FAR_RATIO * F.col("n"))).select("key").distinct()
    sent, rest = frequent_and_rest(counts.where("n >= 3").join(strong, "key", "left_anti").select("key", "n"), "n", most_broadcast)
    well_known = sent.toPandas()
    order = np.argsort(well_known["key"].to_numpy().view(np.uint64))
    known = words.sparkSession.sparkContext.broadcast((well_known["key"].to_numpy().view(np.uint64)[order], well_known["n"].to_numpy()[order]))
    titles = items.select("doc", "title").dropDuplicates(["doc"])
    apart = None if rest is None else kept_apart(read_pages(words, titles, known, ask=True), rest)
    read = read_pages(words, titles, known, apart).persist()
    lines = read.where("tag = 'r'").select("doc", "page_idx", "line", "kind")
    suspects = read.where("tag = 's'").drop("tag", "kind", "n").withColumn("id", F.xxhash64("doc", "page_idx", "line", "at", "word"))
    if rest is not None:
        suspects = suspects.join(rest.select("key"), "key", "left_anti")
    paired = suspects.drop("digit").join(candidates.select("key", "n", "to_key", "to_word", "to_n", "cost"), "key")
    fitting = _fits(paired, read.where("tag = 'b'").select("key", "n"))
    near = (F.col("beside") >= 2) | (F.col("beside") >= 1) & (F.col("cost") <= 0.8) | (F.col("to_n") >= 50 * F.col("n")) & (F.col("cost") < 1.0) & (F.length("word") >= 5)
    # a word that keeps its own company is a word of its own
    sure = fitting.where(near & (F.col("beside") >= 20 * F.col("own"))).persist()  # hardly more than there are misread words
    # by more than a usual confusion: only where the other word fits most places of this one
    places = F.count("*").over(Window.partitionBy("key", "to_key"))
    far = sure.where("cost >= 1.1").withColumn("places", places).where(F.col("places") >= FAR_SHARE * F.col("n")).drop("places")
    score = F.log(F.col("beside") + 0.5) + 0.3 * F.log("to_n") - 3 * F.col("cost")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(score), "to_word"))
    repairs = sure.where("cost < 1.1").unionByName(far).withColumn("rank", best).where("rank = 1")
    repairs = repairs.select("doc", "page_idx", "line", "at", "word", "to_word", "cost", F.col("beside").cast("long").alias("beside"), "cut", "next_page", "next_line")
    figure = F.translate("word", "".join(FIGURES), "".join(FIGURES.values()))
    figures = suspects.where(F.col("digit") & F.col("word").rlike(_FIGURE) & F.col("word").rlike("[lioszb]")).select("doc", "page_idx", "line", "at", "word", figure.alias("to_word"), F.lit(0.5).alias("cost"), F.lit(0).cast("long").alias("beside"), "cut", "next_page", "next_line")
    # a figure of the right shape is read as such, whatever word is near it
    repairs = repairs.join(figures.select("doc", "page_idx", "line", "at"), ["doc", "page_idx", "line", "at"], "left_anti").unionByName(figures)
    # the wrong character of a broken word is in the part that does not agree
    in_next = (F.col("cut") > 0) & F.col("to_word").startswith(F.substring("word", F.lit(1), F.col("cut")))
    misread = repairs.select("doc", F.when(in_next, F.col("next_page")).otherwise(F.col("page_idx")).alias("page_idx"), F.when(in_next, F.col("next_line")).otherwise(F.col("line")).alias("line"), F.lit("misread").alias("kind"))
    return lines.unionByName(misread).distinct(), repairs


def _mended_lines(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, page_idx, line, par, text, broken): body lines, misread words replaced and the parts of broken words joined.

    The second part of a broken word goes to the first; a line of nothing else is left out.
    """
    found, repairs = page_noise(words, items)
    marks = found.where("kind != 'misread'").groupBy("doc", "page_idx", "line").agg(F.collect_set("kind").alias("kinds"))
    fix = F.struct("at", "word", "to_word", "cut")
    fixes = repairs.groupBy("doc", "page_idx", "line").agg(F.collect_list(fix).alias("fixes"))
    whole = words.where("doc is not null and page_idx is not null and line is not null and word is not null")
    once = whole.groupBy("doc", "page_idx", "line", "word").agg(F.min("par").alias("par"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    lines = once.groupBy("doc", "page_idx", "line").agg(F.min("par").alias("par"), F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]).alias("words"))
    known = lines.join(marks, ["doc", "page_idx", "line"], "left").join(fixes, ["doc", "page_idx", "line"], "left")
    body = known.where(F.col("kinds").isNull() | ~F.arrays_overlap("kinds", F.array(F.lit("header"), F.lit("pagenum"))))
    bucket = F.expr(f"cast(floor(page_idx / {PAGES}) as int)")
    # a run also sees the first body lines of the page after it and the last of the page before it
    top = F.row_number().over(Window.partitionBy("doc", "page_idx").orderBy("line"))
    end = F.row_number().over(Window.partitionBy("doc", "page_idx").orderBy(F.desc("line")))
    placed = body.withColumn("own", bucket).withColumn("top", top).withColumn("end", end)
    before = F.when((F.pmod("page_idx", F.lit(PAGES)) == 0) & (F.col("top") == 1), F.col("own") - 1)
    after = F.when((F.pmod("page_idx", F.lit(PAGES)) == PAGES - 1) & (F.col("end") == 1), F.col("own") + 1)
    keyed = placed.withColumn("bucket", F.explode(F.filter(F.array("own", before, after), lambda x: x.isNotNull())))
    ordered = keyed.select("doc", "bucket", "own", "page_idx", "line", "par", "words", F.coalesce(F.array_contains("kinds", "hyphen"), F.lit(False)).alias("broken"), "fixes").repartition("doc", "bucket").sortWithinPartitions("doc", "bucket", "page_idx", "line")

    def run(batches):
        last = None  # the line before: key of its run, row, and what was broken off it
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (r["doc"], r["bucket"])
                if last is not None:
                    if last[0] == key and r["page_idx"] - last[1]["page_idx"] <= 1:
                        taken = _join_broken(last[1], r)
                    else:
                        taken = False
                    if last[1]["own"] == last[1]["bucket"]:
                        out.append(last[1])
                    r["words"] = r["words"][1:] if taken else _fixed(r)
                else:
                    r["words"] = _fixed(r)
                last = (key, r)
            yield _line_rows(out)
        if last is not None and last[1]["own"] == last[1]["bucket"]:
            yield _line_rows([last[1]])

    return ordered.mapInArrow(run, LINE)


LINE = "doc long, page_idx int, line int, par int, text string, broken boolean"


def _line_rows(rows: list[dict]) -> pa.RecordBatch:
    kept = [(r["doc"], r["page_idx"], r["line"], r["par"], " ".join(w for w in r["words"] if w), r["broken"]) for r in rows]
    cols = list(zip(*(x for x in kept if x[4]))) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()))], ["doc", "page_idx", "line", "par", "text", "broken"])


def _in_place(raw: str, to: str) -> str:
    """to with the outer marks of raw, and with capitals where raw has them."""
    core = raw.strip(_STRIP)
    if not core:
        return raw
    at = raw.find(core)
    if len(core) > 1 and core.isupper():
        to = to.upper()
    elif core[:1].isupper():
        to = to[:1].upper() + to[1:]
    return raw[:at] + to + raw[at + len(core) :]


def _fixed(r: dict) -> list[str]:
    words = list(r["words"])
    for f in r["fixes"] or ():
        k = f["at"]
        if not f["cut"] and 0 <= k < len(words) and words[k].strip(_STRIP).lower() == f["word"]:
            words[k] = _in_place(words[k], f["to_word"])
    return words


def _join_broken(first: dict, second: dict) -> bool:
    """Puts the first word of the second line, if the last one of the first goes on in it, to that; has it been?"""
    if not first["broken"] or not first["words"] or not second["words"]:
        return False
    head, tail = first["words"][-1].rstrip("".join(HYPHENS)), second["words"][0]
    whole = head + tail
    for f in first["fixes"] or ():
        if f["cut"] and whole.strip(_STRIP).lower() == f["word"]:
            whole = _in_place(whole, f["to_word"])
    first["words"] = [*first["words"][:-1], whole]
    second["words"] = ["", *_fixed(second)[1:]]
    return True


def page_paragraphs(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, page_idx, par, text): the paragraphs of each page, without headings and page numbers."""
    return _mended_lines(words, items).groupBy("doc", "page_idx", "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("text"))


#: Marks that end a paragraph's last line, as a rule.
_ENDS = r"[.!?…:;。！？।؟۔\"'”’»)\]]$"


def item_paragraphs(words: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, paragraph, first_page, last_page, text): the paragraphs of each item in order, over the ends of pages.

    The first paragraph of a page goes on from the page before where that one's last line is broken off or ends without a
    mark and this one does not begin with a capital.  Lines follow each other by running sums in blocks (no item lies in
    one task).
    """
    lines = _mended_lines(words, items).withColumn("place", F.col("page_idx").cast("long") * (1 << 20) + F.col("line"))
    known = lines.select("doc", "place", "page_idx", F.coalesce("par", F.lit(-1)).alias("par"), "broken", F.col("text").rlike(_ENDS).alias("ended"), F.col("text").rlike("^[\\p{P}]*\\p{Lu}").alias("capital"))
    seen = with_context(known, ["doc"], "place", size=PAGES << 20, previous={"was_page": F.col("page_idx"), "was_par": F.col("par"), "was_ended": F.col("ended")})
    on = (F.col("page_idx") == F.col("was_page")) & (F.col("par") == F.col("was_par")) | (F.col("page_idx") != F.col("was_page")) & ~F.col("was_ended") & ~F.col("capital")
    begins = seen.select("doc", "place", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1).alias("begins"))
    numbered = with_context(begins, ["doc"], "place", size=PAGES << 20, before={"so_far": F.col("begins")}).select("doc", "place", (F.col("so_far") + F.col("begins") - 1).cast("int").alias("paragraph"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    return lines.join(numbered, ["doc", "place"]).groupBy("doc", "paragraph").agg(F.min("page_idx").alias("first_page"), F.max("page_idx").alias("last_page"), text.alias("text"))


def text_words(docs: DataFrame) -> DataFrame:
    """(doc, page_idx, par, line, word, text) of exported texts: pages end at form feeds, lines at line feeds, paragraphs at empty lines.

    NULL and empty texts have no words; of rows with one id that differ the first by text counts.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, page, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page_from", "text"))):
                for p, leaf in enumerate(text.split("\f"), page or 0):
                    par = 0
                    for n, line in enumerate(leaf.split("\n")):
                        words = line.split()
                        par += not words
                        rows += [(doc, p, par, n, k, w) for k, w in enumerate(words)]
                if len(rows) > 50_000:
                    yield made(rows)
                    rows = []
            yield made(rows)

    def made(rows):
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["doc", "page_idx", "par", "line", "word", "text"])

    return spread(docs.where("doc_id is not null and text is not null").select("doc_id", "page_from", "text")).mapInArrow(run, "doc long, page_idx int, par int, line int, word int, text string")


def document_paragraphs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text): the exported texts as readable paragraphs, parted by empty lines; titles are those of their items."""
    titles = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("item").alias("_of")).dropDuplicates(["doc"]).join(items.select(F.col("doc").alias("_of"), "title").dropDuplicates(["_of"]), "_of", "left").select("doc", "title")
    paragraphs = item_paragraphs(text_words(docs), titles)
    return paragraphs.groupBy(F.col("doc").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
