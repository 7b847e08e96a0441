"""Problem 5: sentence boundaries by a hidden-event n-gram model.

Between two words there may be an unseen boundary token.  Its probability after a word, and the next word's
probability after a boundary and within a sentence, are n-gram counts over the whole corpus.  Boundaries are not
labelled; the counts come from where they are certain: an empty line or the text's end always is one, a small
letter or an inner mark never follows one.  A word before a full stop that ends paragraphs as often as other
words do ends sentences; an abbreviation does not.  What words follow an empty line tells how sentences begin.

Slots are the places where the writing allows a boundary: after marks and their closing quotes, at spaces and
line ends of Thai, at empty lines, and between all words (in scripts without spaces, characters) of texts without
marks and of stretches of over STRETCH words without one.  Between words the odds are those of a bigram model with
the boundary token: P(end | word) P(next | beginning) / P(next | word), where P(end | word) starts from the length of
sentences and from how likely it is that the writer left marks out, which grows with the words that have none.  Slots
fewer than three words apart depend on each other; forward and backward sums over both states of each give the
posterior.

Defined results: NULL and blank texts have no sentence; a text's end always is one; equal rows give equal
sentences; other columns are ignored.  Positions are numbers of code points from the start of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from .codes import Codes, among, counts_before, range_hash, runs
from .pages import pair_hash
from .util import most_frequent, spread

#: Marks that may end a sentence, those written without a space after them, quotes and brackets.
FINAL = ".!?…。！？।॥؟۔។៕။።։"
WIDE = "。！？"
CLOSE = "\"'”’»)]」』）›“‘"
OPEN = "\"'“‘«„»「『([（—–-¿¡‹‚"
#: Most words kept in each table of the model; the rest count as their shape.
VOCABULARY = 300_000
#: Words without a mark that get slots between them, words of a sentence, and how many texts with marks stand for one without.
STRETCH, LENGTH, MARKED = 40, 15.0, 50.0
DOT, MARK, WIDE_MARK, THAI_SPACE, THAI_SIGN, THAI_LINE, HARD, GAP = range(8)


def _in(c: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(c, [ord(x) for x in chars])


class Slots:
    """The places of a chunk of texts where a sentence may end."""

    def __init__(self, texts: list):
        c = self.codes = Codes(texts)
        n = len(c.cp)
        space = c.is_kind(codes.SPACE, codes.NEWLINE)
        visible = np.flatnonzero(~space & (c.kind != codes.FORMAT) | (c.cp == 0xAD))
        wordy = c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK, codes.DIGIT)
        self.visible = visible
        final = c.within(FINAL)
        greek = ((c.cp >= 0x370) & (c.cp < 0x400)) | ((c.cp >= 0x1F00) & (c.cp < 0x2000))
        final[1:] |= c.within(";\u037e")[1:] & greek[:-1]  # the question mark of Greek
        rs, re = runs(final)
        # closing marks right after, or one French quote after a space
        closer = c.within(CLOSE)
        # these two open a quotation where a word follows
        closer &= ~(c.within("“‘") & np.concatenate((wordy[1:], [False])))
        stop = np.flatnonzero(~closer)
        end = stop[np.minimum(np.searchsorted(stop, re), len(stop) - 1)]
        for _ in range(2):
            at = np.minimum(end, n - 2)
            french = ((c.cp[at] == 32) | (c.cp[at] == 0xA0) | (c.cp[at] == 0x202F) | (c.cp[at] == 10)) & (c.cp[at + 1] == 0xBB)
            end = np.where(french, at + 2, end)
        wide = _in(c.cp[re - 1], WIDE) if len(re) else np.zeros(0, bool)
        allowed = space[np.minimum(end, n - 1)] | wide
        rs, re, end, wide = rs[allowed], re[allowed], end[allowed], wide[allowed]
        dots = (c.cp[re - 1] == 46) & (re - rs == 1) if len(re) else np.zeros(0, bool)
        kind = np.where(wide, WIDE_MARK, np.where(dots, DOT, MARK))
        # Thai: spaces and line ends between visible characters of which one is Thai
        thai = (c.cp >= 0x0E01) & (c.cp < 0x0E5C)
        gs, ge = runs(space)
        inner = (gs > 0) & (ge < n)
        gs, ge = gs[inner], ge[inner]
        left, right = c.cp[gs - 1], c.cp[ge]
        t_left, t_right = thai[gs - 1], thai[ge]
        sign = ((left == 0x0E2F) | (left == 0x0E46)) & t_left  # a sign of abbreviation or repetition
        before_sign = (right == 0x0E2F) | (right == 0x0E46)
        figure = (c.kind[gs - 1] == codes.DIGIT) & t_right
        feeds = counts_before(c.cp == 10)
        line = feeds[ge] - feeds[gs] == ge - gs  # nothing but line feeds: a word goes on
        tk = np.where(line, THAI_LINE, np.where(sign | figure, THAI_SIGN, THAI_SPACE))
        use = t_right & ~before_sign & (t_left | figure | closer[gs - 1]) & ~final[gs - 1]
        gs, tk = gs[use], tk[use]
        # hard: the last visible character before an empty line or the end of the text
        solid = counts_before(~space)
        starts, ends, _, _ = c.lines()
        empty = solid[ends] == solid[starts]
        hard = np.concatenate((starts[empty], c.end))
        k = np.searchsorted(visible, hard) - 1
        ok = (k >= 0)
        hard_end = np.where(ok, visible[np.maximum(k, 0)] + 1, 0) if len(visible) else np.zeros(len(hard), int)
        doc = np.searchsorted(c.end, hard)
        ok &= hard_end > c.start[doc]
        hard_end = np.unique(hard_end[ok])
        # between the words of stretches without marks
        us, ue = self._units(c, wordy)
        gaps, self.omitted = np.zeros(0, int), np.zeros(0)
        if len(us):
            stops = np.unique(np.concatenate((hard_end, end, gs[tk != THAI_LINE])))
            stretch = np.searchsorted(stops, ue, "left")
            size = np.where(codes.unspaced(c.cp[us]), 0.5, 1.0)
            words = np.bincount(stretch, size)[stretch]
            of = np.searchsorted(c.end, us)
            marks = counts_before(final | thai)
            bare = (marks[c.end] == marks[c.start])[of]
            words = np.where(bare, np.bincount(of, size)[of], words)
            pick = (bare | (words > STRETCH)) & ~thai[us]
            gaps = ue[pick]
            self.omitted = np.log(1 / (1 + MARKED * np.exp(-words[pick] / LENGTH))) - np.log(LENGTH)
        self.end = np.concatenate((hard_end, end, gs, gaps))
        self.kind = np.concatenate((np.full(len(hard_end), HARD), kind, tk, np.full(len(gaps), GAP)))
        mark_at = np.concatenate((hard_end, rs, gs, gaps))
        order = np.lexsort((np.arange(len(self.end)), self.end))
        first = np.ones(len(order), bool)
        first[1:] = self.end[order][1:] != self.end[order][:-1]
        self.is_hard = np.isin(self.end, hard_end)
        order = order[first]
        # where a hard end has a mark too, the mark's word is of use
        marked = dict(zip(end.tolist(), range(len(end))))
        self.end, self.kind, mark_at, self.is_hard = self.end[order], self.kind[order], mark_at[order], self.is_hard[order]
        self.mark_at = mark_at
        for i in np.flatnonzero(self.is_hard).tolist():
            j = marked.get(int(self.end[i]))
            if j is not None:
                self.kind[i], mark_at[i] = kind[j], rs[j]
        self.doc = np.searchsorted(c.end, self.end)
        # the word before the mark
        ws, we = runs(wordy)
        self.word_start, self.word_end = ws, we
        w = np.searchsorted(we, mark_at, "right") - 1
        touch = (w >= 0) & (we[np.maximum(w, 0)] == mark_at) if len(ws) else np.zeros(len(mark_at), bool)
        w = np.maximum(w, 0)
        self.left = np.where(touch, range_hash(c.low, ws, we)[w], 0).astype(np.uint64) if len(ws) else np.zeros(len(mark_at), np.uint64)
        self.left_len = np.where(touch, we[w] - ws[w], 0) if len(ws) else np.zeros(len(mark_at), int)
        digit = touch & (c.kind[ws[w]] == codes.DIGIT) if len(ws) else touch
        self.left_digit = digit
        self.left[digit] = 1
        self.closed = c.cp[self.end - 1] != c.cp[np.maximum(mark_at, 0)] if len(self.end) else np.zeros(0, bool)
        self.closed &= closer[self.end - 1] if len(self.end) else False
        # the word after it
        nxt = np.searchsorted(visible, self.end)
        at = visible[np.minimum(nxt, len(visible) - 1)] if len(visible) else self.end
        plain = visible[~_in(c.cp[visible], OPEN)] if len(visible) else visible
        begin = plain[np.minimum(np.searchsorted(plain, self.end), len(plain) - 1)] if len(plain) else at
        self.opened = begin > at
        none = nxt >= len(visible)
        self.next_kind = np.where(none, codes.OTHER, c.kind[begin]) if len(begin) else np.zeros(0, int)
        self.right = self.begin_hash(begin)
        # what the bigrams of gaps are made of: the unit before, the one after, and a beginning as if it had a capital
        at = np.flatnonzero(self.kind == GAP)
        self.gap = at
        if len(at):
            k = np.minimum(np.searchsorted(ue, self.end[at]), len(us) - 1)
            j = np.minimum(k + 1, len(us) - 1)
            self.gap_left, self.gap_next = self.unit_hash(us[k], ue[k]), self.unit_hash(us[j], ue[j])
            self.gap_prior = self.omitted[np.searchsorted(gaps, self.end[at])]
            capitals = counts_before(c.kind == codes.UPPER)
            small = capitals[c.end] == capitals[c.start]
            with np.errstate(over="ignore"):
                self.gap_begin = np.where(small[self.doc[at]] & (self.next_kind[at] == codes.LOWER), self.right[at] + np.uint64(1), self.right[at])

    @staticmethod
    def _units(c: Codes, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start and end of words; in scripts without spaces every character with its marks is one."""
        tight = codes.unspaced(c.cp) & wordy
        base = tight & (c.kind != codes.MARK)
        before = np.concatenate(([False], wordy[:-1]))
        was = np.concatenate(([False], tight[:-1]))
        start = np.flatnonzero(wordy & (~before | base | (was & ~tight)))
        stop = np.flatnonzero(~np.concatenate((wordy, [False])))
        end = np.minimum(np.concatenate((start[1:], [len(wordy)])), stop[np.searchsorted(stop, start)])
        return start, end

    def unit_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of a word; of a character of a script without spaces together with the one before it."""
        c = self.codes
        return range_hash(c.low, np.where(codes.unspaced(c.cp[start]), np.maximum(end - 2, 0), start), end)

    def begin_hash(self, begin: np.ndarray) -> np.ndarray:
        """Hash of the word that begins there, with its shape; two characters in Han and kana, four in Thai."""
        c = self.codes
        if not len(begin) or not len(self.word_start):
            return np.zeros(len(begin), np.uint64)
        k = np.searchsorted(self.word_end, begin, "right")
        k = np.minimum(k, len(self.word_end) - 1)
        end = np.where(self.word_start[k] <= begin, self.word_end[k], begin)
        tight = codes.unspaced(c.cp[begin])
        thai = tight & (c.cp[begin] < 0x1000)
        end = np.where(tight, np.minimum(end, begin + np.where(thai, 4, 2)), end)
        with np.errstate(over="ignore"):
            return range_hash(c.low, begin, np.maximum(end, begin)) * np.uint64(3) + (c.kind[begin] == codes.UPPER)


def _events(texts: list):
    """(table, key, counts) of a chunk: table 0 words before a full stop, 1 words after a boundary or within a sentence."""
    s = Slots(texts)
    c = s.codes
    lower = (s.next_kind == codes.LOWER) | (s.next_kind == codes.PUNCT)
    dot = s.kind == DOT
    keys, inverse = np.unique(s.left[dot], return_inverse=True)
    hard, small = s.is_hard[dot], lower[dot] & ~s.is_hard[dot]
    yield 0, keys, np.stack([np.bincount(inverse, minlength=len(keys)), np.bincount(inverse, hard, len(keys)), np.bincount(inverse, small, len(keys)), np.zeros(len(keys))], 1)
    # beginnings: after an empty line; within: after a word and white space; after closing marks; after full stops
    ws = s.word_start
    begins = s.right[s.is_hard & (s.kind != HARD)]
    space_before = np.concatenate(([False], c.is_kind(codes.SPACE, codes.NEWLINE)[:-1]))
    word_before = np.concatenate(([False, False], c.is_kind(codes.LOWER, codes.CASELESS, codes.MARK)[:-2]))
    tight = codes.unspaced(c.cp[ws]) if len(ws) else np.zeros(0, bool)
    inner = s.begin_hash(ws[(space_before & word_before)[ws] & ~tight]) if len(ws) else np.zeros(0, np.uint64)
    closed = s.right[s.closed & ~s.is_hard & (s.next_kind == codes.CASELESS)]
    thai = s.right[s.kind == THAI_LINE]
    after_dot = s.right[(s.kind == DOT) & ~s.is_hard & ~lower]
    every = np.concatenate((begins, inner, closed, thai, after_dot))
    which = np.repeat([0, 1, 2, 1, 3], [len(begins), len(inner), len(closed), len(thai), len(after_dot)])
    caseless = s.is_hard & (s.kind != HARD) & (s.next_kind == codes.CASELESS)
    yield 0, np.array([2], np.uint64), np.array([[0, 0, 0, caseless.sum()]], float)
    # units before a boundary and all of them; pairs of neighbours
    us, ue = s._units(c, c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK, codes.DIGIT))
    if len(us):
        units = s.unit_hash(us, ue)
        sure = s.is_hard | np.isin(s.kind, (MARK, WIDE_MARK)) & ~lower
        at = np.searchsorted(ue, s.mark_at[sure], "right") - 1
        ends = np.zeros(len(us))
        ends[at[at >= 0]] = 1
        keys, inverse = np.unique(units, return_inverse=True)
        n = np.bincount(inverse)
        yield 2, keys, np.stack([np.bincount(inverse, ends, len(keys)), n, np.zeros(len(keys)), np.zeros(len(keys))], 1)
        near = (us[1:] - ue[:-1] <= 2) & (us[1:] >= ue[:-1]) & (ends[:-1] == 0)
        keys, n = np.unique(pair_hash(units[:-1][near], units[1:][near]), return_counts=True)
        yield 3, keys, np.stack([n, np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys))], 1)
    keys, inverse = np.unique(every, return_inverse=True)
    yield 1, keys, np.stack([np.bincount(inverse, which == k, len(keys)) for k in range(4)], 1)


def event_counts(docs: DataFrame) -> DataFrame:
    """(tab, key, a, b, c, d): the counts of the model over all texts."""

    def run(batches):
        pending: dict[int, list] = {0: [], 1: [], 2: [], 3: []}

        def settled(t):
            keys = np.concatenate([k for k, _ in pending[t]])
            counts = np.concatenate([n for _, n in pending[t]])
            keys, inverse = np.unique(keys, return_inverse=True)
            pending[t] = [(keys, np.stack([np.bincount(inverse, counts[:, j], len(keys)) for j in range(4)], 1))]

        def batch_of(t):
            settled(t)
            (keys, n), = pending[t]
            pending[t] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t), pa.int32()), pa.array(keys.view(np.int64)), *(pa.array(n[:, j]) for j in range(4))], ["tab", "key", "a", "b", "c", "d"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in codes.chunks(texts):
                for t, keys, n in _events(texts[part]):
                    pending[t].append((keys, n))
                    if len(pending[t]) > 16:
                        settled(t)
                        if len(pending[t][0][0]) > 1_000_000:
                            yield batch_of(t)
        for t in pending:
            if pending[t]:
                yield batch_of(t)

    parts = spread(docs.where("text is not null and text != ''").select("text")).mapInArrow(run, "tab int, key long, a double, b double, c double, d double")
    return parts.groupBy("tab", "key").agg(*(F.sum(x).alias(x) for x in "abcd"))


class Model:
    """Log odds of a boundary at each slot, and their posterior."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], totals: dict):
        (self.left, self.left_n), (self.right, self.right_n), (self.unit, self.unit_n), (self.pair, self.pair_n) = tables
        self.units = totals.get(2, np.zeros(4)) + 1.0
        self.total = totals.get(1, np.ones(4)) + 1.0
        n = totals.get(0, np.zeros(4))
        # boundaries within paragraphs for each one at its end, if most full stops are boundaries
        self.ratio = max(1.0, (n[0] - n[2]) / max(n[1], 1.0))
        # closing quotes before a word without case, for each paragraph that begins with one
        self.closings = self.total[2] / max(n[3], 1.0)

    def gap_odds(self, s: Slots) -> np.ndarray:
        """Log odds of a boundary between words without a mark, by bigrams with the boundary token."""

        def found(keys, values, x):
            at = among(keys, x)
            return np.where(at[:, None] >= 0, values[np.maximum(at, 0)], 0.0) if len(keys) else np.zeros((len(x), 4))

        left, after = found(self.unit, self.unit_n, s.gap_left), found(self.unit, self.unit_n, s.gap_next)
        usual = self.units[0] / self.units[1]
        ends = np.log((left[:, 0] + 2 * usual) / (left[:, 1] + 2) / usual)
        begin, same = found(self.right, self.right_n, s.gap_begin), found(self.right, self.right_n, s.right[s.gap])
        begins = np.log((begin[:, 0] + 0.005) / self.total[0] / ((same[:, 1] + 0.3) / self.total[1]))
        # how much more often than by chance the two stand together
        chance = (left[:, 1] + 1) * (after[:, 1] + 1) / self.units[1]
        together = np.log((found(self.pair, self.pair_n, pair_hash(s.gap_left, s.gap_next))[:, 0] + 0.5) / (chance + 0.5))
        return s.gap_prior + np.clip(ends, -3, 4) + np.clip(begins, -4, 6) - np.clip(together, -2, 5)

    def odds(self, s: Slots) -> np.ndarray:
        k = s.next_kind
        at = among(self.left, s.left)
        n = np.where(at[:, None] >= 0, self.left_n[np.maximum(at, 0)], 0.0) if len(self.left) else np.zeros((len(at), 4))
        usual = np.where(s.left_len == 1, 0.2, np.where(s.left_digit, 0.6, 0.95))
        free = np.maximum(n[:, 0] - n[:, 2], 0)
        # never at a paragraph's end: an abbreviation, or too rare to tell; else its share of boundaries is known
        share = 1 / (1 + self.ratio)
        never = np.log(usual / (1 - usual)) + free * np.log((1 - share) / 0.996)
        p = np.clip((n[:, 1] * (1 + self.ratio) + usual) / (np.maximum(free, n[:, 1] * (1 + self.ratio)) + 1), 0.004, 0.997)
        prior = np.where(n[:, 1] > 0, np.log(p / (1 - p)), np.clip(never, -6, 6))
        base = np.array([0.0, 4.0, 6.0, 4.0, -2.0, -6.0, 0.0, -4.0])[s.kind]
        score = np.where(s.kind == DOT, prior, base)
        at = among(self.right, s.right)
        n = np.where(at[:, None] >= 0, self.right_n[np.maximum(at, 0)], 0.0) if len(self.right) else np.zeros((len(at), 4))
        within = (n[:, 1] + 0.3) / self.total[1]
        ratio = np.clip(np.log((n[:, 0] + 0.005) / self.total[0] / within), -4, 4)
        # a word that follows full stops far more often than it begins paragraphs belongs to what is before them
        ratio += np.minimum(0.0, np.log((n[:, 0] * self.ratio + 0.3) / (n[:, 3] + 0.3)))
        upper, lower, caseless, digit = (k == x for x in (codes.UPPER, codes.LOWER, codes.CASELESS, codes.DIGIT))
        score = score + np.where(upper | caseless & (s.kind != WIDE_MARK), ratio, 0.0)
        score = np.where(lower & (s.kind != GAP), -8.0, score)
        score = np.where(digit, score - 2.5, score)
        score = np.where((k == codes.PUNCT) & ~s.opened, -6.0, score)
        # a clause after a quotation: a word that follows closing quotes more often than such a beginning would
        clause = np.log((n[:, 0] * self.closings + 0.3) / (n[:, 2] + 0.3))
        score = np.where(s.closed & caseless & ~s.is_hard, np.clip(clause * 1.5 + 2.0, -8, 8), score)
        if len(s.gap):
            own = self.gap_odds(s)
            score[s.gap] = np.where(((k == codes.PUNCT) & ~s.opened)[s.gap], -6.0, np.where(digit[s.gap], own - 2.5, own))
        return np.where(s.is_hard, 30.0, score)

    def posterior(self, s: Slots) -> np.ndarray:
        score = self.odds(s)
        out = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if len(s.end) < 2:
            return out
        # words between neighbouring slots: sentences of one or two words are rare; Thai line ends are hardly slots
        idx = np.flatnonzero((s.kind != THAI_LINE) | s.is_hard)
        if len(idx) < 2:
            return out
        end, kind, hard, doc, score = s.end[idx], s.kind[idx], s.is_hard[idx], s.doc[idx], score[idx]
        w = np.searchsorted(s.word_start, end)
        # in Thai a phrase of that size belongs to the sentence before the space, also at a hard end
        thai = np.isin(kind[:-1], (THAI_SPACE, THAI_SIGN))
        near = ((np.diff(w) <= 2) | thai) & (np.diff(end) <= np.where(thai, 21, 16)) & (np.diff(doc) == 0) & (~hard[1:] | thai) & ~hard[:-1] & (kind[1:] != WIDE_MARK)
        for a, b in zip(*runs(near)):
            x = np.exp(np.clip(score[a : b + 1], -30, 30))
            n = b - a + 1
            forward, backward = np.zeros((n, 2)), np.ones((n, 2))
            both = 0.02
            forward[0] = 1.0, x[0]
            for i in range(1, n):
                forward[i] = forward[i - 1].sum(), (forward[i - 1, 0] + both * forward[i - 1, 1]) * x[i]
                forward[i] /= forward[i].sum()
            for i in range(n - 2, -1, -1):
                on = x[i + 1] * backward[i + 1, 1]
                backward[i] = backward[i + 1, 0] + on, backward[i + 1, 0] + both * on
                backward[i] /= backward[i].sum()
            both_ways = forward * backward
            out[idx[a : b + 1]] = both_ways[:, 1] / both_ways.sum(1)
        return out


def sentence_model(docs: DataFrame, vocabulary: int = VOCABULARY) -> Model:
    counts = event_counts(docs).persist()
    totals = {r["tab"]: np.array([r["a"], r["b"], r["c"], r["d"]], float) for r in counts.groupBy("tab").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()}
    tables = []
    for t in range(4):  # the most frequent words of each table, as columns
        own = most_frequent(counts.where(F.col("tab") == t).withColumn("all", F.col("a") + F.col("b") + F.col("c") + F.col("d")), "all", vocabulary).select("key", *"abcd").toArrow()
        key = own.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        tables.append((key[order], np.stack([own.column(x).to_numpy()[order] for x in "abcd"], 1).astype(float)))
    counts.unpersist()
    return Model(tables, totals)


SCHEMA = "doc_id long, sentence int, start_pos long, end_pos long, posterior double"


def sentence_units(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, start_pos, end_pos, posterior) of every sentence of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY words a table

    def run(batches):
        model = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in codes.chunks(texts):
                s = Slots(texts[part])
                p = model.posterior(s)
                use = p >= least
                end, doc, p = s.end[use], s.doc[use], p[use]
                new = np.ones(len(end), bool)
                new[1:] = doc[1:] != doc[:-1]
                before = np.where(new, s.codes.start[doc], np.concatenate(([0], end[:-1]))) if len(end) else end
                at = np.minimum(np.searchsorted(s.visible, before), max(len(s.visible) - 1, 0))
                start = s.visible[at] if len(s.visible) else before
                number = np.arange(len(end)) - np.maximum.accumulate(np.where(new, np.arange(len(end)), 0)) if len(end) else end
                base = s.codes.start[doc]
                mine = ids[part]
                own = [mine[k] for k in doc.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(number, pa.int32()), pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64()), pa.array(p, pa.float64())], ["doc_id", "sentence", "start_pos", "end_pos", "posterior"])

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, SCHEMA)
