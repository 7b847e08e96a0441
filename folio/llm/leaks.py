"""Problem 7: passages of held-out test items in the corpus.

The normalised words of all items form one generalised suffix automaton.  The places of the items that end with a
state's words are an interval of the automaton's link tree in depth-first order, so every item is met, however many
share the words.  The words of a batch of texts enter the automaton at its states of SEED words, all at once by a
table of these; neighbouring states on one diagonal of text and item make up the longest matches, each item's own.
Twenty words of which one in four is misread hold a match of SEED words, and as a rule several, on diagonals that
broken words move by a few.  Where such matches on near diagonals come to STRONG words (half the item, if that is
less), or one that ends with a line goes on in another that begins one, the passage is followed in both directions
over misread and broken words and over lines that stand in between, and counts if it covers ``least_words`` of the
item or all of it.

The automaton is made on the executors from the items' texts, in blocks of BLOCK_CHARS characters; every block is held
against all texts, so there may be any number of items.

Words are compared in lower case, without marks, hyphens, and breaks at line ends.  A character of a script
without spaces is half a word.

Defined results: NULL and empty texts contain nothing, NULL and empty items are contained nowhere; an item that
comes twice is found under its id once; equal texts under several ids are found under each.  Items of fewer than
SEED words are found where all of their words stand in a row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from .codes import Codes, among, counts_before, range_hash
from .lines import edits
from .util import fresh, spread

SEED = 3
#: Words of matches that a passage holds at least, on diagonals within DRIFT and with at most APART words between two.
STRONG, DRIFT, APART = 9, 4, 10
#: Most words of the lines (notices, headings, page numbers) that may stand between two words of an unbroken passage.
GAP = 200
#: Words looked through for a misread word after such lines.
NEAR = 48
BLOCK_CHARS = 4_000_000
EXPANDED = 2_000_000
_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def normal_words(texts: list):
    """Codes, word hashes, text index, and start and end of every word in the texts."""
    c = Codes(texts)
    letter = c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK, codes.DIGIT)
    space = c.is_kind(codes.SPACE, codes.NEWLINE)
    hyphen = c.within("-\u00ad\u00ac\u2010\u2011=")
    n = len(c.cp)
    # a hyphen between letters, and one at a line's end before a small letter, go with the white space after them
    at = np.flatnonzero(hyphen[1:-1] & letter[:-2]) + 1
    solid = np.flatnonzero(~space)
    nxt = solid[np.minimum(np.searchsorted(solid, at + 1), len(solid) - 1)] if len(solid) else at
    feeds = counts_before(c.cp == 10)
    small = (c.kind[nxt] == codes.LOWER) | (c.kind[nxt] == codes.CASELESS)
    same = np.searchsorted(c.end, at) == np.searchsorted(c.end, nxt)
    join = same & (nxt > at) & ((nxt == at + 1) & letter[nxt] & (c.cp[at] != 0x3D) | small & (feeds[nxt] - feeds[at] == 1))
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at[join], 1)
    np.add.at(edge, nxt[join], -1)
    keep = (np.cumsum(edge[:-1]) == 0) & (c.kind != codes.FORMAT)
    where = np.flatnonzero(keep)
    w = letter[keep]
    u = codes.unspaced(c.low[keep]) & w
    cut = u | np.concatenate(([False], u[:-1]))
    before = np.concatenate(([False], w[:-1]))
    start = np.flatnonzero(w & (~before | cut))
    end = np.flatnonzero(np.concatenate((before & (~w | cut), w[-1:])))
    h = range_hash(c.low[keep], start, end)
    first, last = where[start], where[end - 1] + 1 if len(end) else end
    return c, h, np.searchsorted(c.end, first), first, last, np.where(u[start], 0.5, 1.0) if len(start) else np.zeros(0)


def gram(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """One number for three word numbers; an equal one for others only costs a look at the automaton."""
    with np.errstate(over="ignore"):
        return (a.astype(np.uint64) * _K1 + b.astype(np.uint64)) * _K2 + c.astype(np.uint64)


class TestItems:
    """The generalised suffix automaton of the items' words."""

    def __init__(self, items: list[tuple[int, str]]):
        items = sorted({i: t for i, t in items if i is not None and t}.items())
        self.ids = [i for i, _ in items]
        c, h, doc, first, end, weight = normal_words([t for _, t in items])
        self.vocabulary = np.unique(h)
        ids = np.searchsorted(self.vocabulary, h)
        edge = np.searchsorted(doc, np.arange(len(items) + 1))
        # all words in one row, with a stop after each item
        self.first = edge[:-1] + np.arange(len(items))
        self.flat = np.full(len(ids) + len(items) + SEED, -9, np.int64)
        self.flat[np.arange(len(ids)) + doc] = ids
        self.item = np.repeat(np.arange(len(items)), np.diff(edge) + 1)
        tight = np.zeros(len(self.flat), bool)
        tight[np.arange(len(ids)) + doc] = weight < 1
        words = np.diff(edge)
        self.words = [ids[a:b].tolist() for a, b in zip(edge, edge[1:])]
        self.weight = [weight[a:b].tolist() for a, b in zip(edge, edge[1:])]
        self.total = [sum(x) for x in self.weight]
        spelled = ["".join(ch for ch in c.joined[x:y].lower() if ch.isalnum()) for x, y in zip(first.tolist(), end.tolist())]
        self.names = [spelled[a:b] for a, b in zip(edge, edge[1:])]
        # words in a row that a match needs at each place
        self.need = np.where(tight, 2 * SEED, SEED)[: len(self.item)]  # half words count for half
        self.need = np.minimum(self.need, np.maximum(words[self.item], 1))
        self._automaton()
        self.sums = np.zeros(len(self.flat) + 1)
        self.sums[1:][np.arange(len(ids)) + doc] = weight
        np.cumsum(self.sums, out=self.sums)
        self.least = np.minimum(STRONG, np.maximum(np.minimum(SEED, self.total), np.array(self.total) / 2))
        self.short = {n: defaultdict(list) for n in range(1, SEED)}
        for k, own in enumerate(self.words):
            if 0 < len(own) < SEED:
                self.short[len(own)][tuple(own)].append(k)

    def _automaton(self) -> None:
        step: list[dict[int, int]] = [{}]
        link, length, places = [-1], [0], []
        for k, own in enumerate(self.words):
            last = 0
            for pos, ch in enumerate(own):
                q = step[last].get(ch)
                if q is not None and length[q] == length[last] + 1:
                    last = q
                else:
                    cur = len(step) if q is None else None
                    if cur is not None:
                        step.append({})
                        link.append(0)
                        length.append(length[last] + 1)
                        p = last
                        while p >= 0 and ch not in step[p]:
                            step[p][ch] = cur
                            p = link[p]
                        q = step[p][ch] if p >= 0 else None
                    else:
                        p = last
                    if q is not None and p >= 0:
                        if length[q] == length[p] + 1:
                            if cur is not None:
                                link[cur] = q
                        else:
                            clone = len(step)
                            step.append(dict(step[q]))
                            link.append(link[q])
                            length.append(length[p] + 1)
                            while p >= 0 and step[p].get(ch) == q:
                                step[p][ch] = clone
                                p = link[p]
                            link[q] = clone
                            if cur is not None:
                                link[cur] = clone
                            else:
                                cur = clone
                    last = cur
                places.append((last, int(self.first[k]) + pos))
        n = len(step)
        # the link tree in depth-first order: the end places of a state are those of its subtree
        parent, size = np.array(link), np.ones(n, np.int64)
        by_length = np.argsort(length, kind="stable")
        for s in by_length[::-1].tolist():
            if link[s] >= 0:
                size[link[s]] += size[s]
        enter, used = np.zeros(n, np.int64), np.ones(n, np.int64)
        for s in by_length.tolist():
            if (p := link[s]) >= 0:
                enter[s] = enter[p] + used[p]
                used[p] += size[s]
        where = np.array(places, np.int64).reshape(-1, 2)
        at = enter[where[:, 0]]
        order = np.lexsort((where[:, 1], at))
        self.places = where[order, 1]
        self.low, self.high = np.searchsorted(at[order], enter), np.searchsorted(at[order], enter + size)
        # the states of SEED words, with the intervals of their places
        grams: dict[tuple[int, ...], int] = {}
        for own in self.words:
            for k in range(len(own) - SEED + 1):
                words = tuple(own[k : k + SEED])
                if words not in grams:
                    state = 0
                    for ch in words:
                        state = step[state][ch]
                    grams[words] = state
        keys = gram(*np.array(list(grams), np.int64).reshape(-1, SEED).T)
        order = np.argsort(keys, kind="stable")
        states = np.array(list(grams.values()), np.int64)[order]
        self.grams, self.low, self.high = keys[order], self.low[states], self.high[states]
        self.places, self.flat = self.places.astype(np.int32), self.flat.astype(np.int32)

    def matches(self, row: np.ndarray, text: np.ndarray, line: np.ndarray):
        """(end, item, position of the end) of the longest matches worth following, by end.

        row: the words of several texts, with a stop before, between and after them; text, line: of each word.
        """
        out = []
        for n, own in self.short.items():
            if own:
                hit = np.isin(row[: len(row) - n + 1], np.array(sorted(own), np.int64)[:, 0])
                for at in np.flatnonzero(hit).tolist():
                    for k in own.get(tuple(row[at : at + n].tolist()), ()):
                        out.append((at + n - 1, k, n - 1))
        i = np.flatnonzero((row[:-2] >= 0) & (row[1:-1] >= 0) & (row[2:] >= 0))
        of = among(self.grams, gram(row[i], row[i + 1], row[i + 2]))
        i, of = i[of >= 0], of[of >= 0]
        if not len(i):
            return sorted(out)
        count = self.high[of] - self.low[of]
        first, last = [], []
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(np.cumsum(count) // EXPANDED)) + 1):
            c = count[part]
            s = np.repeat(i[part], c)
            p = self.places[np.repeat(self.low[of[part]] - np.cumsum(c) + c, c) + np.arange(len(s))]
            begins = self.flat[p - SEED] != np.repeat(row[i[part] - 1], c)
            ends = self.flat[p + 1] != np.repeat(row[i[part] + SEED], c)
            # matches on one diagonal do not overlap: sorted by diagonal and place, begins and ends go in pairs
            for found, which in ((first, begins), (last, ends)):
                x = s[which]
                found.append((p[which] - (SEED - 1) - x + len(row)) << 32 | x)
        first, last = np.sort(np.concatenate(first)), np.sort(np.concatenate(last))
        s, e = first & 0xFFFFFFFF, (last & 0xFFFFFFFF) + SEED - 1
        p = (first >> 32) - len(row) + s
        size = e - s + 1
        keep = size >= self.need[p]
        s, e, p, size = s[keep], e[keep], p[keep], size[keep]
        weight, item = self.sums[p + size] - self.sums[p], self.item[p]
        pair = text[s].astype(np.int64) * len(self.ids) + item
        diagonal = p - s + len(row)
        strong = np.zeros(len(s), bool)
        for shift in (0, DRIFT // 2):
            # chains on near diagonals, whose matches follow each other in the item
            near = (diagonal + shift) // DRIFT
            order = np.argsort(near << 32 | s, kind="stable")
            x, y = order[1:], order[:-1]
            new = np.ones(len(order), bool)
            new[1:] = (near[x] != near[y]) | (pair[x] != pair[y]) | (p[x] - p[y] - size[y] > APART)
            chain = np.cumsum(new) - 1
            strong[order] |= np.bincount(chain, weight[order])[chain] >= self.least[item[order]] - 1e-9
        # matches at a line's end with those at the beginning of a line that go on from there
        x, y = np.flatnonzero(line[e] != line[e + 1]), np.flatnonzero(line[s] != line[s - 1])
        where = pair[x] << 32 | p[x] + size[x]
        order = np.argsort(where)
        x, where = x[order], where[order]
        low, high = (np.searchsorted(where, pair[y] << 32 | p[y] + d) for d in (-2, 1))
        a, b = np.repeat(y, high - low), x[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange((high - low).sum())]
        on = (s[a] > e[b]) & (s[a] - e[b] <= GAP) & (weight[a] + weight[b] >= 0.75 * self.least[item[a]])
        strong[a[on]] = strong[b[on]] = True
        s, e, p, item = s[strong], e[strong], p[strong], item[strong]
        out += zip(e.tolist(), item.tolist(), (p + e - s - self.first[item]).tolist())
        return sorted(out)

    def follow(self, text: _Text, at: int, item: int, pos: int, met: set[tuple[int, int, int]]) -> tuple[int, int, int, int]:
        """First and last word of the text and of the item of the unbroken passage through the match; met takes its places in."""
        own, names = self.words[item], self.names[item]

        def walk(a: int, b: int, d: int) -> tuple[int, int]:
            end_a, end_b = a - d, b - d
            while 0 <= b < len(own) and 0 <= a < len(text.ids):
                met.add((a, item, b))
                to = self._next(text, own, names, a, b, d)
                if to is None:
                    break
                a, b = to
                end_a, end_b = a - d, b - d
            return end_a, end_b

        right_a, right_b = walk(at, pos, 1)
        left_a, left_b = walk(at - 1, pos - 1, -1)
        return left_a, right_a, left_b, right_b

    def _next(self, text: _Text, own: list[int], names: list[str], a: int, b: int, d: int) -> tuple[int, int] | None:
        """Where text and item go on after words a and b, which are equal, misread, or parted by a break or by other lines."""
        n, m = len(text.ids), len(own)
        if text.ids[a] == own[b]:
            return a + d, b + d
        word = names[b]
        # a word that the items know is hardly a misread one, unless the next word agrees again
        odd = text.ids[a] < 0
        agrees = 0 <= a + d < n and 0 <= b + d < m and text.ids[a + d] == own[b + d]
        if not agrees and 0 <= a + d < n and text.size(a) + text.size(a + d) == len(word) and text.pair(a, a + d, d) == word:  # broken without a mark
            return a + 2 * d, b + d
        if (odd or agrees) and alike(text.word(a), word):
            return a + d, b + d
        rejoins = 0 <= a + 2 * d < n and 0 <= b + d < m and text.ids[a + 2 * d] == own[b + d]
        if 0 <= a + d < n and (odd or rejoins or text.ids[a + d] < 0) and alike(text.pair(a, a + d, d), word):
            return a + 2 * d, b + d
        if odd and 0 <= b + d < m and alike(text.word(a), names[b] + names[b + d] if d > 0 else names[b + d] + names[b]):
            return a + d, b + 2 * d
        # a character by itself, where the two after it agree again
        if len(word) == 1 and text.size(a) == 1 and all(0 <= a + k * d < n and 0 <= b + k * d < m and text.ids[a + k * d] == own[b + k * d] for k in (1, 2)):
            return a + d, b + d
        # whole lines in between: before this word, or within it
        for t in text.later(own[b], a + d, d):
            if text.breaks(t - d, t, d) and text.breaks(a - d, a, d):
                u, v = t + d, b + d
                # the further, the more words have to agree
                if abs(t - a) > NEAR and not all(0 <= t + k * d < n and 0 <= b + k * d < m and text.ids[t + k * d] == own[b + k * d] for k in range(STRONG)):
                    continue
                if not (0 <= u < n and 0 <= v < m) or text.ids[u] == own[v] or text.ids[u] < 0 and alike(text.word(u), names[v]):
                    return t, b
        for broken in (0, 1):
            s = a + broken * d
            if not 0 <= s < n or not text.breaks(s - d, s, d):
                continue
            for t in range(s + d, s + d * (NEAR + 1), d):
                if not 0 <= t < n:
                    break
                if text.breaks(t - d, t, d):
                    if broken:
                        if (odd or text.ids[t] < 0) and alike(text.pair(a, t, d), word):
                            return t + d, b + d
                    elif text.ids[t] == own[b] or len(word) > 3 and text.ids[t] < 0 and alike(text.word(t), word):
                        u, v = t + d, b + d
                        if not (0 <= u < n and 0 <= v < m) or text.ids[u] == own[v] or text.ids[u] < 0 and alike(text.word(u), names[v]):
                            return t, b
        return None


class _Text:
    """The words of one text, with their ids among the items' words and their lines."""

    def __init__(self, joined: str, ids: list[int], first: list[int], last: list[int], line_first: list[int], line_last: list[int]):
        self.joined, self.ids, self.first, self.last, self.line_first, self.line_last = joined, ids, first, last, line_first, line_last
        self.of: dict[int, list[int]] | None = None

    def later(self, word: int, a: int, d: int):
        """Places of the word from a on in direction d, at most GAP words away, the nearest first."""
        if self.of is None:
            self.of = defaultdict(list)
            for k, w in enumerate(self.ids):
                if w >= 0:
                    self.of[w].append(k)
        own = self.of.get(word, [])
        if d > 0:
            return own[bisect_left(own, a) : bisect_right(own, a + GAP)]
        return own[bisect_left(own, a - GAP) : bisect_right(own, a)][::-1]

    def word(self, k: int) -> str:
        return "".join(ch for ch in self.joined[self.first[k] : self.last[k]].lower() if ch.isalnum())

    def size(self, k: int) -> int:
        return self.last[k] - self.first[k]

    def pair(self, a: int, b: int, d: int) -> str:
        return self.word(a) + self.word(b) if d > 0 else self.word(b) + self.word(a)

    def breaks(self, a: int, b: int, d: int) -> bool:
        """Does a line end between the neighbouring words a and b?"""
        a, b = min(a, b), max(a, b)
        return a < 0 or b >= len(self.ids) or self.line_last[a] < self.line_first[b]


def alike(a: str, b: str) -> bool:
    """May a be b misread?"""
    n = max(len(a), len(b))
    if n < 2 or a.isdigit() or b.isdigit():
        return a == b
    most = max(1, n // 3)
    return edits(a, b, most) <= most


SCHEMA = "doc_id long, item_id long, start long, end long, words double, share double"


_MADE: dict[str, TestItems] = {}


def _automaton_of(name: str, shared) -> TestItems:
    """The automaton of a broadcast block of items, made once a worker."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = TestItems(shared.value)
    return _MADE[name]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """(item_id, text) of the items in blocks of about block_chars characters."""
    rows = items.where("item_id is not null and text is not null and text != ''").select("item_id", "text").groupBy("item_id").agg(F.max("text").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [rows.where(of == k) if blocks > 1 else rows for k in range(blocks)]


def leaked(docs: DataFrame, items: DataFrame, least_words: float = 20, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, words, share): the passages of each item in each text, in code points.

    Of passages of one item that overlap the longest is kept.
    """
    out = None
    for block in item_blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])  # about block_chars characters
        one = _leaked(docs, shared, least_words)
        out = one if out is None else out.unionByName(one)
    return out


def _leaked(docs: DataFrame, shared, least_words: float) -> DataFrame:
    name = uuid4().hex

    def run(batches):
        tests = _automaton_of(name, shared)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in codes.chunks(texts):
                own = ids[part]
                c, h, doc, first, last, _ = normal_words(texts[part])
                words = among(tests.vocabulary, h)
                edge = np.searchsorted(doc, np.arange(len(own) + 1))
                feeds = counts_before(c.cp == 10)
                shift = doc + 1  # a stop before, between and after the texts
                row = np.full(len(words) + len(own) + 1 + SEED, -3, np.int32)
                row[np.arange(len(words)) + shift] = words
                text_of, line = np.full(len(row), -1), np.full(len(row), -1)
                text_of[np.arange(len(words)) + shift] = doc
                line[np.arange(len(words)) + shift] = feeds[first]
                out = []
                for k, matches in groupby(tests.matches(row, text_of, line), key=lambda m: int(text_of[m[0]])):
                    a, b = int(edge[k]), int(edge[k + 1])
                    found: dict[int, list] = {}
                    met: set[tuple[int, int, int]] = set()  # places of text and item that were followed before
                    f, z = first[a:b], last[a:b]
                    text = _Text(c.joined, words[a:b].tolist(), f.tolist(), z.tolist(), feeds[f].tolist(), feeds[z - 1].tolist())
                    for at, item, pos in matches:
                        at -= a + k + 1
                        if (at, item, pos) in met:
                            continue
                        la, ra, lb, rb = tests.follow(text, at, item, pos, met)
                        covered = sum(tests.weight[item][lb : rb + 1])
                        if covered >= least_words or covered >= tests.total[item]:
                            found.setdefault(item, []).append((covered, la, ra))
                    for item, passages in found.items():
                        kept: list[tuple] = []
                        for covered, la, ra in sorted(passages, key=lambda x: -x[0]):
                            if any(la <= y and x <= ra for x, y in kept):
                                continue
                            kept.append((la, ra))
                            out.append((own[k], tests.ids[item], int(first[a + la] - c.start[k]), int(last[a + ra] - c.start[k]), covered, covered / tests.total[item]))
                cols = list(zip(*out)) or [()] * 6
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["doc_id", "item_id", "start", "end", "words", "share"])

    return spread(docs.where("text is not null").select("doc_id", "text")).mapInArrow(run, SCHEMA)


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """docs with the leaked passages cut out of text; other columns, rows and NULLs stay as they are."""
    key, name = fresh(docs, "_leak_doc"), fresh(docs, "_spans")
    spans = leaks.groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(name))
    piece = lambda a, b: F.substring(F.col("text"), a.cast("int") + 1, (b - a).cast("int"))
    kept = F.aggregate(
        name,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.when(s["start"] > acc["at"], F.concat(acc["text"], piece(acc["at"], s["start"]))).otherwise(acc["text"]).alias("text"), F.greatest(acc["at"], s["end"]).alias("at")),
        lambda acc: F.concat(acc["text"], piece(acc["at"], F.length("text").cast("long") + 1)),
    )
    return docs.join(spans, F.col("doc_id") == F.col(key), "left").withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(kept)).drop(name, key)
