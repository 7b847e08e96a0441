"""Problem 3: the languages of a text and of its segments, by cross-parsing.

For each language a suffix automaton of running labelled text is built.  Every sentence is parsed as a whole, over its
words and spaces, against each automaton of its script into the fewest phrases, each the longest match from where the
last one ended; the language that needs the fewest phrases wins.  All sentences of a batch are parsed side by side, a
character of each at a time, by tables of the automata's moves.

A phrase costs about the same number of bits in every language, so languages of a script have odds of
exp(-rate * phrases); the rate is fitted on labelled pieces that the automata have not seen, and the winner's share of
the odds is the confidence.  Sentences that need more phrases a character than nearly all of those pieces are
unreadable and tell none.

The automata are fitted on a bounded sample: SAMPLE_DOCS distinct texts a label (the lowest hashes), SAMPLE_CHARS
characters of each.  Labels may be wrong: the sample's texts are told apart by the words of the other half of the
sample, and a label that fewer than LEAST_PURE of its texts agree with names no language of the corpus; a language that
several labels stand at bears the name that most distinct texts of the corpus have, whichever label's sample has more words.
Parsing, counts and notices cover whole texts of all rows.

Defined results: NULL and empty texts, and texts without a sentence of running text, have no language; a label
that names no known language names none; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import codes
from .codes import Codes, counts_before
from .lines import LineKeys, _Index
from .profile import Profile, corpus_profile, label_language, label_names, script_of, with_notices

SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
TEXT_CHARS = 20_000
#: Least share of a label's texts that are in its language, and texts it must have.
LEAST_PURE, LEAST_TEXTS = 0.1, 4
#: By how much, a word, a text must fit its own label's words better than those of a label with more texts to be in another
#: language. In samples of the test tables 0.3 of the texts of one language are beyond 0.46 at most, of two beyond 3.95 at least.
LEAST_GAIN = 1.0
#: Least confidence and characters for a sentence to tell a language.
LEAST_SURE = 0.9
LEAST_CHARS = 12
LANE = 512
#: Scripts as the parser tells them apart.
SCRIPTS = ("Latn", "Grek", "Cyrl", "Arab", "Deva", "Thai", "Hani")


class SuffixAutomaton:
    """The suffix automaton of a text: follows exactly the substrings of it."""

    SHIFT = 21

    def __init__(self, text: str):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for ch in map(ord, text):
            cur = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and ch not in step[p]:
                step[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = step[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and step[p].get(ch) == q:
                        step[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = {s << self.SHIFT | ch: t for s, row in enumerate(step) for ch, t in row.items()}
        self.states = len(step)

    def phrases(self, text: str) -> int:
        """Fewest pieces of the automaton's text that this one can be put together from; an unknown character is one."""
        move, state, n = self.next, 0, 0
        for ch in map(ord, text):
            to = move.get(state << self.SHIFT | ch) if state else None
            if to is None:
                n += 1
                to = move.get(ch, 0)
            state = to
        return n


class Moves:
    """The automata of one script as tables of moves; a state is its row, a row's absent moves are -1."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        alphabet = sorted({ch for t in texts.values() for ch in t if ch != " " and ord(ch) < 65536})
        self.width = len(alphabet) + 2  # 0 unknown, 1 space
        self.code = np.zeros(65537, np.uint16)
        self.code[[ord(ch) for ch in alphabet]] = np.arange(2, self.width)
        self.code[32] = 1
        self.roots, keys, to, base = [], [], [], 0
        for lang in self.langs:
            automaton = SuffixAutomaton(" " + texts[lang] + " ")
            move = np.array(list(automaton.next.items()), np.int64).reshape(-1, 2)
            state, ch = move[:, 0] >> automaton.SHIFT, move[:, 0] & ((1 << automaton.SHIFT) - 1)
            known = ch < 65536
            keys.append((base + state[known]) * self.width + self.code[ch[known]])
            to.append(base + move[known, 1])
            self.roots.append(base)
            base += automaton.states
        keys, to = np.concatenate(keys), np.concatenate(to)
        order = np.argsort(keys)
        self.keys, self.to, self.rows = keys[order], to[order].astype(np.int32), base
        self._table = self._start = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None, "_start": None}

    def move(self, key: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Where the state and character of key lead; ~to the state after ch alone where a new phrase begins.

        States are rows times width.
        """
        if self.rows * self.width <= 1 << 25:
            if self._table is None:
                first = self._first()
                self._table = np.empty((self.rows, self.width), np.int32)
                for k, (a, b) in enumerate(zip(self.roots, [*self.roots[1:], self.rows])):
                    self._table[a:b] = ~first[:, k]
                inner = ~np.isin(self.keys // self.width, self.roots)
                self._table = self._table.ravel()
                self._table[self.keys[inner]] = self.to[inner] * self.width
            return self._table.take(key)
        at = codes.among(self.keys, key.ravel()).reshape(key.shape)  # an alphabet of thousands: looked up
        inner = (at >= 0) & (key - ch != np.array(self.roots) * self.width)
        return np.where(inner, self.to[at].astype(np.int64) * self.width, ~self._first()[ch[:, 0]])

    def _first(self) -> np.ndarray:
        """The state after each character (rows) from the start of each language (columns)."""
        if self._start is None:
            roots = np.array(self.roots, np.int64)
            at = codes.among(self.keys, roots * self.width + np.arange(self.width)[:, None].astype(np.int64))
            self._start = np.where(at >= 0, self.to[at], roots) * self.width
        return self._start

    def phrases(self, stream: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Phrases of each stretch of the stream of codes (rows) in each language (columns)."""
        roots = np.array(self.roots, np.int64)
        # long stretches go in parts of LANE characters
        parts = np.maximum(1, -(-(end - start) // LANE))
        of = np.repeat(np.arange(len(start)), parts)
        begin = start[of] + LANE * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        size = np.minimum(end[of] - begin, LANE)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        n = np.zeros((len(of), len(roots)), np.int32)
        state = np.broadcast_to(roots * self.width, n.shape).copy()
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for t, m in enumerate(live.tolist()):
            ch = stream[begin[:m] + t].astype(np.int64)[:, None]
            to = self.move(state[:m] + ch, ch)
            new = to < 0
            n[:m] += new
            np.bitwise_xor(to, -new.astype(to.dtype), out=state[:m], casting="unsafe")
        out = np.zeros((len(start), len(roots)), np.int64)
        np.add.at(out, of[order], n)
        return out


def stream_of(c: Codes, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the characters that are parsed, letters and the first character of what parts two words, and which are letters.

    A word broken by a hyphen at a line's end is one word; scripts without spaces have no parting characters.
    """
    letter = c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK) & keep
    before, after = np.concatenate(([False], letter[:-1])), np.concatenate((letter[1:], [False]))
    tight = codes.unspaced(c.cp)
    part = ~letter & before & ~np.concatenate(([False], tight[:-1]))
    hyphen = part & c.within("-\u00ad\u2010")
    hyphen[:-1] &= c.cp[1:] == 10
    line = np.concatenate(([False], hyphen[:-1])) & np.concatenate(((c.kind == codes.LOWER)[1:], [False])) & after
    hyphen[:-1] &= line[1:]
    at = np.flatnonzero(letter | part & ~hyphen)
    return at, letter[at]


class Parser:
    """The automata of all languages, with the rate of their odds and the most phrases a character of readable text."""

    def __init__(self, texts: dict[str, str], names: dict[str, str], rate: float = 1.0, most: dict[str, float] | None = None):
        self.langs, self.names, self.rate = sorted(texts), names, rate
        self.number = {x: k for k, x in enumerate(self.langs)}
        by: dict[str, dict[str, str]] = defaultdict(dict)
        for x, t in texts.items():
            by[_script(t)][x] = t
        self.moves = {script: Moves(own) for script, own in by.items()}
        self.most = np.array([(most or {}).get(x, 0.4) for x in self.langs])

    def parse(self, c: Codes, keep: np.ndarray, of_char: np.ndarray, n: int):
        """Characters and script of n stretches, their phrases by language (infinite where the script is another)."""
        at, letter = stream_of(c, keep)
        of = of_char[at]
        spaced = np.where(letter, np.minimum(c.low[at], 65536), 32)
        chars = np.bincount(of, minlength=n)
        edge = np.concatenate(([0], np.cumsum(chars)))
        kinds = script_codes()[spaced]
        script = np.bincount(of * 8 + np.minimum(kinds, 7), minlength=8 * n).reshape(n, 8)[:, :7].argmax(1) if n else np.zeros(0, int)
        phrases = np.full((n, len(self.langs)), np.inf)
        for k, name in enumerate(SCRIPTS):
            moves = self.moves.get(name)
            pick = np.flatnonzero((script == k) & (chars > 0))
            if moves is None or not len(pick):
                continue
            got = moves.phrases(moves.code[spaced], edge[pick], edge[pick + 1])
            phrases[np.ix_(pick, [self.number[x] for x in moves.langs])] = got
        return chars, phrases

    def decide(self, chars: np.ndarray, phrases: np.ndarray):
        """Best language of each stretch (-1 where it is not to be told) and its confidence."""
        if not len(self.langs):
            return np.full(len(chars), -1), np.zeros(len(chars))
        best = phrases.argmin(1)
        least = phrases.min(1)
        with np.errstate(invalid="ignore", over="ignore"):
            odds = np.exp(-self.rate * (phrases - least[:, None]))
        odds[~np.isfinite(phrases)] = 0.0
        # unreadable text would need a phrase for every other character in any language
        none = np.exp(-self.rate * np.clip(np.maximum(0.5 * chars, 1) - least, -50, 50))
        sure = np.where(np.isfinite(least), 1 / np.maximum(odds.sum(1) + none, 1e-9), 0.0)
        known = (chars >= LEAST_CHARS) & np.isfinite(least) & (least <= self.most[best] * chars) & (sure >= LEAST_SURE)
        return np.where(known, best, -1), np.where(known, sure, 0.0)


def script_codes() -> np.ndarray:
    """Number of the script of each code point of the basic plane; not a letter: none."""
    global _SCRIPT_OF
    if _SCRIPT_OF is None:
        kinds, _ = codes.tables()
        letters = np.flatnonzero(np.isin(kinds, (codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK)))
        table = np.full(65537, 99, np.uint8)
        table[letters[letters < 65536]] = [SCRIPTS.index(script_of(chr(x))) for x in letters[letters < 65536].tolist()]
        _SCRIPT_OF = table
    return _SCRIPT_OF


_SCRIPT_OF: np.ndarray | None = None


def _script(text: str) -> str:
    low = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return SCRIPTS[int(np.bincount(script_codes()[np.minimum(low, 65536)], minlength=100)[: len(SCRIPTS)].argmax())]


def sentence_breaks(c: Codes, lines: LineKeys) -> tuple[np.ndarray, np.ndarray]:
    """Positions just after which a sentence ends, and whether a mark ended it (else an empty line or the text's end)."""
    n = len(c.cp)
    final = c.within(".!?…。！？।؟۔")
    wide = c.within("。！？।؟")
    closer = c.within("\"'”’»)]」』）“‘")
    space = c.is_kind(codes.SPACE, codes.NEWLINE)
    visible = np.flatnonzero(~space & (c.kind != codes.FORMAT))
    at = np.flatnonzero(final)
    # over closing marks
    stop = np.flatnonzero(~closer)
    nxt = stop[np.minimum(np.searchsorted(stop, at + 1), len(stop) - 1)]
    after = visible[np.minimum(np.searchsorted(visible, nxt), len(visible) - 1)] if len(visible) else nxt
    kind = c.kind[after]
    gap = space[np.minimum(nxt, n - 1)]
    starts = (kind == codes.UPPER) | (kind == codes.CASELESS) | (kind == codes.DIGIT) | (kind == codes.PUNCT)
    ok = gap & (starts | (after <= at)) | wide[at]
    # an initial, or a short capitalised word with a full stop, is an abbreviation
    w = c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK)
    ws, we = codes.runs(w)
    last = np.searchsorted(we, at, "right") - 1
    touching = (last >= 0) & (we[np.maximum(last, 0)] == at)
    size = np.where(touching, we[np.maximum(last, 0)] - ws[np.maximum(last, 0)], 99)
    cap = c.kind[ws[np.maximum(last, 0)]] == codes.UPPER if len(ws) else np.zeros(len(at), bool)
    ok &= ~((c.cp[at] == ord(".")) & touching & ((size == 1) | (size <= 3) & cap))
    # Thai ends its sentences with a space
    thai = (c.cp >= 0x0E00) & (c.cp < 0x0E80)
    blank = np.flatnonzero((c.cp == 32)[1:-1] & thai[:-2] & thai[2:]) + 1
    # empty lines and the ends of texts
    solid = counts_before(~space)
    empty = solid[lines.end] == solid[lines.start]
    hard = np.concatenate((lines.start[empty], c.end))
    pos = np.concatenate((nxt[ok], blank, hard))
    marked = np.concatenate((np.ones(ok.sum() + len(blank), bool), np.zeros(len(hard), bool)))
    order = np.lexsort((~marked, pos))
    pos, marked = pos[order], marked[order]
    first = np.concatenate(([True], pos[1:] != pos[:-1]))
    return pos[first], marked[first]


def _verse(c: Codes, lines: LineKeys, use: np.ndarray) -> np.ndarray:
    """Lines of stanzas: short lines that begin anew, or all end in a mark."""
    space = c.is_kind(codes.SPACE, codes.NEWLINE, codes.FORMAT)
    visible = np.flatnonzero(~space)
    if not len(visible):
        return np.zeros(len(lines.start), bool)
    solid = counts_before(~space)
    full = (solid[lines.end] > solid[lines.start]) & use
    first = visible[np.minimum(np.searchsorted(visible, lines.start), len(visible) - 1)]
    last = visible[np.maximum(np.searchsorted(visible, lines.end) - 1, 0)]
    upper, mark = c.kind[first] == codes.UPPER, c.kind[last] == codes.PUNCT
    caseless = c.kind[first] == codes.CASELESS
    short = lines.end - lines.start < 64
    # groups between empty lines, notices aside
    blank = (solid[lines.end] == solid[lines.start]) | np.concatenate(([True], lines.doc[1:] != lines.doc[:-1]))
    group = np.cumsum(blank)
    size = np.bincount(group, full)
    anew = np.bincount(group, full & short & upper)
    ended = np.bincount(group, full & short & caseless & mark)
    g = (size >= 3) & ((anew >= 0.8 * size) | (ended >= 0.8 * size))
    # two short lines may be a stanza of a poem: then the rest of it is one
    return g[group]


def sentences(parser: Parser, profile: Profile, texts: list, sources: list):
    """text index, start, end, language index (-1 unknown), confidence, and whether it is running text (2; 1 as a line by itself) of every sentence of a chunk."""
    lines = LineKeys(texts)
    c = lines.codes
    notice = profile.notice_lines(lines, sources)
    pos, marked = sentence_breaks(c, lines)
    doc = np.searchsorted(c.end, pos, "left")
    begin = np.maximum(np.concatenate(([0], pos[:-1])), c.start[doc])
    n = len(pos)
    verse = _verse(c, lines, ~notice)
    start, end = codes.units(c)
    line = np.searchsorted(lines.end, start)
    good = ~notice[line]
    start, end, line = start[good], end[good], line[good]
    of_line = np.zeros(len(c.cp) + 1, np.int32)
    of_line[lines.end + 1] = 1
    of_line = np.cumsum(of_line)[:-1]
    of_char = np.zeros(len(c.cp) + 1, np.int32)
    np.add.at(of_char, pos, 1)
    of_char = np.minimum(np.cumsum(of_char)[:-1], max(n - 1, 0))
    chars, phrases = parser.parse(c, ~notice[of_line], of_char, n)
    best, sure = parser.decide(chars, phrases)
    of = of_char[start]
    size = np.bincount(of, end - start, n)
    words = np.bincount(of, minlength=n)
    poem = np.bincount(of, verse[line] * (end - start), n)
    thai = np.bincount(of, (c.cp[start] >= 0x0E00) & (c.cp[start] < 0x0E80), n) > 0.5 * words  # has no marks at the end of a text either
    # a sentence that is a line by itself may be a notice or a heading
    on_line = np.bincount(line, minlength=len(lines.start))
    first_line, last_line = np.full(n, -1), np.full(n, -2)
    last_line[of] = line
    first_line[of[::-1]] = line[::-1]
    alone = (first_line == last_line) & (words == on_line[np.maximum(first_line, 0)]) & (size < 80)
    running = np.where((best >= 0) & (marked | thai) & (poem < 0.5 * size) & (words >= 2), np.where(alone, 1, 2), 0)
    return doc, begin, pos, best, sure, running


def labelled_sample(docs: DataFrame, names: dict[str, str], most: int = SAMPLE_DOCS) -> tuple[list[tuple[str, str, str]], dict[str, int]]:
    """(language that the label names, source, text) of at most ``most`` distinct texts a label, in order of their hashes; and how many distinct texts of the corpus have each label."""
    low = F.lower(F.trim("lang"))
    lookup = F.create_map(*(x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v)))) if names else F.create_map()
    named = F.coalesce(lookup[low], lookup[F.split(low, "[-_]")[0]])
    rows = docs.where("text is not null and text != '' and lang is not null").select("doc_id", "text", "source", named.alias("named")).where("named is not null")
    distinct = rows.groupBy("named", F.xxhash64("text").alias("hash")).agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    rank = F.row_number().over(Window.partitionBy("named").orderBy("hash"))
    sizes = distinct.groupBy("named").agg(F.count("*").alias("texts"))
    picked = distinct.withColumn("rank", rank).where(F.col("rank") <= most).join(F.broadcast(sizes), "named").select("named", "hash", "doc_id", "texts")  # a bounded number a language of a small table
    found = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(picked), ["named", "hash", "doc_id"]).select("named", "hash", "source", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "texts").dropDuplicates(["named", "hash"])
    got = sorted(found.collect(), key=lambda r: (r[0], r[1]))
    return [(r[0], r[2], r[3]) for r in got], {r[0]: r[4] for r in got}


class _Sample:
    """The lines of the sample's texts with the language that their words are of."""

    def __init__(self, sample: list[tuple[str, str, str]], profile: Profile, scripts: dict[str, str], texts: dict[str, int]):
        self.label = np.array([x for x, _, _ in sample], object)
        self.lines = LineKeys([t for _, _, t in sample])
        c = self.lines.codes
        notice = profile.notice_lines(self.lines, [s for _, s, _ in sample])
        start, end = codes.units(c)
        line = np.searchsorted(self.lines.end, start)
        kinds = script_codes()[np.minimum(c.low[start], 65536)]
        good = ~notice[line] & (kinds < len(SCRIPTS))
        start, end, line, self.kind = start[good], end[good], line[good], kinds[good]
        self.line, self.doc = line, self.lines.doc[line]
        _, self.word = np.unique(c.hashes(start, end), return_inverse=True)
        self.half = np.arange(len(sample)) % 2
        self.scripts, self.texts = scripts, texts

    def _logs(self, use: np.ndarray, langs: list[str]) -> np.ndarray:
        """Log share of each word in each language, from the texts in use."""
        v = self.word.max(initial=-1) + 1
        label = np.array([langs.index(x) if x in langs else -1 for x in self.label], int)
        out = np.zeros((len(langs), v))
        pick = use[self.doc] & (label[self.doc] >= 0)
        np.add.at(out, (label[self.doc[pick]], self.word[pick]), 1)
        common = np.bincount(self.word[use[self.doc]], minlength=v).astype(float)
        common = 0.5 * common / max(common.sum(), 1) + 0.5 / max(v, 1)
        return np.log((out + 20 * common) / (out.sum(1, keepdims=True) + 20))

    def _scores(self, of: np.ndarray, n: int, logs: dict[int, np.ndarray], langs: list[str]) -> np.ndarray:
        """Score of each text or line (the numbers ``of`` of its words) in each language, by the words of the other half."""
        half = self.half[self.doc]
        out = np.zeros((n, len(langs)))
        for k in range(len(langs)):
            own = self.kind == SCRIPTS.index(self.scripts.get(langs[k], "Latn"))
            out[:, k] = np.bincount(of, np.where(own, np.where(half == 0, logs[1][k][self.word], logs[0][k][self.word]), -25.0), n)
        return out

    def split(self) -> dict[str, list[tuple[int, str]]]:
        """Per language the stretches of running text of its texts, each with its half."""
        m = len(self.label)
        words = np.bincount(self.doc, minlength=m)
        some = words > 0

        def told(use, langs):  # score of each text in each language
            logs = {h: self._logs(use & (self.half == h) & np.isin(self.label, langs), langs) for h in (0, 1)}
            return self._scores(self.doc, m, logs, langs)

        # do enough of a label's texts fit their own words better than those of all others? Labels come by their number of texts,
        # and what is in doubt between two is for the one that comes first: a rarer label never takes a language's name away
        def agree(scores, k, langs):
            own = np.flatnonzero(some & (self.label == langs[k]))
            ahead = np.where(np.arange(len(langs)) < k, LEAST_GAIN, -LEAST_GAIN)
            rest = np.delete(scores[own] + ahead * words[own, None], k, 1).max(1, initial=-np.inf)
            return (scores[own, k] > rest).sum() >= max(LEAST_TEXTS, LEAST_PURE * len(own))

        def of_label(scores, langs):  # the texts that fit their own label best
            return some & (np.array(langs, object)[scores.argmax(1)] == self.label)

        # of labels whose texts are in one language, the one that most texts of the corpus have names it: labels go by their
        # number of texts, and those that rather fit one before are for texts of other languages, which it is cleared of by then
        use, langs = some, []
        for x in sorted(set(self.label.tolist()), key=lambda x: (-self.texts[x], x)):
            now = [*langs, x]
            scores = told(use | some & (self.label == x), now)
            if agree(scores, len(langs), now):
                langs, use = now, of_label(scores, now)
        for _ in range(2):
            if not langs:
                break
            scores = told(use, langs)
            taken = [k for k in range(len(langs)) if agree(scores, k, langs)]
            langs = [langs[k] for k in taken]
            if langs:
                use = of_label(scores[:, taken], langs)
        if not langs:
            return {}
        logs = {h: self._logs(use & (self.half == h) & np.isin(self.label, langs), langs) for h in (0, 1)}
        m = len(self.lines.start)
        best = self._scores(self.line, m, logs, langs).argmax(1)
        words = np.bincount(self.line, minlength=m)
        out: dict[str, list[tuple[int, str]]] = {}
        c = self.lines.codes
        for k, x in enumerate(langs):
            good = use[self.lines.doc] & (self.label[self.lines.doc] == x) & (best == k) & (words >= 4)
            for d in np.unique(self.lines.doc[good]).tolist():
                # lines that follow each other are one stretch
                own = np.flatnonzero(good & (self.lines.doc == d))
                for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                    at = slice(int(self.lines.start[run[0]]), int(self.lines.end[run[-1]]))
                    out.setdefault(x, []).append((int(self.half[d]), c.joined[at]))
        return out


def _plain(texts: list[str]) -> list[str]:
    """Texts as the parser sees them."""
    c = Codes(texts)
    at, letters = stream_of(c, c.kind != codes.OTHER)
    seen = np.where(letters, c.low[at], 32).astype(np.uint32).tobytes().decode("utf-32-le")
    edge = np.searchsorted(at, np.concatenate((c.start, c.end[-1:] + 1)))
    return [seen[a:b].strip() for a, b in zip(edge.tolist(), edge[1:].tolist())]


def _fit(stretches: dict[str, list[tuple[int, str]]], names: dict[str, str]) -> Parser:
    texts: dict[int, dict[str, str]] = {0: {}, 2: {}}
    unseen: list[tuple[str, str]] = []
    for lang, own in stretches.items():
        plain = [(h, t) for (h, _), t in zip(own, _plain([x for _, x in own])) if len(t) >= LEAST_CHARS]
        for name, pick, most in ((0, [t for h, t in plain if h == 0], TEXT_CHARS // 2), (2, [t for _, t in plain], TEXT_CHARS)):
            # a share of every stretch, so that many texts are in it
            share = max(200, most // max(len(pick), 1))
            texts[name][lang] = " ".join(t[:share] for t in pick)[:most]
        unseen += [(lang, t) for h, t in plain if h == 1]
    texts[0] = {x: t for x, t in texts[0].items() if t}
    texts[2] = {x: t for x, t in texts[2].items() if t}
    # the rate of the odds and the most phrases, on what the automata of one half have not seen
    half = Parser(texts[0], names)
    pieces = [(lang, t[k : k + n]) for lang, t in unseen if lang in texts[0] for k, n in ((0, 24), (30, 60), (100, 200)) if len(t) >= k + n]
    if not pieces:
        return Parser(texts[2], names)
    c = Codes([t for _, t in pieces])
    of = np.minimum(np.searchsorted(c.end, np.arange(len(c.cp))), len(pieces) - 1)
    chars, phrases = half.parse(c, np.ones(len(c.cp), bool), of, len(pieces))
    true = np.array([half.number[x] for x, _ in pieces])
    ok = np.isfinite(phrases[np.arange(len(true)), true])
    gap = phrases[ok] - phrases[ok][np.arange(ok.sum()), true[ok]][:, None]
    rates = np.geomspace(0.05, 4, 40)
    with np.errstate(over="ignore"):
        fits = [np.log(np.exp(-np.clip(r * gap, -60, 60)) @ np.ones(gap.shape[1])).mean() if len(gap) else 0.0 for r in rates]
    share = phrases[np.arange(len(true)), true] / np.maximum(chars, 1)
    most = {x: float(np.clip(1.3 * np.quantile(share[ok & (true == k)], 0.99), 0.25, 0.45)) for x, k in half.number.items() if (ok & (true == k)).sum() >= 20}
    rate = rates[np.flatnonzero(np.array(fits) <= min(fits) + 0.01)[0]]  # the most careful of those that fit
    return Parser(texts[2], names, float(rate), most)


def language_parser(docs: DataFrame, languages: DataFrame, profile: Profile) -> Parser:
    """The parser of the languages of a small table that the labels of docs name."""
    rows = languages.select("lang", "iso3", "lang_name", "script").collect()
    names = label_names(rows)
    scripts = {r["lang"]: {"Hans": "Hani", "Hant": "Hani", "Jpan": "Hani"}.get(r["script"], r["script"]) for r in rows}
    sample, texts = labelled_sample(docs, names)
    if profile.many is not None:  # the notices of the sample's sources, each of which has a bounded number
        own = docs.sparkSession.createDataFrame(sorted({(x,) for _, x, _ in sample if x}), "source string")
        profile = Profile(notices=_Index([tuple(r) for r in profile.many.join(F.broadcast(own), "source").select("source", "grp", "text", "key").collect()]))
    return _fit(_Sample(sample, profile, scripts, texts).split(), names) if sample else Parser({}, names)


SEGMENTS = "doc_id long, segment int, start long, end long, sentences int, running int, lang string, confidence double, label string"


def language_segments(docs: DataFrame, languages: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """(doc_id, segment, start, end, sentences, running, lang, confidence, label) of every text.

    A segment is a run of sentences in one language; sentences that tell none go with those before them.
    ``running`` is the longest run of sentences of running text in it, ``label`` what the document's label names.
    """
    profile = corpus_profile(docs, languages, with_words=False, most=most_broadcast)
    shared = docs.sparkSession.sparkContext.broadcast(language_parser(docs, languages, profile))  # bounded texts of the languages of a small table

    def run(profile, batch):
        parser = shared.value
        ids, texts, sources, labels = (batch.column(c).to_pylist() for c in ("doc_id", "text", "source", "lang"))
        for part in codes.chunks(texts):
            own, label = ids[part], labels[part]
            doc, start, end, lang, sure, running = sentences(parser, profile, texts[part], sources[part])
            first = Codes(texts[part]).start
            rows, last = [], None
            for d, s, e, k, m, r in zip(doc.tolist(), start.tolist(), end.tolist(), lang.tolist(), sure.tolist(), running.tolist()):
                if last is None or last[0] != d or k >= 0 and last[3] >= 0 and last[3] != k:
                    last = [d, s, e, k, 0, 0, 0, 0.0, 0, False]
                    rows.append(last)
                last[2] = e
                if k >= 0:
                    last[3] = k
                    last[7] += m * (e - s)
                    last[8] += e - s
                last[4] += 1
                if r:
                    last[5] += 1
                    last[9] |= r > 1
                    last[6] = max(last[6], last[5] if last[9] else 1)
                elif k >= 0:
                    last[5], last[9] = 0, False
            out, number = [], {}
            for d, s, e, k, n, _, longest, m, count, _ in rows:
                if k >= 0:
                    no = number[d] = number.get(d, -1) + 1
                    named = label_language(label[d], parser.names)
                    out.append((own[d], no, max(0, s - int(first[d])), e - int(first[d]), n, longest, parser.langs[k], m / count, named))
            cols = list(zip(*out)) or [()] * 9
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["doc_id", "segment", "start", "end", "sentences", "running", "lang", "confidence", "label"])

    return with_notices(docs.select("doc_id", "text", "source", "lang"), profile, run, SEGMENTS)


def unnamed_languages(segments: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, lang): languages with least consecutive sentences of running text that the label does not name."""
    return segments.where((F.col("running") >= least) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))).select("doc_id", "lang").distinct()


def document_languages(segments: DataFrame) -> DataFrame:
    """(doc_id, lang, share, confidence, languages): the language of most of each document's characters.

    share is its part of the characters that tell a language, confidence that of its segments weighted by length;
    documents without such a segment have no row.
    """
    size = (F.col("end") - F.col("start")).cast("double")
    own = segments.groupBy("doc_id", "lang").agg(F.sum(size).alias("size"), (F.sum(size * F.col("confidence")) / F.sum(size)).alias("confidence"))
    most = F.max_by(F.struct("lang", "size", "confidence"), F.struct("size", "lang"))
    total = own.groupBy("doc_id").agg(most.alias("m"), F.sum("size").alias("all"), F.count("*").cast("int").alias("languages"))
    return total.select("doc_id", F.col("m.lang").alias("lang"), (F.col("m.size") / F.col("all")).alias("share"), F.col("m.confidence").alias("confidence"), "languages")
