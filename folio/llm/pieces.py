"""Problem 8: splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over WINDOW code points gives every position a rank that depends on the characters before it alone.
Between the minimum and the maximum size after its start a piece ends at the natural boundary of the lowest rank,
so an edit moves the cuts near it and the later ones fall back on the same places, in any script.  Only boundaries
of the best kind within reach compete: paragraph, line, sentence, word; a run without any is cut at the position of
the lowest rank.  Sizes are tokens of a public tokenizer; the next piece starts ``overlap`` tokens before the cut.

Defined results: NULL and empty texts give no piece; a text within the capacity gives one, the text itself; the
pieces without their overlaps joined in order give the text back; equal rows give equal pieces; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from .codes import Codes
from .tokens import FOLDER, VOCABULARY, encoding, token_bytes
from .util import spread

WINDOW = 24
#: Kinds of cut, from the end of the text to none.
KINDS = ("end", "paragraph", "line", "sentence", "word", "token")
#: Marks that end a sentence.
ENDS = ".!?…。！？।॥؟۔"
CLOSERS = "\"'”’»)]」』）"


def boundaries(c: Codes) -> np.ndarray:
    """For each position of the texts, how good a cut just before it is: 1 paragraph ... 4 word, 9 none."""
    n = len(c.cp)
    out = np.full(n + 1, 9, np.uint8)
    space = c.is_kind(codes.SPACE, codes.NEWLINE)
    back = np.concatenate(([False], space))  # the character before the position is white space
    ahead = np.concatenate((space, [True]))
    word = back & ~ahead
    out[word] = 4
    ender, closer = np.isin(c.cp, [ord(x) for x in ENDS]), np.isin(c.cp, [ord(x) for x in CLOSERS])
    wide = np.isin(c.cp, [ord(x) for x in "。！？"])
    out[1:][wide & ~np.concatenate((closer[1:], [False]))] = 3
    at = np.flatnonzero(word)
    gap = np.where(space, -1, np.arange(n))
    last = np.maximum.accumulate(gap)[at - 1]  # the last character before the white space
    ends = (last >= 0) & (ender[last] | closer[last] & ender[np.maximum(last - 1, 0)])
    out[at[ends]] = 3
    feeds = codes.counts_before(c.cp == 10)
    n_feeds = feeds[at] - feeds[np.maximum(last, -1) + 1]
    out[at[n_feeds == 1]] = 2
    formfeed = codes.counts_before(c.cp == 12)
    out[at[(n_feeds > 1) | (formfeed[at] > formfeed[last + 1])]] = 1
    return out


def ranks(c: Codes, size: int) -> np.ndarray:
    """Hash of the WINDOW code points before each of the positions 0 to size; the first ones come last."""
    out = np.full(size + 1, ~np.uint64(0))
    s = np.arange(max(0, size + 1 - WINDOW))
    out[WINDOW:] = codes.range_hash(c.cp, s, s + WINDOW)
    return out


def cuts(text: str, capacity: int, overlap: int, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, kind of cut at the end) of the pieces of text, in code points."""
    encode = encoding(folder, vocabulary).encode_ordinary
    ids = np.array(encode(text), np.int64)
    if len(ids) <= capacity:
        return [(0, len(text), len(ids), KINDS[0])]
    c = Codes([text])
    size = len(text)
    # tokens before each code point; a token may hold part of one, which then counts from its first byte
    bytes_at = np.zeros(size + 1, np.int64)
    cp = c.cp[:size]
    np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF), out=bytes_at[1:])
    token_at = np.concatenate(([0], np.cumsum(token_bytes(folder, vocabulary)[ids])))
    before = np.searchsorted(token_at, bytes_at, "left")  # tokens that begin before the position
    grade = boundaries(c)[: size + 1]
    most = capacity - overlap - 2  # two tokens for a cut within a token at either end
    least = max(1, most // 2)
    rank = ranks(c, size)
    natural = [np.flatnonzero(grade <= g) for g in (1, 2, 3, 4)]

    def choose(cut: int, room: int, least: int) -> tuple[int, int]:
        """Where a piece with new text from cut on ends, with at most room tokens of it, and the kind of that place."""
        low = int(np.searchsorted(before, before[cut] + min(least, room), "left"))
        high = int(np.searchsorted(before, before[cut] + room, "right")) - 1
        low = max(min(low, high), cut + 1)
        high = max(high, cut + 1)
        for g, places in enumerate(natural, 1):
            a, b = np.searchsorted(places, [low, high + 1])
            if b > a:
                return int(places[a + np.argmin(rank[places[a:b]])]), g
        return low + int(np.argmin(rank[low : high + 1])), 5

    out, cut, start = [], 0, 0
    while True:
        room = most + (overlap if start == cut else 0)
        while True:  # a piece tokenized by itself may differ by a token or two from its share of the text
            last = before[size] - before[cut] <= room
            end, kind = (size, 0) if last else choose(cut, int(room), least + (overlap if start == cut else 0))
            n = len(encode(text[start:end]))
            if n <= capacity or end - cut <= 1:
                break
            room = max(1, min(room, before[end] - before[cut]) - max(1, n - capacity))
        out.append((start, end, n, KINDS[kind]))
        if last:
            return out
        back = int(np.searchsorted(before, before[end] - overlap, "left")) if overlap else end
        cut, start = end, min(max(back, start + 1), end)


SCHEMA = "doc_id long, piece_no int, start long, end long, tokens long, cut string"


def split_texts(docs: DataFrame, capacity: int, overlap: int = 0, only_oversized: bool = False, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece_no, start, end, tokens, cut): the pieces of each text in code points.

    only_oversized leaves texts out that need no cut; no token is shorter than a byte, so texts of at most
    ``capacity`` bytes are told apart without tokenizing them.
    """
    if not 0 <= overlap < capacity - 2:
        raise ValueError("overlap must be from 0 to capacity - 3")
    rows = docs.where("text is not null and text != ''").select("doc_id", "text")
    if only_oversized:
        rows = rows.where(F.octet_length("text") > capacity)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                pieces = cuts(text, capacity, overlap, folder, vocabulary)
                if len(pieces) > 1 or not only_oversized:
                    out += [(doc, k, *p) for k, p in enumerate(pieces)]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], ["doc_id", "piece_no", "start", "end", "tokens", "cut"])

    return spread(rows).mapInArrow(run, SCHEMA)
