"""Problem 1: lines repeated across the documents of one source.

Two passes over the texts.  The first builds, per source and task, a mergeable heavy-hitter summary of line
keys (Misra-Gries counters with their error); summaries are merged by addition, and every key whose upper
bound reaches ``candidate_share`` of the source's documents is a candidate, so none above it is lost.  The
second pass finds, in every document, the lines that equal a candidate or are within a few misread characters
of it, and exact document counts decide which candidates are confirmed.

The key of a line is its letters in lower case, without one-letter words and month names: letter case, spacing,
marks, figures, dates and shelf letters do not change it.

Candidates of up to ``most_broadcast`` lines are broadcast; beyond that rows and candidates meet by source.

Defined results: a NULL source is no site, so its rows are never cases; NULL and empty texts have no lines but
count as documents of their source; a row that comes twice (same id) counts once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from .codes import Codes, among, counts_before, range_hash, runs
from .util import bounded_rows, fresh, spread

#: Names of the months in the languages of the texts.
MONTHS = """
january february march april may june july august september october november december
jan feb mar apr jun jul aug sept sep oct nov dec
januar februar märz mai juni juli oktober dezember
janvier février mars avril juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre
januari februari maart mei augustus
janeiro fevereiro março maio junho julho setembro outubro novembro dezembro
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
ιανουαρίου φεβρουαρίου μαρτίου απριλίου μαΐου ιουνίου ιουλίου αυγούστου σεπτεμβρίου οκτωβρίου νοεμβρίου δεκεμβρίου
""".split()

MIN_LETTERS = 24
COUNTERS = 4096


@cache
def _months() -> np.ndarray:
    return np.sort(codes.hash_words(sorted(set(MONTHS))))


class LineKeys:
    """Lines of a list of texts with the hash of their keys and their number of letters."""

    def __init__(self, texts: list[str | None]):
        c = self.codes = Codes(texts)
        self.start, self.end, self.doc, self.line_no = c.lines()
        letter = c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS)
        wordy = letter | c.is_kind(codes.MARK)
        n = counts_before(letter)
        self.letters = n[self.end] - n[self.start]
        s, e = runs(wordy)
        drop = (e - s < 2) | (among(_months(), c.hashes(s, e)) >= 0)
        edge = np.zeros(len(wordy) + 1, np.int8)
        edge[s[drop]] = 1
        edge[e[drop]] -= 1
        self.key_char = wordy & (np.cumsum(edge[:-1]) == 0)
        self.key_low = c.low[self.key_char]
        self.before = counts_before(self.key_char)
        self.key_start, self.key_end = self.before[self.start], self.before[self.end]
        self.key = range_hash(self.key_low, self.key_start, self.key_end)

    def text(self, k: int) -> str:
        return "".join(map(chr, self.key_low[self.key_start[k] : self.key_end[k]].tolist()))

    def once_a_document(self, pick: np.ndarray) -> np.ndarray:
        """The lines of pick without those whose key came earlier in the same document."""
        with np.errstate(over="ignore"):
            pair = self.key[pick] ^ ((self.doc[pick].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E6C63D0676A9A99))
        return pick[np.unique(pair, return_index=True)[1]]


def key_text(line: str) -> str:
    return LineKeys([line]).text(0)


def _undated(line: str) -> str:
    """The key of a line whose month names, next to a figure, may be misread."""
    line = re.sub(r"(?<=[^\W\d_])[^\w\s](?=[^\W\d_])", "", line)  # a speck within a word
    line = re.sub(r"(?<=[^\W\d_])\d(?=[^\W\d_])", "x", line)  # a letter read as a figure
    tokens = re.findall(r"[^\W\d_]+|\d+", line)

    def month(k: int) -> bool:
        near = tokens[max(0, k - 1) : k + 2 : 2] if k else tokens[1:2]
        w = tokens[k].lower()
        return len(w) > 2 and any(t.isdigit() for t in near) and any(edits(m, w, 2) <= min(2, len(m) // 3) for m in MONTHS)

    return key_text(" ".join(t for k, t in enumerate(tokens) if t.isdigit() or not month(k)))


class _Summary:
    """Misra-Gries counters of one source within one task, with a sample line of each key."""

    __slots__ = ("keys", "counts", "lines", "error", "docs", "pending")

    def __init__(self):
        self.keys, self.counts, self.lines = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)
        self.error = self.docs = 0
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, lines: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.pending.append((keys, lines, np.ones(len(keys), np.int64) if counts is None else counts))
        if sum(len(x[0]) for x in self.pending) > 4 * COUNTERS:
            self.settle()

    def settle(self) -> None:
        keys, lines, counts = (np.concatenate([own, *(x[k] for x in self.pending)]) for k, own in enumerate((self.keys, self.lines, self.counts)))
        self.pending = []
        self.keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        self.counts, self.lines = np.bincount(back, counts, len(self.keys)).astype(np.int64), lines[first]
        if len(self.keys) > COUNTERS:
            self.prune(int(np.partition(self.counts, -COUNTERS - 1)[-COUNTERS - 1]))

    def prune(self, cut: int) -> None:
        """Lowers every counter by cut, which becomes error; what falls to zero goes."""
        if cut > 0:
            self.error += cut
            self.counts = self.counts - cut
            keep = self.counts > 0
            self.keys, self.counts, self.lines = self.keys[keep], self.counts[keep], self.lines[keep]


SUMMARY = "source string, key long, line string, n long, error long"


def _summary_rows(by_source: dict[str, _Summary], drop_share: float):
    rows = []
    for name, s in by_source.items():
        s.settle()
        s.prune(int(drop_share * s.docs))
        rows.append((name, None, None, s.docs, s.error))
        rows += [(name, k, t, n, 0) for k, t, n in zip(s.keys.view(np.int64).tolist(), s.lines.tolist(), s.counts.tolist())]
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["source", "key", "line", "n", "error"])


def _summarise(min_letters: int, drop_share: float):
    def run(batches):
        by_source: dict[str, _Summary] = defaultdict(_Summary)
        for batch in batches:
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            for part in codes.chunks(texts):
                keys = LineKeys(texts[part])
                names, ids = np.unique(np.array(sources[part], object), return_inverse=True)
                for name, n in zip(names, np.bincount(ids)):
                    by_source[name].docs += int(n)
                pick = keys.once_a_document(np.flatnonzero(keys.letters >= min_letters))
                lines = np.array(keys.codes.joined.split("\n")[:-1] + [None], object)[:-1]
                group = ids[keys.doc[pick]]
                order = np.argsort(group, kind="stable")
                edge = np.searchsorted(group[order], np.arange(len(names) + 1))
                for g in range(len(names)):
                    mine = pick[order[edge[g] : edge[g + 1]]]
                    by_source[names[g]].add(keys.key[mine], lines[mine])
            if len(by_source) > 20_000:  # a task with very many sources hands its summaries on
                yield _summary_rows(by_source, drop_share)
                by_source.clear()
        yield _summary_rows(by_source, drop_share)

    return run


def line_candidates(docs: DataFrame, min_letters: int = MIN_LETTERS, candidate_share: float = 0.02) -> DataFrame:
    """(source, key, line, n): every key that stands in candidate_share of the documents of its source, and some below."""
    rows = spread(docs.where("source is not null").select("source", "text"))
    parts = rows.mapInArrow(_summarise(min_letters, candidate_share / 4), SUMMARY).persist()
    size = parts.where("key is null").groupBy("source").agg(F.sum("n").alias("docs"), F.sum("error").alias("error"))
    merged = parts.where("key is not null").groupBy("source", "key").agg(F.sum("n").alias("n"), F.max("line").alias("line"))
    least = F.greatest(F.lit(2), F.col("docs") * candidate_share)
    return merged.join(size, "source").where(F.col("n") + F.col("error") >= least).select("source", "key", "line", "n")


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance of a and b by bit-parallel columns; most + 1 stands for anything above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(a):
        peq[ch] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return min(score, most + 1)


def tolerance(n: int) -> int:
    """Misread characters allowed in a line of n letters."""
    return max(3, n // 9)


def group_candidates(rows: list[tuple[str, int, str, int]]) -> list[tuple[str, int, str, int]]:
    """(source, group, key text, key) of (source, key, line, n); variants of a heavier candidate join its group."""
    by: dict[str, list] = defaultdict(list)
    for source, key, line, n in rows:
        by[source].append((-n, key_text(line), key))
    out = []
    for source, own in by.items():
        heads: list[tuple[int, str]] = []
        for _, line, key in sorted(own):
            most = tolerance(len(line))
            head = next((h for h, t in heads if edits(t, line, most) <= most), None)
            if head is None:
                head = key
                heads.append((head, line))
            out.append((source, head, line, key))
    return out


class _Index:
    """The grouped candidates of some sources, ready to match the lines of a chunk."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.number = {s: k for k, s in enumerate(sorted({r[0] for r in rows}))}
        self.heads_of: dict[str, list[tuple[int, str]]] = defaultdict(list)
        number = np.array([self.number[r[0]] for r in rows], np.int64)
        salted = self.salt(number, np.array([r[3] for r in rows], np.int64).view(np.uint64))
        order = np.argsort(salted)
        self.keys, self.heads = salted[order], np.array([r[1] for r in rows], np.int64)[order]
        grams = set()
        for s, head, line, key in rows:
            if head == key:
                self.heads_of[s].append((head, line))
                grams |= {(self.number[s], line[k : k + 6]) for k in range(len(line) - 5)}
        grams = sorted(grams)
        self.grams = np.unique(self.salt(np.array([n for n, _ in grams], np.int64), codes.hash_words([g for _, g in grams])))
        self.known: dict[tuple[str, int], int | None] = {}

    @staticmethod
    def salt(number: np.ndarray, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return key ^ ((number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))

    def variant_of(self, source: str, key: int, text: str, line: str) -> int | None:
        """The group that the line with this key belongs to, if any."""
        if (source, key) not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[source, key] = self._nearest(source, text)
            if self.known[source, key] is None and any(ch.isdigit() for ch in line):
                self.known[source, key] = self._nearest(source, _undated(line))
        return self.known[source, key]

    def _nearest(self, source: str, text: str) -> int | None:
        near = ((edits(t, text, tolerance(len(t))), h, tolerance(len(t))) for h, t in self.heads_of[source])
        return min(((d, h) for d, h, most in near if d <= most), default=(0, None))[1]

    def match(self, ids: list, sources: list, texts: list, min_letters: int):
        """doc_id, source, line_no, group of the lines of a chunk that are variants of a candidate."""
        lines = LineKeys(texts)
        number = np.array([self.number.get(s, -1) for s in sources], np.int64)[lines.doc]
        pick = np.flatnonzero((lines.letters >= min_letters) & (number >= 0))
        at = among(self.keys, self.salt(number[pick], lines.key[pick]))
        found, head = [pick[at >= 0]], [self.heads[at[at >= 0]]]
        rest = pick[at < 0]
        # eight grams of six letters, evenly placed: a misread character spoils one or two of them
        s, e = lines.key_start[rest], lines.key_end[rest]
        probe = s[:, None] + np.arange(8) * np.maximum(e - s - 6, 0)[:, None] // 7
        ok = probe + 6 <= e[:, None]
        row = np.broadcast_to(np.arange(len(rest))[:, None], probe.shape)[ok]
        flat = probe[ok]
        votes = np.bincount(row, among(self.grams, self.salt(number[rest][row], range_hash(lines.key_low, flat, flat + 6))) >= 0, len(rest))
        for x in rest[votes >= 2].tolist():
            h = self.variant_of(sources[lines.doc[x]], int(lines.key[x]), lines.text(x), lines.codes.joined[lines.start[x] : lines.end[x]])
            if h is not None:
                found.append(np.array([x]))
                head.append(np.array([h], np.int64))
        found, head = np.concatenate(found), np.concatenate(head)
        doc = lines.doc[found].tolist()
        return [ids[k] for k in doc], [sources[k] for k in doc], lines.line_no[found], head


FOUND = "doc_id long, source string, line_no int, grp long"


def _find(min_letters: int):
    def run(index, batch):
        ids, sources, texts = (batch.column(c).to_pylist() for c in ("doc_id", "source", "text"))
        for part in codes.chunks(texts):
            d, s, n, h = index.match(ids[part], sources[part], texts[part], min_letters)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.string()), pa.array(n, pa.int32()), pa.array(h, pa.int64())], ["doc_id", "source", "line_no", "grp"])

    return run


CANDIDATE = "source string, grp long, text string, key long"
FLUSH_DOCS, FLUSH_LINES = 2_000, 20_000


def by_source(rows: DataFrame, candidates: DataFrame, run, schema: str) -> DataFrame:
    """run(index, batch) over rows (source, ...), with the index of the CANDIDATE rows of the sources in the batch.

    For more candidates than are broadcast: rows and candidates are brought together by source, the candidates of a
    source before its rows, and gone through as a stream.  A source with more rows than a task's share is spread over
    as many tasks as there are, each with the source's candidates, whose number a source's share of lines bounds.
    """
    spark = rows.sparkSession
    tasks = max(2, spark.sparkContext.defaultParallelism)
    sizes = rows.groupBy("source").agg(F.count("*").alias("_n"))
    hot = [r[0] for r in sizes.where(F.col("_n") * tasks > (sizes.agg(F.sum("_n")).first()[0] or 0)).select("source").collect()]  # fewer than tasks
    is_hot = F.col("source").isin(hot) if hot else F.lit(False)
    columns = rows.columns
    row = F.struct(*columns)
    kind = F.struct(*(F.col(c) for c in ("grp", "text", "key")))
    left = candidates.select("source", F.when(is_hot, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0))).alias("_salts"), kind.alias("_line")).select("source", F.explode("_salts").alias("_salt"), F.lit(0).alias("_kind"), "_line", F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    right = rows.select("source", F.when(is_hot, F.pmod(F.xxhash64(*columns), F.lit(tasks)).cast("int")).otherwise(F.lit(0)).alias("_salt"), F.lit(1).alias("_kind"), F.lit(None).cast(candidates.select(kind.alias("k")).schema["k"].dataType).alias("_line"), row.alias("_row"))
    both = left.unionByName(right).repartition("source", "_salt").sortWithinPartitions("source", "_salt", "_kind")

    def stream(batches):
        lines: dict[str, list] = {}
        docs: list[pa.RecordBatch] = []
        last = None

        def flush():
            table = pa.Table.from_batches(docs).combine_chunks().to_batches()
            index = _Index([(s, *x) for s, own in lines.items() for x in own])
            for batch in table:
                yield from run(index, batch)

        for batch in batches:
            kinds = batch.column("_kind").to_numpy()
            sources = batch.column("source").to_pylist()
            edges = [0, *(np.flatnonzero(np.diff(kinds) != 0) + 1).tolist(), len(kinds)]
            for a, b in zip(edges, edges[1:]):
                if kinds[a] == 0:
                    if sum(x.num_rows for x in docs) > FLUSH_DOCS or sum(map(len, lines.values())) > FLUSH_LINES:
                        if docs:
                            yield from flush()
                        docs, lines = [], {k: v for k, v in lines.items() if k == last}
                    for k, x in zip(sources[a:b], batch.column("_line").slice(a, b - a).to_pylist()):
                        if k != last and k not in lines:
                            lines[k] = []
                        last = k
                        lines[k].append((x["grp"], x["text"], x["key"]))
                else:
                    part = batch.column("_row").slice(a, b - a)
                    docs.append(pa.RecordBatch.from_arrays(part.flatten(), names=columns))
                    last = sources[b - 1]
                    if sum(x.num_rows for x in docs) > FLUSH_DOCS:
                        yield from flush()
                        docs, lines = [], {k: v for k, v in lines.items() if k == last}
        if docs:
            yield from flush()

    return both.select("source", "_kind", "_line", "_row").mapInArrow(stream, schema)


def with_index(rows: DataFrame, candidates: DataFrame | list, run, schema: str, most: int = 100_000) -> DataFrame:
    """run(index, batch) over rows, with CANDIDATE rows broadcast where there are at most ``most``, else by source."""
    small = candidates if isinstance(candidates, list) else bounded_rows(candidates, most)
    if small is None:
        return by_source(rows, candidates, run, schema)
    shared = rows.sparkSession.sparkContext.broadcast(_Index([tuple(r) for r in small]))
    return spread(rows).mapInArrow(lambda batches: (x for batch in batches for x in run(shared.value, batch)), schema)


def grouped(candidates: DataFrame) -> DataFrame:
    """CANDIDATE rows of (source, key, line, n); the candidates of a source are few, for each takes a share of its documents."""

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame(group_candidates(list(pdf[["source", "key", "line", "n"]].itertuples(index=False, name=None))), columns=["source", "grp", "text", "key"])

    return candidates.groupBy("source").applyInPandas(run, CANDIDATE)


def _confirmed(docs: DataFrame, share: float, min_docs: int, min_letters: int, candidate_share: float, most: int) -> tuple[DataFrame, DataFrame, DataFrame | list]:
    """Lines near a candidate (FOUND), the (source, grp) that are confirmed, and the candidates, as rows where they are few."""
    total = docs.where("source is not null").groupBy("source").agg(F.count_distinct("doc_id").alias("docs"))
    every = grouped(line_candidates(docs, min_letters, candidate_share))
    small = bounded_rows(every, most)
    candidates = every if small is None else small
    rows = docs.where("source is not null and text is not null").select("doc_id", "source", "text")
    found = with_index(rows, candidates, _find(min_letters), FOUND).persist()
    in_docs = found.groupBy("source", "grp").agg(F.count_distinct("doc_id").alias("n"))
    confirmed = in_docs.join(total, "source").where((F.col("n") >= min_docs) & (F.col("n") >= F.col("docs") * share)).select("source", "grp")
    return found, confirmed, candidates


def repeated_lines(docs: DataFrame, share: float = 0.08, min_docs: int = 4, min_letters: int = MIN_LETTERS, candidate_share: float = 0.02, most_broadcast: int = 100_000) -> DataFrame:
    """(doc_id, source, line_no, grp): lines that, with their variants, stand in share of the source's documents and in min_docs."""
    found, confirmed, _ = _confirmed(docs, share, min_docs, min_letters, candidate_share, most_broadcast)
    return found.join(confirmed, ["source", "grp"]).select("doc_id", "source", "line_no", "grp").dropDuplicates(["doc_id", "line_no"])


def without_repeated_lines(docs: DataFrame, share: float = 0.08, min_docs: int = 4, min_letters: int = MIN_LETTERS, candidate_share: float = 0.02, most_broadcast: int = 100_000) -> DataFrame:
    """docs with the repeated lines of their sources cut out of text; other columns, rows and NULLs stay as they are.

    The confirmed lines of all sources are broadcast and cut in one pass; texts are not shuffled.
    """
    found, confirmed, candidates = _confirmed(docs, share, min_docs, min_letters, candidate_share, most_broadcast)
    if isinstance(candidates, list):
        sure = {(r[0], r[1]) for r in confirmed.collect()}  # no more than there are candidates
        kept: DataFrame | list = [r for r in candidates if (r[0], r[1]) in sure]
        found.unpersist()
    else:
        kept = candidates.join(confirmed, ["source", "grp"]).select("source", "grp", "text", "key")
    at = docs.columns.index("text")

    def run(index, batch):
        sources, texts = batch.column("source").to_pylist(), batch.column("text").to_pylist()
        out = list(texts)
        for part in codes.chunks(texts):
            numbers = list(range(part.start, part.stop))
            cut = defaultdict(set)
            for k, _, line, _ in zip(*index.match(numbers, sources[part], texts[part], min_letters)):
                cut[k].add(int(line))
            for k, lines in cut.items():
                out[k] = "\n".join(x for n, x in enumerate(texts[k].split("\n")) if n not in lines)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return with_index(docs, kept, run, docs.schema)


def without_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """docs with the given (doc_id, line_no) lines cut out of text; other columns, rows and NULLs stay as they are."""
    key, cuts = fresh(docs, "_cut_doc"), fresh(docs, "_cut")
    cut = lines.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(cuts))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(cuts), i)), "\n")
    return docs.join(cut, F.col("doc_id") == F.col(key), "left").withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(kept)).drop(cuts, key)
