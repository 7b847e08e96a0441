"""One pass over the corpus for what several operators need to know of all of it.

Per language label, the most frequent words; per source, the lines that come back in many documents.  Both are
mergeable heavy-hitter summaries (see ``lines``), so every task sends a bounded number of rows and none of the
corpus is left out.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import codes
from .lines import CANDIDATE, MIN_LETTERS, SUMMARY, LineKeys, _Index, _Summary, _summary_rows, by_source, key_text
from .util import bounded_rows, spread

COMMON_WORDS = 100
SOURCES = 20_000


def script_of(word: str) -> str:
    """Script of the first character of a word, in the codes of the table of languages (Jpan and Hans share Hani)."""
    c = ord(word[0])
    for script, spans in (("Grek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))), ("Cyrl", ((0x400, 0x52F),)), ("Arab", ((0x600, 0x77F),)), ("Deva", ((0x900, 0x97F),)), ("Thai", ((0xE00, 0xE7F),)), ("Hani", ((0x3040, 0x30FF), (0x3400, 0x9FFF)))):
        if any(a <= c <= b for a, b in spans):
            return script
    return "Latn"


def label_names(languages: list) -> dict[str, str]:
    """Each lower-case name of a language in the rows (lang, iso3, lang_name) to its lang."""
    return {str(n).lower(): r[0] for r in languages for n in (r[0], r[1], r[2]) if n and r[0]}


def label_language(label: str | None, names: dict[str, str]) -> str | None:
    """The language that a label names, with or without region suffix, or None."""
    if not label:
        return None
    low = label.strip().lower()
    return names.get(low) or names.get(low.replace("_", "-").split("-")[0])


@dataclass
class Profile:
    """common: per language the hashes of its most frequent words, most frequent first; notices: matcher of notice lines.

    many: the notice lines, where they are too many to be sent to every worker.
    """

    common: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, list[str]] = field(default_factory=dict)
    notices: _Index | None = None
    many: DataFrame | None = None

    def tables(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, sorted hashes of all common words, and which language has which."""
        langs = sorted(self.common)
        hashes = np.unique(np.concatenate([self.common[x] for x in langs])) if langs else np.zeros(0, np.uint64)
        has = np.zeros((len(hashes), len(langs)), bool)
        for k, x in enumerate(langs):
            has[np.searchsorted(hashes, self.common[x]), k] = True
        return langs, hashes, has

    def notice_lines(self, keys: LineKeys, sources: list) -> np.ndarray:
        """Which lines of the chunk are notices of their source."""
        index = self.notices
        out = np.zeros(len(keys.start), bool)
        if index is not None and len(index.keys):
            number = np.array([index.number.get(s, -1) for s in sources], np.int64)[keys.doc]
            pick = np.flatnonzero((number >= 0) & (keys.letters >= MIN_LETTERS // 2))
            out[pick] = codes.among(index.keys, index.salt(number[pick], keys.key[pick])) >= 0
            rest = pick[~out[pick]]
            s, e = keys.key_start[rest], keys.key_end[rest]
            probe = s[:, None] + np.arange(8) * np.maximum(e - s - 6, 0)[:, None] // 7
            ok = probe + 6 <= e[:, None]
            row = np.broadcast_to(np.arange(len(rest))[:, None], probe.shape)[ok]
            votes = np.bincount(row, codes.among(index.grams, index.salt(number[rest][row], codes.range_hash(keys.key_low, probe[ok], probe[ok] + 6))) >= 0, len(rest))
            out[rest[votes >= 4]] = True
        return out


def with_notices(rows: DataFrame, profile: Profile, run, schema: str) -> DataFrame:
    """run(profile, batch) over rows (source, ...): the notices are broadcast, or meet the rows by source where they are many."""
    if profile.many is None:
        shared = rows.sparkSession.sparkContext.broadcast(profile)  # a hundred words a language, a bounded number of notices
        return spread(rows).mapInArrow(lambda batches: (x for batch in batches for x in run(shared.value, batch)), schema)
    common, words = profile.common, profile.words
    return by_source(rows, profile.many, lambda index, batch: run(Profile(common, words, index), batch), schema)


def _scan(names: dict[str, str], with_words: bool, drop_share: float, min_letters: int):
    def rows_of(words, lines):
        for kind, by, share in (("w", words, 0.0), ("l", lines, drop_share)):
            rows = _summary_rows(by, share)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * rows.num_rows, pa.string()), *rows.columns], ["kind", "source", "key", "line", "n", "error"])

    def run(batches):
        words: dict[str, _Summary] = defaultdict(_Summary)
        lines: dict[str, _Summary] = defaultdict(_Summary)
        for batch in batches:
            texts, labels, sources = (batch.column(c).to_pylist() for c in ("text", "lang", "source"))
            langs = [label_language(x, names) or "" for x in labels]
            for part in codes.chunks(texts):
                keys = LineKeys(texts[part])
                own = np.array(langs[part] if with_words else [], object)
                tags, ids = np.unique(own, return_inverse=True)
                if with_words:
                    start, end = codes.units(keys.codes)
                    word = keys.codes.hashes(start, end)
                    lang = ids[np.searchsorted(keys.codes.end, start)]
                for g, tag in enumerate(tags):
                    if tag:
                        words[tag].docs += int((ids == g).sum())
                        mine = np.flatnonzero(lang == g)
                        k, first, n = np.unique(word[mine], return_index=True, return_counts=True)
                        often = n > 1  # a word met once in a chunk is far from the common ones; it counts as error
                        words[tag].error += 1
                        at = mine[first[often]]
                        text = np.array([keys.codes.joined[s:e].lower() for s, e in zip(start[at].tolist(), end[at].tolist())] + [None], object)[:-1]
                        words[tag].add(k[often], text, n[often])
                names_of, sid = np.unique(np.array([s or "" for s in sources[part]], object), return_inverse=True)
                for name, n in zip(names_of, np.bincount(sid)):
                    lines[name].docs += int(n)
                pick = keys.once_a_document(np.flatnonzero(keys.letters >= min_letters))
                raw = np.array(keys.codes.joined.split("\n")[:-1] + [None], object)[:-1]
                group = sid[keys.doc[pick]]
                order = np.argsort(group, kind="stable")
                edge = np.searchsorted(group[order], np.arange(len(names_of) + 1))
                for g, name in enumerate(names_of):
                    mine = pick[order[edge[g] : edge[g + 1]]]
                    lines[name].add(keys.key[mine], raw[mine])
            if len(lines) > SOURCES:  # a task with very many sources hands its summaries on
                yield from rows_of({}, lines)
                lines.clear()
        yield from rows_of(words, lines)

    return run


def corpus_profile(docs: DataFrame, languages: DataFrame, with_words: bool = True, notice_share: float = 0.03, common_words: int = COMMON_WORDS, most: int = 100_000) -> Profile:
    """The profile of all rows of docs (text, lang, source); labels are read by the rows of languages, a small fixed table."""
    known = languages.select("lang", "iso3", "lang_name", "script").collect()
    names = label_names(known)
    script = {r["lang"]: {"Hans": "Hani", "Hant": "Hani", "Jpan": "Hani"}.get(r["script"], r["script"]) for r in known}
    rows = spread(docs.where("text is not null").select("text", "lang", "source"))
    parts = rows.mapInArrow(_scan(names, with_words, notice_share / 4, MIN_LETTERS), f"kind string, {SUMMARY}").persist()
    size = parts.where("key is null").groupBy("kind", "source").agg(F.sum("n").alias("docs"), F.sum("error").alias("error"))
    merged = parts.where("key is not null").groupBy("kind", "source", "key").agg(F.sum("n").alias("n"), F.max("line").alias("line"))
    out = Profile()
    # the most frequent words of each label: a bounded number of rows for each language of a small table
    counts = merged.where("kind = 'w'").select("source", "key", "line", "n")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "key"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= common_words).collect()
    in_docs = {r["source"]: r["docs"] for r in size.where("kind = 'w'").collect()}
    by: dict[str, list] = defaultdict(list)
    for r in sorted(best, key=lambda r: r["rank"]):
        # one letter of an alphabet tells little: unreadable text is full of them
        if script.get(r["source"]) in (None, script_of(r["line"])) and (len(r["line"]) > 1 or script_of(r["line"]) in ("Hani", "Thai")):
            by[r["source"]].append((r["key"], r["line"], r["n"]))
    rate = {x: {k: n / sum(r[2] for r in own) for k, _, n in own} for x, own in by.items()}
    for lang in sorted(by, key=lambda x: -in_docs.get(x, 0)):
        # words of another, much larger language come from notices and wrong labels
        larger = [x for x in out.common if in_docs[x] > 2 * in_docs[lang]]
        keep = [(k, w) for k, w, _ in by[lang] if not any(rate[x].get(k, 0) > 1.3 * rate[lang][k] for x in larger)]
        own = np.array([k for k, _ in keep], np.int64).view(np.uint64)
        # and labels that name a language of which there is no text repeat them all
        if len(keep) < 5 or any(np.isin(own, out.common[x]).mean() > 0.4 for x in larger):
            continue
        out.common[lang], out.words[lang] = own, [w for _, w in keep]
    least = F.greatest(F.lit(4), F.col("docs") * notice_share)
    found = merged.where("kind = 'l'").join(size, ["kind", "source"]).where(F.col("n") + F.col("error") >= least).select("source", "key", "line", "n")
    heavy = bounded_rows(found, most)
    if heavy is None:

        def lines_of(batches):
            for batch in batches:
                keys = batch.column("key")
                yield pa.RecordBatch.from_arrays([batch.column("source"), keys, pa.array([key_text(x) for x in batch.column("line").to_pylist()], pa.string()), keys], ["source", "grp", "text", "key"])

        out.many = found.mapInArrow(lines_of, CANDIDATE)
    else:
        out.notices = _Index([(r[0], r[1], key_text(r[2]), r[1]) for r in heavy])
        parts.unpersist()
    return out
