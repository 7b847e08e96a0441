"""Problem 4: statistics of each text, and how far they lie from running prose of its language.

The statistics of a document leave the notices of its source aside.  Per language a robust centre and covariance
of all of them is found by concentration steps: from medians and absolute deviations, the documents within a
chi-square limit give the next mean and covariance, which are sums over the whole corpus.  The squared
Mahalanobis distance d' S^-1 d splits into one term per statistic, d_j (S^-1 d)_j, its contribution.

Defined results: NULL and empty texts, and texts of nothing but notices, have NULL statistics and distance and
are no cases; a NULL confidence counts as its language's centre; the centre and
covariance of a language lean on those of all languages, as PRIOR_DOCS texts would; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes
from .lines import LineKeys
from .profile import Profile, corpus_profile, label_language, label_names, with_notices

STATS = ("words", "word_length", "symbols", "digits", "line_ends", "common", "fresh_lines", "capitals", "line_words", "bullets", "confidence")
P = len(STATS)
#: Wilson-Hilferty chi-square quantiles of P degrees of freedom: within the first a text takes part in the next centre, above the second it is an outlier.
_LIMIT = P * (1 - 2 / (9 * P) + 1.96 * (2 / (9 * P)) ** 0.5) ** 3
_OUTLIER = P * (1 - 2 / (9 * P) + 2.326 * (2 / (9 * P)) ** 0.5) ** 3
#: Texts that the centre and covariance of all languages count for beside a language's own.
PRIOR_DOCS = 60
SCHEMA = "doc_id long, language string, " + ", ".join(f"{s} double" for s in STATS)


def text_stats(texts: list, sources: list, labels: list, confidence: list, profile: Profile, names: dict[str, str]):
    """Language and statistics (rows of STATS, NaN where unknown) of every text of a chunk."""
    lines = LineKeys(texts)
    c, n = lines.codes, len(texts)
    notice = profile.notice_lines(lines, sources)
    count = {k: codes.counts_before(m) for k, m in {
        "letter": c.is_kind(codes.LOWER, codes.UPPER, codes.CASELESS, codes.MARK),
        "digit": c.kind == codes.DIGIT,
        "symbol": c.is_kind(codes.PUNCT, codes.OTHER),
        "space": c.is_kind(codes.SPACE, codes.NEWLINE, codes.FORMAT),
    }.items()}
    of = {k: v[lines.end] - v[lines.start] for k, v in count.items()}
    solid = lines.end - lines.start - of["space"]
    use = (solid > 0) & ~notice
    doc = lines.doc[use]

    def per_doc(x, where=doc):
        return np.bincount(where, x, n).astype(float)

    chars, rows = per_doc(solid[use]), per_doc(np.ones(use.sum()))
    start, end = codes.units(c)
    line_of = np.searchsorted(lines.end, start)
    keep = use[line_of]
    start, end, unit_doc = start[keep], end[keep], lines.doc[line_of[keep]]
    units = np.bincount(unit_doc, minlength=n).astype(float)
    langs, hashes, has = profile.tables()
    at = codes.among(hashes, c.hashes(start, end))
    hit = np.flatnonzero(at >= 0)
    common = np.zeros((n, len(langs)))
    for k in range(len(langs)):
        common[:, k] = np.bincount(unit_doc[hit], has[at[hit], k], n)
    label = np.array([langs.index(x) if (x := label_language(v, names)) in langs else -1 for v in labels], int)
    best = common.argmax(1) if langs else np.zeros(n, int)
    top = common.max(1, initial=0)
    same = (label >= 0) & (common[np.arange(n), label] >= 0.9 * top) if langs else np.zeros(n, bool)
    best = np.where(same | (top < 0.2 * units), label, best)  # few common words do not tell a language
    # first and last visible character of each line
    visible = np.flatnonzero(~c.is_kind(codes.SPACE, codes.NEWLINE, codes.FORMAT))
    first = visible[np.searchsorted(visible, lines.start[use]).clip(max=max(len(visible) - 1, 0))] if len(visible) else np.zeros(0, int)
    last = visible[np.searchsorted(visible, lines.end[use]) - 1] if len(visible) else np.zeros(0, int)
    fk, lk = c.kind[first], c.kind[last]
    ends = lk == codes.PUNCT
    lower_or_caseless = (fk == codes.LOWER) | (fk == codes.CASELESS) | (fk == codes.MARK)
    opener = np.isin(c.cp[first], [ord(x) for x in "\"'“‘«„»「『([—¿¡"])
    bullet = (fk == codes.DIGIT) | ((fk == codes.PUNCT) | (fk == codes.OTHER)) & ~opener
    fresh = np.zeros(len(doc), bool)
    if len(doc) > 1:
        # a line that just stops, before one that starts anew; the last line goes with the one before it
        after = np.concatenate((doc[1:] == doc[:-1], [False]))
        fresh[:-1] = after[:-1] & ~ends[:-1] & ~lower_or_caseless[1:]
        fresh[1:] |= ~after[1:] & (doc[1:] == doc[:-1]) & ~ends[1:] & fresh[:-1]
    caps = c.kind[start] == codes.UPPER
    cased = caps | (c.kind[start] == codes.LOWER)
    out = np.full((n, P), np.nan)
    some = (units > 0) | (chars > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        u, ch, r = np.maximum(units, 1), np.maximum(chars, 1), np.maximum(rows, 1)
        stats = (np.log1p(units), per_doc(of["letter"][use]) / u, per_doc(of["symbol"][use]) / ch, per_doc(of["digit"][use]) / ch, per_doc(ends) / r, top / u, per_doc(fresh * solid[use]) / ch, np.bincount(unit_doc, caps, n) / np.maximum(np.bincount(unit_doc, cased, n), 1), np.log(u / r), per_doc(bullet) / r, np.array([np.nan if x is None else x / 100 for x in confidence], float))
    for k, x in enumerate(stats):
        out[some, k] = x[some]
    return [langs[b] if langs and s and b >= 0 else None for b, s in zip(best, some)], out


def document_stats(docs: DataFrame, languages: DataFrame, profile: Profile | None = None) -> DataFrame:
    """(doc_id, language, STATS...) of every row."""
    profile = profile or corpus_profile(docs, languages)
    names = label_names(languages.select("lang", "iso3", "lang_name").collect())  # a small fixed table

    def run(profile, batch):
        ids, texts, sources, labels, conf = (batch.column(c).to_pylist() for c in ("doc_id", "text", "source", "lang", "confidence"))
        for part in codes.chunks(texts):
            lang, x = text_stats(texts[part], sources[part], labels[part], conf[part], profile, names)
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(lang, pa.string()), *(pa.array(x[:, k], from_pandas=True) for k in range(P))], ["doc_id", "language", *STATS])

    return with_notices(docs.select("doc_id", "text", "source", "lang", "confidence"), profile, run, SCHEMA)


def _sums(stats: DataFrame, centre: dict) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Per language and for all ("") number, mean and covariance of the rows within the limit of centre."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x, langs = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], 1), np.array(batch.column("language").to_pylist(), object)
            for lang in set(langs.tolist()):
                own = x[langs == lang]
                mean, inverse = centre.get(lang, centre[""])
                own = np.where(np.isnan(own), mean, own)
                d = own - mean
                own = d[np.einsum("ij,jk,ik->i", d, inverse, d) <= _LIMIT] + mean
                v = np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
                for name in (lang, ""):
                    total[name] = total.get(name, 0) + v
        rows = [(k, i, float(y)) for k, v in total.items() for i, y in enumerate(v)]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["language", "i", "v"])

    rows = stats.where("language is not null and words is not null").select("language", *STATS).mapInArrow(run, "language string, i int, v double").groupBy("language", "i").agg(F.sum("v").alias("v")).collect()  # a small matrix a language
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["language"], np.zeros(1 + P + P * P))[r["i"]] = r["v"]
    result = {}
    for lang, v in out.items():
        if v[0] > 0:
            mean = v[1 : P + 1] / v[0]
            result[lang] = (v[0], mean, v[P + 1 :].reshape(P, P) / v[0] - np.outer(mean, mean))
    return result


#: Least standard deviation of each statistic: differences below it are of no account.
FLOOR = np.array([0.2, 0.15, 0.01, 0.01, 0.05, 0.02, 0.04, 0.03, 0.15, 0.02, 0.02])


def _inverse(cov: np.ndarray) -> np.ndarray:
    return np.linalg.inv(cov + np.diag(FLOOR**2))


def prose_model(stats: DataFrame, steps: int = 3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language (and "" for all) the robust mean and inverse covariance of the statistics."""
    known = stats.where("language is not null and words is not null")
    medians = lambda g: g.agg(*(F.percentile_approx(s, 0.5, 1000).alias(s) for s in STATS), F.count("*").alias("_n")).collect()
    of_all = np.array([v if v is not None else 1.0 for v in medians(known.groupBy())[0][:P]], float) if known.head(1) else np.zeros(P)
    centre = {"": of_all}
    for r in medians(known.groupBy("language")):  # a row a language of a small table
        w = r["_n"] / (r["_n"] + PRIOR_DOCS)
        centre[r["language"]] = w * np.array([of_all[k] if r[s] is None else r[s] for k, s in enumerate(STATS)], float) + (1 - w) * of_all
    lookup = F.create_map(*(x for k, v in centre.items() for x in (F.lit(k), F.array(*map(F.lit, v.tolist())))))
    mid = F.coalesce(lookup[F.col("language")], lookup[F.lit("")])
    spreads = known.groupBy("language").agg(*(F.percentile_approx(F.abs(F.col(s) - mid[k]), 0.5, 1000).alias(s) for k, s in enumerate(STATS))).collect()
    mad = {r["language"]: np.array([0 if r[s] is None else 1.4826 * r[s] for s in STATS], float) for r in spreads}
    every = np.median(list(mad.values()), 0) if mad else np.ones(P)
    model = {k: (v, _inverse(np.diag(mad.get(k, every) ** 2))) for k, v in centre.items()}
    for _ in range(steps):
        sums = _sums(stats, model)
        if "" not in sums:
            break
        _, mean, cov = sums[""]
        for k, (n, m, v) in sums.items():
            w = 1.0 if k == "" else n / (n + PRIOR_DOCS)
            model[k] = (w * m + (1 - w) * mean, _inverse(w * v + (1 - w) * cov))
    return model


def outlierness(stats: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """stats with distance (squared Mahalanobis) and each statistic's contribution c_... and deviation z_..."""

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], 1)
            langs = batch.column("language").to_pylist()
            part, z = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
            names = np.array([k if k in model else "" for k in langs], object)
            for name in set(names.tolist()):
                own = np.flatnonzero(names == name)
                mean, inverse = model[name]
                d = np.where(np.isnan(x[own]) & ~np.isnan(x[own, :1]), mean, x[own]) - mean
                part[own] = d * (d @ inverse)
                z[own] = d * np.sqrt(np.diag(inverse))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(part.sum(1), from_pandas=True), *(pa.array(part[:, k], from_pandas=True) for k in range(P)), *(pa.array(z[:, k], from_pandas=True) for k in range(P))], [*batch.schema.names, "distance", *(f"c_{s}" for s in STATS), *(f"z_{s}" for s in STATS)])

    more = ", ".join(["distance double", *(f"c_{s} double" for s in STATS), *(f"z_{s} double" for s in STATS)])
    return stats.select("doc_id", "language", *STATS).mapInArrow(run, f"{SCHEMA}, {more}")


def unnatural_texts(scored: DataFrame, least: float = _OUTLIER) -> DataFrame:
    """(doc_id, kind): outliers whose deviations are those of tables, of lists or of unreadable text.

    A table's figures in lines of hardly a word, a list's unfinished lines and junk's lack of common words must
    take most of the text.
    """
    z, v = lambda s: F.col(f"z_{s}"), F.col
    few = F.lit(0.3) - 0.4 / F.sqrt(F.exp("words"))  # a single sentence may hold few common words by chance
    # words in small letters, unless it is a list of them; or words broken up by signs
    odd = (v("capitals") < 0.4) & ((v("fresh_lines") < 0.8) | (v("symbols") > 0.25)) | (z("word_length") < -4) & (v("symbols") > 0.12)
    kind = (
        F.when((z("digits") > 8) & (v("digits") >= 0.2) & ((v("line_words") < 1.1) | (v("digits") >= 0.3)), "table")
        .when((z("common") < -3) & ((v("common") < few) & (z("confidence") < -4) | (v("common") < few - 0.05) & odd), "junk")
        .when((v("fresh_lines") > 0.55) & (z("fresh_lines") > 3) & (v("line_ends") < 0.25), "list")
        .when((v("bullets") > 0.5) & (z("bullets") > 8) & (z("common") < -1.5) & (v("line_ends") < 0.25), "list")
    )
    return scored.where(F.col("distance") > least).select("doc_id", kind.alias("kind")).where("kind is not null")


def quality(docs: DataFrame, languages: DataFrame) -> DataFrame:
    """Statistics, distance and contributions of every document."""
    stats = document_stats(docs, languages).persist()
    return outlierness(stats, prose_model(stats))
