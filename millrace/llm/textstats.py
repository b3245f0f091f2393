"""Problem 10: per-document text statistics, and how far a document lies from the prose of its language.

Page furniture goes first: entries that many pages of a host, or very many pages of all hosts, share (menus, notices), the
title and the footer. Statistics of the rest are compared with prose by the robust Mahalanobis distance: mean and covariance
of each language are those of its innermost documents, found by repeated concentration and made consistent for the normal
distribution. The distance splits exactly into one contribution per statistic, and the cut-off is a quantile of chi-square.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime

#: An entry in this share of the distinct contents of a host, or of all hosts, and in so many at least, is page furniture.
HOST_SHARE, FREQUENT_SHARE, FREQUENT_DOCS = 0.2, 0.018, 5
#: Longer entries are content.
ENTRY_CHARS = 200
TITLE_WORDS = 12
#: Share of normally distributed prose that the cut-off would reject.
REJECTED = 1e-5
#: Documents of a language that the estimate of its prose needs at least; else that of all languages serves. Words of a
#: document that takes part in it.
LEAST_DOCS, LEAST_WORDS = 20, 5
#: Shares of documents kept in the concentration steps.
CORE = (0.75, 0.95, 0.95, 0.95, 0.95)
#: Added to each variance, as a share of it.
RIDGE = 0.05

STATISTICS = ("words", "word_length", "symbols", "line_ends", "common_words", "numbers", "line_words")
#: Weight of the language's typical value against the document's own: documents of few words say little.
PRIOR = {"word_length": 12, "symbols": 100, "line_ends": 3, "common_words": 12, "numbers": 12, "line_words": 1}

# Three-letter codes of languages by their two-letter codes.
LABELS = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl"}

_SPOILED = re.compile("[ÃÂâ][\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_HIGH_RUN = re.compile("[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2,}")
_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_RUN = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"\s*[|»\t]\s*|\s{2,}")
_END = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")
_FOOTER = re.compile("^\\W{0,3}(?:©|\\(c\\)\\s|copyright\\b|[\ufffd?]\\s*(?:19|20)[0-9]{2}\\b)", re.I)
#: A lost character within a word.
_LOST = re.compile("(?<=[A-Za-z])\ufffd+|\ufffd+(?=[A-Za-z])")


def _decode(m: re.Match) -> str:
    try:
        return b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repaired(text: str) -> str:
    """Text in composed form; UTF-8 that was read as a single-byte charset is read again, run by run."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _HIGH_RUN.sub(_decode, text) if _SPOILED.search(text) else text)


def folded(text: str) -> str:
    """Lower case without accents and invisible characters."""
    return text.lower() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))


def entry_hash(entry: str) -> int:
    """Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(entry.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def furniture(docs: DataFrame, text: str, host: str) -> tuple[set[int], DataFrame]:
    """Hashes of lines and of parts of lines (cut at bars, tabs and wide gaps) that many contents share: those of all hosts,
    and per host (host, furniture: array of hashes).

    Pages with the same longest line are one content, whose entries count once however often it is copied, so copies do not
    make their own content frequent; copies combine before they move. As each entry found takes up a share of the contents,
    there are at most (entries per content / share) of them, per host as well.
    """
    lines = F.split("t", r"\s*\n\s*")
    longest = F.array_max(F.transform(lines, lambda x: F.struct(F.length(x).alias("n"), F.lower(x).alias("x"))))["x"]
    entries = F.array_distinct(F.concat(lines, F.split("t", r"\s*[|»\t\n]\s*|\s{2,}")))
    hashes = F.transform(F.filter(entries, lambda e: (e != "") & (F.length(e) <= ENTRY_CHARS)), lambda e: F.xxhash64(F.trim(e)))
    own = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.col(text).cast("string").alias("t")).select("host", F.xxhash64(longest).alias("content"), hashes.alias("hs"))
    contents = runtime.persist_table(own.groupBy("host", "content").agg(F.min("hs").alias("hs")), "page-contents")

    everywhere = runtime.persist_table(contents.groupBy("content").agg(F.min("hs").alias("hs")), "contents")
    least = max(FREQUENT_DOCS, FREQUENT_SHARE * everywhere.count())
    found = everywhere.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h").limit(runtime.BROADCAST_ROWS + 1).collect()
    if len(found) > runtime.BROADCAST_ROWS:
        raise ValueError("documents share more entries than page furniture can be")
    hosted = contents.where("host is not null")
    counts = hosted.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT_DOCS)
    sizes = hosted.groupBy("host").agg((F.count(F.lit(1)) * HOST_SHARE).alias("least"))
    per_host = counts.join(sizes, "host").where("n >= least").groupBy("host").agg(F.collect_list("h").alias("furniture"))
    return {r.h for r in found}, runtime.persist_table(per_host, "host-furniture")


class Reader:
    """Splits texts into content and furniture and measures the content."""

    def __init__(self, frequent: set[int], common: Mapping[str, tuple[str, ...]]):
        self.frequent, self.common = frequent, common
        self.host: tuple[str | None, frozenset[int]] = (None, frozenset())
        self.kinds: dict[tuple[str | None, str], str] = {}

    def at_host(self, host: str | None, entries: list[int] | None) -> None:
        """Texts that follow come from a host with furniture of its own."""
        self.host = (host, frozenset(entries)) if entries else (None, frozenset())

    def is_frequent(self, entry: str) -> bool:
        h = entry_hash(entry)
        return h in self.frequent or h in self.host[1]

    def kind(self, line: str) -> str:
        """`menu`, `notice` (furniture in sentences) or `content`."""
        if len(line) > ENTRY_CHARS:
            return "content"
        key = self.host[0], line
        known = self.kinds.get(key)
        if known is None:
            if len(self.kinds) > 200_000:
                self.kinds.clear()
            known = self.kinds[key] = self._kind(line)
        return known

    def _kind(self, line: str) -> str:
        if self.is_frequent(line):
            return "notice" if len(_RUN.findall(line)) >= 6 and _SENTENCE.search(line) else "menu"
        parts = _SPLIT.split(line)
        if all(self.is_frequent(p) for p in parts if p):
            return "menu"
        return "menu" if self._phrases(line.split(" ")) else "content"

    def _phrases(self, tokens: list[str]) -> bool:
        """Whether the tokens are frequent entries side by side."""
        i = 0
        while i < len(tokens):
            for j in range(min(len(tokens), i + 4), i, -1):
                if self.is_frequent(" ".join(tokens[i:j])):
                    i = j
                    break
            else:
                return False
        return True

    def content(self, text: str) -> list[str]:
        """Lines of content; where there are none, the notices."""
        kept, notices = [], []
        for line in repaired(text).split("\n"):
            line = line.strip()
            if not line or _FOOTER.match(line):
                continue
            kind = self.kind(line)
            if kind == "content":
                kept.append(line)
            elif kind == "notice":
                notices.append(line)
        if kept and (len(kept) > 1 or notices) and len(kept[0]) <= ENTRY_CHARS and not _END.search(kept[0]) and len(kept[0].split()) <= TITLE_WORDS:
            kept = kept[1:]
        return kept or notices

    def measure(self, text: str | None) -> tuple:
        """(words, letter words, letters, symbols, characters, lines, ended lines, common words, language)."""
        words = alpha = letters = runs = chars = ended = hits = 0
        by_lang: dict[str, int] = {}
        lines = self.content(text) if text else []
        for line in lines:
            if "\ufffd" in line:
                line = _LOST.sub("e", line)
            found = _RUN.findall(folded(line))
            words += len(found)
            here: dict[str, int] = {}
            for w in found:
                runs += len(w)
                if w.isalpha():
                    alpha += 1
                    letters += len(w)
                    for lang in self.common.get(w, ()):
                        here[lang] = here.get(lang, 0) + 1
            if here:
                hits += max(here.values())
                for lang, k in here.items():
                    by_lang[lang] = by_lang.get(lang, 0) + k
            chars += len("".join(line.split()))
            ended += bool(_END.search(line))
        lang = max(sorted(by_lang), key=by_lang.__getitem__) if by_lang else None
        return words, alpha, letters, max(0, chars - runs), chars, len(lines), ended, hits, lang


MEASURES = "n long, alpha long, letters long, symbols long, chars long, lines long, ended long, hits long, found string"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _measure(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for b in batches:
            rows = []
            for text, host, own in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                reader.at_host(host, own)
                rows.append(reader.measure(text))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
            arrays = [pa.array(c, pa.string() if k == "found" else pa.int64()) for k, c in zip(_NAMES, cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["id", "label", *_NAMES])

    return run


def measures(docs: DataFrame, doc_id: str, text: str, lang: str, host: str, common: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Counts of each document's content, one row per row: id, label (two-letter code) and MEASURES. `found` is the language
    of most common words, null without any. Null and blank texts have counts of 0. A null host has no furniture of its own."""
    code = F.lower(F.substring(F.trim(F.col(lang)), 1, 3))
    alias = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), code), F.when(F.lower(F.trim(F.col(lang))).rlike("^[a-z]{2}([^a-z]|$)"), F.substring(code, 1, 2)))
    everywhere, per_host = furniture(docs, text, host)
    flat = docs.select(F.col(doc_id).cast("long").alias("id"), alias.alias("label"), F.col(text).cast("string").alias("text"), F.col(host).alias("host"))
    flat = flat.join(runtime.broadcast_if_small(per_host), "host", "left").select("id", "label", "text", "host", "furniture")
    shared = docs.sparkSession.sparkContext.broadcast((everywhere, dict(common)))
    return runtime.map_arrow(flat, _measure(shared), f"id long, label string, {MEASURES}", runtime.TEXT_ROWS)


_TYPICAL = {"word_length": ("letters", "alpha"), "symbols": ("symbols", "chars"), "line_ends": ("ended", "lines"), "common_words": ("hits", "alpha"), "numbers": ("numeric", "n"), "line_words": ("n", "lines")}
#: Ranges of typical values, of statistics, and of the logarithm of distances, each cut into BINS for quantiles. Beyond a range
#: counts as its end.
_TYPICAL_RANGE = {"word_length": (0, 20), "symbols": (0, 1), "line_ends": (0, 1), "common_words": (0, 1), "numbers": (0, 1), "line_words": (0, 400), "words": (0, 14)}
_RANGE = ((0, 1), (0, 20), (0, 1), (0, 1.6), (0, 1.6), (0, 1), (-5, 15))
_LOG_RANGE = (-6, 9)
BINS = 4000

Numbers = dict[str, np.ndarray]


@dataclass
class Prose:
    """What prose of a language looks like: typical values, mean and inverse covariance of the statistics."""

    typical: dict[str, float]
    mean: np.ndarray
    inverse: np.ndarray


def statistics(m: Numbers, typical: Mapping[str, float]) -> np.ndarray:
    """The statistics of documents with measures m, drawn towards the typical ratios where a document has few words. Words
    count by their share in themselves and a typical document's, shares by the arc sine of their root, which evens out their
    variance."""
    m = m | {"numeric": m["n"] - m["alpha"]}
    r = {k: (m[a] + PRIOR[k] * typical[k]) / (m[b] + PRIOR[k]) for k, (a, b) in _TYPICAL.items()}
    angle = lambda x: np.arcsin(np.sqrt(np.minimum(x, 1.0)))
    return np.column_stack([m["n"] / (m["n"] + np.exp(typical["words"])), r["word_length"], r["symbols"], angle(r["line_ends"]), angle(r["common_words"]), np.sqrt(r["numbers"]), np.log(r["line_words"] + 0.01)])


def contributions(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """What each statistic adds to the squared distance; the rows' sums are the distances."""
    y = x - mean
    return y * (y @ inverse)


def chi_square_share(x: float, degrees: int) -> float:
    """Share of the chi-square distribution up to x, by the series of the incomplete gamma function."""
    a, t = degrees / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= t / k
        total += term
    return total * math.exp(a * math.log(t) - t - math.lgamma(a)) if t > 0 else 0.0


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, degrees) < share else (low, mid)
    return high


#: Squared distance beyond which a document is no prose.
FAR = chi_square_quantile(1 - REJECTED, len(STATISTICS))


def consistency(share: float, degrees: int) -> float:
    """Factor by which the covariance of the innermost share of normal data falls short of that of all."""
    return share / chi_square_share(chi_square_quantile(share, degrees), degrees + 2)


def _cells(x: np.ndarray, bounds: tuple[float, float], row: int) -> np.ndarray:
    lo, hi = bounds
    return row * BINS + np.clip((x - lo) / (hi - lo) * BINS, 0, BINS - 1).astype(np.int64)


def _quantile(counts: np.ndarray, share: float, bounds: tuple[float, float]) -> float:
    """Of a histogram: where the cumulative count passes the share, within the cell in proportion."""
    upto = np.cumsum(counts)
    k = int(np.searchsorted(upto, share * upto[-1], "left"))
    inside = (share * upto[-1] - (upto[k] - counts[k])) / max(counts[k], 1e-9)
    return bounds[0] + (k + min(max(inside, 0.0), 1.0)) * (bounds[1] - bounds[0]) / BINS


_COUNTS = [c for c in _NAMES if c != "found"]


def _numbers(b: pa.RecordBatch) -> Numbers:
    return {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in _COUNTS}


def _totals(measured: DataFrame, languages: list[str], width: int, add: Callable[[str, Numbers], np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over all documents, per language and over all (``), of vectors of `width` numbers that `add` makes of a batch's
    documents. Each partition sends its non-zero sums once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(width) for lang in languages}
        for b in batches:
            m, found = _numbers(b), np.array(b.column("found").to_pylist(), object)
            for lang in languages:
                own = m if not lang else {k: v[found == lang] for k, v in m.items()}
                if len(own["n"]):
                    sums[lang] += add(lang, own)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(v[at])], names=["lang", "at", "v"])

    rows = runtime.map_arrow(measured, run, "lang string, at int, v double").groupBy("lang", "at").agg(F.sum("v").alias("v")).collect()
    out = {lang: np.zeros(width) for lang in languages}
    for r in rows:
        out[r.lang][r["at"]] = r.v
    return out


def fit_prose(measured: DataFrame, languages: list[str]) -> dict[str, Prose]:
    """Robust mean and covariance per language from documents whose label and common words agree on it; `` is the estimate
    over all languages, which serves those with too few documents. Empty if even that has too few.

    Each step keeps the share of documents nearest to the last estimate and takes mean and covariance of those. All steps
    are sums over all documents; quantiles come from histograms of BINS cells.
    """
    agreed = measured.where((F.col("label") == F.col("found")) & (F.col("n") >= LEAST_WORDS))
    p, langs = len(STATISTICS), [*languages, ""]

    def histogram(columns: list[tuple[np.ndarray, tuple[float, float]]]) -> np.ndarray:
        return sum(np.bincount(_cells(x, bounds, k), minlength=len(columns) * BINS).astype(float) for k, (x, bounds) in enumerate(columns))

    names = [*_TYPICAL, "words"]

    def ratios(_: str, m: Numbers) -> np.ndarray:
        m = m | {"numeric": m["n"] - m["alpha"]}
        return histogram([*[(m[a] / np.maximum(m[b], 1), _TYPICAL_RANGE[k]) for k, (a, b) in _TYPICAL.items()], (np.log(m["n"]), _TYPICAL_RANGE["words"])])

    counts = _totals(agreed, langs, len(names) * BINS, ratios)
    langs = [x for x in langs if counts[x][:BINS].sum() >= LEAST_DOCS]
    typical = {x: {k: _quantile(counts[x][j * BINS : (j + 1) * BINS], 0.5, _TYPICAL_RANGE[k]) for j, k in enumerate(names)} for x in langs}
    if not langs:
        return {}
    spread = _totals(agreed, langs, p * BINS, lambda x, m: histogram([(c, _RANGE[k]) for k, c in enumerate(statistics(m, typical[x]).T)]))
    fits = {}
    for x in langs:
        q = np.array([[_quantile(spread[x][k * BINS : (k + 1) * BINS], s, _RANGE[k]) for s in (0.1, 0.25, 0.5, 0.75, 0.9)] for k in range(p)])
        # Deviations by the wider of two quantile ranges: more than half of a statistic's values may be equal.
        wide = np.maximum.reduce([(q[:, 3] - q[:, 1]) / 1.349, (q[:, 4] - q[:, 0]) / 2.563, np.full(p, 1e-3)])
        fits[x] = Prose(typical[x], q[:, 2], np.diag(1 / np.square(wide)))

    def distance(x: str, m: Numbers) -> tuple[np.ndarray, np.ndarray]:
        v = statistics(m, fits[x].typical)
        return v, contributions(v, fits[x].mean, fits[x].inverse).sum(axis=1)

    for share in CORE:
        far = _totals(agreed, langs, BINS, lambda x, m: histogram([(np.log(distance(x, m)[1] + 1e-6) / np.log(10), _LOG_RANGE)]))
        cut = {x: 10 ** _quantile(far[x], share, _LOG_RANGE) for x in langs}

        def moments(x: str, m: Numbers, cut: dict[str, float] = cut) -> np.ndarray:
            v, d = distance(x, m)
            y = v[d <= cut[x]] - fits[x].mean
            return np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])

        sums = _totals(agreed, langs, 1 + p + p * p, moments)
        for x in langs:
            n = max(sums[x][0], 1.0)
            shift = sums[x][1 : p + 1] / n
            cov = sums[x][p + 1 :].reshape(p, p) / n - np.outer(shift, shift)
            cov = consistency(share, p) * (cov + np.diag(RIDGE * np.diag(cov) + 1e-9))
            fits[x] = Prose(typical[x], fits[x].mean + shift, np.linalg.inv(cov))
    return fits


def judged(measured: DataFrame, languages: list[str]) -> DataFrame:
    """measured with distance, its contributions (`d_<statistic>`) and prose (boolean).

    A document is held against the prose of the language of its common words, one without any against the nearest. It is
    prose up to FAR. One without a word is no prose and has null distance; without any estimate of prose, all other
    documents count as prose.
    """
    prose = fit_prose(measured, languages)
    known = [x for x in languages if x in prose] or [x for x in ("",) if x in prose]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, found = _numbers(b), np.array(b.column("found").to_pylist(), object)
            best, parts = np.full(b.num_rows, np.inf), np.zeros((b.num_rows, len(STATISTICS)))
            for x in known:
                c = contributions(statistics(m, prose[x].typical), prose[x].mean, prose[x].inverse)
                d = c.sum(axis=1)
                use = ((found == x) | ~np.isin(found.astype(str), known)) & (d < best)
                best[use], parts[use] = d[use], c[use]
            nothing = (m["n"] == 0) | ~np.isfinite(best)
            prosaic = ~nothing & (best <= FAR) if known else m["n"] > 0
            cols = [pa.array(best, mask=nothing), *[pa.array(parts[:, k], mask=nothing) for k in range(len(STATISTICS))], pa.array(prosaic)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    names = ["distance", *[f"d_{s}" for s in STATISTICS], "prose"]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in measured.schema.fields], *[f"{n} double" for n in names[:-1]], "prose boolean"])
    return runtime.map_arrow(measured, run, schema)


def plain_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, word_count, mean_word_length, symbol_ratio, line_end_share) over whole texts, furniture included, in built-in
    expressions: runs of letters and digits, characters outside of them, and lines that end in punctuation. Ratios of nothing
    are null; null texts have no words."""
    t = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    words = F.regexp_extract_all("t", F.lit(r"([\p{L}\p{N}]+)"), 1)
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    m = t.select("id", F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("runs"), F.length(F.regexp_replace("t", "[ \t\r\n]", "")).alias("chars"), lines.alias("lines"))
    m = m.select("id", "n", "runs", "chars", F.size("lines").alias("lines"), F.size(F.filter("lines", lambda x: x.rlike(r"[.!?…:;][\"'”’»)\]]*$"))).alias("ended"))
    ratio = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    return m.select("id", F.col("n").alias("word_count"), ratio(F.col("runs"), "n").alias("mean_word_length"), ratio(F.col("chars") - F.col("runs"), "chars").alias("symbol_ratio"), ratio(F.col("ended"), "lines").alias("line_end_share"))


def common_words(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """Languages of each common word, without case and accents, from a table (lang, word) of bounded size."""
    rows = table.where("lang is not null and word is not null").limit(runtime.BROADCAST_ROWS + 1).collect()
    if len(rows) > runtime.BROADCAST_ROWS:
        raise ValueError("too many common words")
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(folded(r.word), set()).add(r.lang)
    return {w: tuple(sorted(ls)) for w, ls in out.items()}


def quality(docs: DataFrame, doc_id: str, text: str, lang: str, host: str, common: DataFrame) -> DataFrame:
    """Statistics, distance and judgement of every document; see `measures` and `judged`."""
    words = common_words(common)
    measured = runtime.persist_table(measures(docs, doc_id, text, lang, host, words), "text-measures")
    return judged(measured, sorted({x for ls in words.values() for x in ls}))
