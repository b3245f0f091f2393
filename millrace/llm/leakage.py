"""Problem 9: corpus documents that contain passages of held-out test items.

Texts become sequences of word hashes. Of every `w` consecutive k-gram hashes the least is kept (the rightmost of equal
ones); as the choice depends on the window's content alone, two texts that share w + k - 1 words in a row keep a k-gram in
common there. Kept k-grams of a document that are also kept in an item are extended word by word to both sides, and the
longest run decides. Test items go to the corpus in blocks of bounded size, so the corpus is read and hashed once where it
lies and nothing of it is shuffled but the findings.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import runtime

#: Words in a row that count as a leak; shorter items leak only as a whole.
SPAN_WORDS = 12
#: Guaranteed span of each class of items: an item goes to the largest that it is long enough for.
CLASSES = (SPAN_WORDS, 8, 4, 2, 1)
#: Most words of test items that travel at once (8 bytes each).
BLOCK_WORDS = 4_000_000
#: Words of documents handled at once.
CHUNK_WORDS = 1 << 19
CACHE_WORDS = 1 << 20
#: Hits of k-grams in items that are compared at once.
PAIRS = 1 << 20

_HIDDEN = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
FOUND = "doc_id bigint, number bigint, words int"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits without case, accents and invisible characters; none for null."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKD", text.casefold())))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([_hashes[w] for w in words(text)], np.uint64)


def gram_sizes(span: int) -> tuple[int, int]:
    """k and w with w + k - 1 = span."""
    k = (span + 1) // 2
    return k, span - k + 1


def winnow(h: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the kept k-grams of a sequence of word hashes; none if it is shorter than span."""
    k, w = gram_sizes(span)
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - k + 1
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    least, at = g[: n - w + 1].copy(), np.arange(n - w + 1)
    for j in range(1, w):
        other = g[j : j + n - w + 1]
        better = other <= least
        least[better] = other[better]
        at[better] += j - (at[better] - np.flatnonzero(better))
    keep = np.unique(at)
    return keep, g[keep]


@dataclass
class ItemIndex:
    """Kept k-grams of a block of items: per class sorted values with item number and position."""

    ids: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(items: list[tuple[int, np.ndarray]]) -> ItemIndex:
        per: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, h) in enumerate(items):
            span = next(c for c in CLASSES if c <= len(h))
            at, g = winnow(h, span)
            per.setdefault(span, []).append((g, np.full(len(g), k), at))
        classes = {}
        for span, parts in per.items():
            g, k, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            classes[span] = g[order], k[order], at[order]
        lens = [len(h) for _, h in items]
        return ItemIndex(np.array([i for i, _ in items], np.int64), np.r_[0, np.cumsum(lens)].astype(np.int64), np.concatenate([h for _, h in items]), classes)

    def find(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, item number, longest run of words) of the leaks in documents laid end to end."""
        found: list[np.ndarray] = []
        for span, (values, items, offsets) in self.classes.items():
            at, g = winnow(h, span)
            lo, hi = np.searchsorted(values, g, "left"), np.searchsorted(values, g, "right")
            hit = np.flatnonzero(hi > lo)
            at, lo, reps = at[hit], lo[hit], (hi - lo)[hit]
            start, upto = 0, np.cumsum(reps)
            while start < len(at):  # hits that many items share come in slices of bounded size
                end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
                r = reps[start:end]
                entry = np.repeat(lo[start:end], r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
                found.append(self._runs(h, bounds, np.repeat(at[start:end], r), items[entry], offsets[entry]))
                start = end
        if not found:
            return (np.zeros(0, np.int64),) * 3
        d, i, n = np.concatenate(found, axis=1)
        order = np.lexsort((-n, i, d))
        d, i, n = d[order], i[order], n[order]
        best = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1])] if len(d) else np.zeros(0, bool)
        return d[best], i[best], n[best]

    def _runs(self, h: np.ndarray, bounds: np.ndarray, pos: np.ndarray, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Rows document, item and length of the runs of equal words that are long enough, around positions in the documents
        that hold the same k-gram as an offset of an item. Hits of one document and item that lie on one diagonal are
        compared up to the next one only and then chained, so each word of a run is compared once."""
        doc = np.searchsorted(bounds, pos, "right") - 1
        order = np.lexsort((pos, pos - offset, item, doc))
        doc, item, pos, offset = doc[order], item[order], pos[order], offset[order]
        theirs = self.starts[item] + offset
        ahead = np.minimum(bounds[doc + 1] - pos, self.starts[item + 1] - theirs)
        back = np.minimum(pos - bounds[doc], offset)
        same = np.r_[(doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (pos[1:] - offset[1:] == pos[:-1] - offset[:-1]), False]
        gap = np.where(same, np.r_[pos[1:], 0] - pos, np.iinfo(np.int64).max)
        right = self._equal(h, pos, theirs, np.minimum(ahead, gap), 1)
        linked = right >= gap
        first = np.r_[True, ~linked[:-1]]
        left = self._equal(h, pos[first] - 1, theirs[first] - 1, back[first], -1)
        begin = pos[first] - left
        length = (pos + right)[~linked] - begin
        d, i = doc[first], item[first]
        keep = length >= np.minimum(SPAN_WORDS, self.starts[i + 1] - self.starts[i])
        return np.vstack([d[keep], i[keep], length[keep]])

    def _equal(self, h: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """How many words from a in the documents and b in the items on are equal, at most limit, in the direction of step."""
        n = np.zeros(len(a), np.int64)
        alive = np.flatnonzero(limit > 0)
        k = 0
        while len(alive):
            alive = alive[h[a[alive] + step * k] == self.hashes[b[alive] + step * k]]
            k += 1
            n[alive] = k
            alive = alive[limit[alive] > k]
        return n


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes (as bytes) and a digest of them, of items (id, text)."""
    for b in batches:
        hashes = [word_hashes(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(h) for h in hashes], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(h.tobytes()) for h in hashes], pa.string()), pa.array([h.tobytes() for h in hashes], pa.binary())],
            names=["item_id", "words", "digest", "hashes"],
        )


def _index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The index of a block: its items, one of each content, come in one partition."""
    rows = [r for f in frames for r in zip(f["block"], f["number"], f["hashes"], strict=True)]
    for block in sorted({r[0] for r in rows}):
        own = sorted((int(n), np.frombuffer(h, np.uint64)) for b, n, h in rows if b == block)
        yield pd.DataFrame({"block": [block], "index": [pickle.dumps(ItemIndex.build(own), protocol=5)]})


def item_blocks(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(item_id, number) of items with words, where items of the same words share a number; (block, index) with the index of
    each block of at most about BLOCK_WORDS words; and the number of blocks. Items are read and indexed by the executors."""
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    named = runtime.persist_table(runtime.map_arrow(own, _numbered, "item_id long, words long, digest string, hashes binary", runtime.TEXT_ROWS).where("words > 0"), "item-words")
    contents = named.groupBy("digest").agg(F.min("item_id").alias("number"), F.first("hashes").alias("hashes"), F.first("words").alias("words"))
    contents = runtime.persist_table(contents, "item-contents")
    blocks = -(-(contents.agg(F.sum("words")).first()[0] or 0) // BLOCK_WORDS)
    numbers = named.join(contents.select("digest", "number"), "digest").select("item_id", "number").distinct()
    placed = contents.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(max(1, blocks))).cast("int"))
    index = placed.select("block", "number", "hashes").repartition(max(1, blocks), "block").mapInPandas(_index, "block int, index binary")
    return numbers, index, blocks


def _scan(blocks: Callable[[], Iterator[ItemIndex]]):
    """Leaks of documents (id, text) in the items of all blocks: each document is read and hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            start = 0
            while start < len(texts):
                parts, size, end = [], 0, start
                while end < len(texts) and (end == start or size < CHUNK_WORDS):
                    parts.append(word_hashes(texts[end]))
                    size += len(parts[-1])
                    end += 1
                bounds = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
                words_of = np.concatenate(parts)
                for items in blocks():
                    d, i, n = items.find(words_of, bounds)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(d + start)).cast(pa.int64()), pa.array(items.ids[i]), pa.array(n.astype(np.int32))], names=["doc_id", "number", "words"])
                start = end

    return run


def _from_folder(path: str) -> Callable[[], Iterator[ItemIndex]]:
    """Blocks of items one after another, from the shared folder; a worker holds one at a time."""

    def blocks() -> Iterator[ItemIndex]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.base_name.endswith(".parquet"):
                with store.open_input_file(f.path) as source:
                    for b in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["index"]):
                        for x in b.column(0):
                            yield pickle.loads(x.as_buffer())

    return blocks


def leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least SPAN_WORDS consecutive words of an item in order, or the
    whole item if it is shorter, with the longest such run.

    Null or wordless texts of either side hold nothing. Documents and items that repeat with the same id give one row. Items
    may be any number: one block of at most about BLOCK_WORDS words is broadcast, more lie in the shared folder, and each task
    holds one of them at a time against the documents that it has just hashed.
    """
    spark = corpus.sparkSession
    numbers, index, blocks = item_blocks(items, item_id, item_text)
    docs = corpus.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    if not blocks:
        return docs.limit(0).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("words"))
    if blocks == 1:
        shared = spark.sparkContext.broadcast(pickle.loads(bytes(index.first()["index"])))
        scan = _scan(lambda: iter([shared.value]))
    else:
        path = runtime.own_path(spark, "item-blocks")
        runtime.persist_table(index, "item-blocks", path)
        scan = _scan(_from_folder(path))
    found = runtime.map_arrow(docs, scan, FOUND, runtime.TEXT_ROWS).groupBy("doc_id", "number").agg(F.max("words").alias("words"))
    return found.join(runtime.broadcast_if_small(numbers), "number").groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
