"""Benchmark decontamination by spaced-seed hashing.

Each mask fixes which positions of a window of words count; the others may hold any
word. Windows of test items and of training documents are hashed under every mask,
joined on the hash, and around each hit the aligned words are compared: a segment
with few substitutions counts as an overlap.

Words are maximal runs of letters, digits and underscores, in lower case. An item
is found in a document if a segment has at least ``min(min_words, 0.8 n)`` equal
words, n being the item's words, and 0.8 of its words equal. Every such segment holds a
window that some mask of ``MASKS`` meets: items of up to four words are hashed whole,
longer ones have masks for every pattern of 0.2 n substitutions, and of 16 words of a
longer item with 13 equal ones every pattern is met too. ``least_words`` leaves out
items too short to tell from chance; by default none are.

A fixed-size bitmap of the items' hashes drops windows that cannot match before
they leave the scan; it grows with nothing, and when it fills the join still
decides. Documents with hits keep the words as far around them as the longest item
reaches, so that every alignment is compared over the whole item.

Defined results: null and empty texts have no words and no overlaps; an item without
words is in no document; repeated rows of documents each give rows, repeated items
count once, items and documents with null ids like others; of equally many equal words
the longer segment is reported; other columns are ignored, whatever they are called; an
empty table on either side gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, materialise, row_keys, slices

WORD = re.compile(r"\w+")
#: The masks for items of at least so many words. Each list finds every
#: pattern of 0.2 n substitutions in an item of n words, up to 16 words: 1 in 5 to 9
#: words, 2 in 10 to 14, 3 in 15 and 16.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11011", "10111", "11101"),
    7: ("111101", "1010111", "1101011"),
    10: ("1101111", "11110011", "110101011", "110011011", "10111101"),
    14: ("11010001101", "11001010011", "11100011001", "10111100001", "11111000001", "110010111"),
}
SPAN = max(len(m) for masks in MASKS.values() for m in masks)
BITS = 24
CHUNK_WORDS = 1 << 20


class Words(dict):
    """Word to 64-bit hash, remembered up to a bounded number of words."""

    LIMIT = 1 << 16

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def hashes(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def factors(n: int) -> np.ndarray:
    """n odd 64-bit constants (splitmix64)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def family(n: int) -> int | None:
    """The key in ``MASKS`` for an item of n words; none if it is too short."""
    return max((least for least in MASKS if least <= n), default=None)


def mask_list(families=MASKS) -> list[tuple[int, list[int]]]:
    """(number, counted positions) of the masks of the given families."""
    every = [(least, m) for least, masks in MASKS.items() for m in masks]
    return [(k, [i for i, x in enumerate(m) if x == "1"]) for k, (least, m) in enumerate(every) if least in families]


def window_hashes(words: np.ndarray, mask: int, positions: list[int]) -> np.ndarray:
    """The hash of every window under one mask; a window lies wholly in ``words``."""
    span = max(positions) + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    f = factors(len(positions) + 1)
    h = np.full(n, f[-1], np.uint64) * np.uint64(mask + 1)
    for k, j in enumerate(positions):
        h += words[j : j + n] * f[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bit_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - BITS), h & np.uint64((1 << BITS) - 1)


def item_hashes(texts: DataFrame, least_words: int) -> DataFrame:
    """(item, digest, words, hash, at) of every window of every text of (digest, text) rows;
    ``item`` numbers the rows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, masks = Words(), {least: mask_list([least]) for least in MASKS}
        for batch in batches:
            for item, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = memo.hashes(text or "")
                use = masks.get(family(len(words)), []) if len(words) >= least_words else []
                found = [(h, i) for mask, at in use for i, h in enumerate(window_hashes(words, mask, at).view(np.int64).tolist())]
                if found:
                    lists = [words.view(np.int64), [h for h, _ in found], [i for _, i in found]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item], pa.int64()), pa.array([digest], pa.string()), *(pa.array([x], pa.list_(pa.int64())) for x in lists)],
                        ["item", "digest", "words", "hash", "at"],
                    )

    chosen = texts.select(F.monotonically_increasing_id().alias("item"), "digest", "text")
    return chosen.mapInArrow(hashed, "item long, digest string, words array<long>, hash array<long>, at array<long>")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITS places, folded on the executors into fixed-size rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, np.bool_)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for place in bit_places(h):
                bits[place] = True
        packed = np.packbits(bits)
        used = np.flatnonzero(packed)
        for i in range(0, len(used), 1 << 18):
            at = used[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], ["at", "byte"])

    folded = hashes.select("hash").mapInArrow(fold, "at long, byte long").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    rows = folded.toArrow()  # at most 2^21 rows of a place and a byte
    out[rows["at"].to_numpy()] = rows["byte"].to_numpy()
    return out


def hit_regions(docs: DataFrame, id_col: str, text_col: str, bitmap, families: list[int], reach: int) -> DataFrame:
    """(row, doc_id, key_a, key_b, start, words, hash, at): parts of documents around
    windows whose hash is in the bitmap; ``hash`` and ``at`` list those windows.
    ``families``: the mask families that items use."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap.value).view(np.bool_)
        memo, masks = Words(), mask_list(families)

        def regions(rows: list, words: list[np.ndarray]) -> list[tuple]:
            """Hits of many texts at once; windows across two texts are dropped."""
            ends = np.cumsum([len(w) for w in words])
            flat = np.concatenate(words) if words else np.empty(0, np.uint64)
            at, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for mask, positions in masks:
                h = window_hashes(flat, mask, positions)
                a, b = bit_places(h)
                i = np.flatnonzero(bits[a])
                i = i[bits[b[i]]]
                same = np.searchsorted(ends, i, "right") == np.searchsorted(ends, i + max(positions), "right")
                at.append(i[same])
                hashes.append(h[i[same]])
            at, hashes = np.concatenate(at), np.concatenate(hashes)
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
            which = np.searchsorted(ends, at, "right")
            lo = np.concatenate([[0], ends])[which] if len(at) else at
            cuts = np.flatnonzero((np.diff(at) > 2 * reach + SPAN) | (np.diff(which) > 0)) + 1
            found = []
            for part in np.split(np.arange(len(at)), cuts):
                if len(part):
                    d = which[part[0]]
                    start = max(lo[part[0]], at[part[0]] - reach)
                    stop = min(ends[d], at[part[-1]] + SPAN + reach)
                    found.append((*rows[d], int(start - lo[part[0]]), flat[start:stop].view(np.int64), hashes[part].view(np.int64), at[part] - start))
            return found

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 3
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["row", "doc_id", "key_a", "key_b", "start", "words", "hash", "at"],
            )

        for batch in batches:
            rows, words, n = [], [], 0
            for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    rows.append(own)
                    words.append(memo.hashes(text))
                    n += len(words[-1])
                if n > CHUNK_WORDS:
                    yield batch_of(regions(rows, words))
                    rows, words, n = [], [], 0
            if words:
                yield batch_of(regions(rows, words))

    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), *row_keys(doc_id, text), text.alias("text"))
    schema = "row long, doc_id long, key_a long, key_b long, start long, words array<long>, hash array<long>, at array<long>"
    return chosen.mapInArrow(find, schema)


def best_segment(equal: np.ndarray, similarity: float = 0.8) -> tuple[int, int]:
    """(equal words, length) of the segment with the most equal words among all
    whose share of equal words is at least ``similarity``; no segment gives (0, 0)."""
    count = np.concatenate([[0], np.cumsum(equal)])
    over = count - similarity * np.arange(len(count))  # a segment qualifies if it does not fall
    low = np.minimum.accumulate(over)
    # The first start for each end: the first place where the least value so far is no higher.
    first = len(low) - np.searchsorted(low[::-1], over + 1e-9, "right")
    end = int(np.argmax(count - count[first]))
    inside = np.flatnonzero(equal[first[end] : end])
    return (len(inside), int(inside[-1] - inside[0]) + 1) if len(inside) else (0, 0)


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", min_words: int = 13, similarity: float = 0.8, least_words: int = 1, broadcast_rows: int = 200_000,
) -> DataFrame:
    """row, doc_id, key_a, key_b, item_id, n_equal, n_words of every document row and item that overlap."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col(item_text_col).cast("string")
    named = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.md5(text).alias("digest"), text.alias("text")).where("text is not null")
    # Items of equal texts are compared as one.
    texts = named.groupBy("digest").agg(F.first("text").alias("text"))
    held = scratch.table(item_hashes(texts, least_words), "bench", small=True)
    hashes = held.select("item", F.inline(F.arrays_zip("hash", "at")))
    bitmap = spark.sparkContext.broadcast(bitmap_of(hashes))
    least = F.greatest(*(F.when(F.size("words") >= n, n) for n in MASKS))
    longest, families = held.agg(F.max(F.size("words")), F.collect_set(least)).first()  # as many as MASKS at most
    regions = scratch.table(hit_regions(docs, id_col, text_col, bitmap, families, longest or 0), "bench-hits", small=True)
    seeds = regions.select("row", "start", F.inline(F.arrays_zip("hash", F.col("at").alias("doc_at"))))
    windows = broadcast_if_small(hashes.withColumnRenamed("at", "item_at"), broadcast_rows)
    # Alignments first, as numbers; each is compared once, however many seeds it has.
    found = seeds.join(windows, "hash").select("row", "start", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
    full = found.distinct().join(regions.select("row", "start", "words"), ["row", "start"])
    item_words = broadcast_if_small(held.select("item", F.col("words").alias("other")), broadcast_rows, F.size("other"))
    aligned = full.join(item_words, "item").select("row", "item", "shift", "words", "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            row, item, shift, words, other = batch.columns
            for k in range(len(batch)):
                a, b = words[k].values.to_numpy(), other[k].values.to_numpy()
                s = shift[k].as_py()
                lo, hi = max(0, -s), min(len(b), len(a) - s)
                if hi > lo:
                    same = a[lo + s : hi + s] == b[lo:hi]
                    equal, length = best_segment(same, similarity)
                    if same.sum() >= similarity * len(b):  # the item as a whole, changed words at its ends too
                        equal, length = int(same.sum()), len(b)
                    if equal >= min(min_words, similarity * len(b)) and equal >= similarity * length:
                        out.append((row[k].as_py(), item[k].as_py(), equal, length))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "item", "n_equal", "n_words"])

    verified = aligned.mapInArrow(verify, "row long, item long, n_equal long, n_words long")
    own = regions.select("row", "doc_id", "key_a", "key_b").distinct()
    ids = named.select("item_id", "digest").distinct().join(held.select("item", "digest"), "digest").select("item", "item_id")
    rows = verified.join(ids, "item")
    best = rows.groupBy("row", "item_id").agg(F.max(F.struct("n_equal", "n_words")).alias("best"))
    out = best.join(own, "row").select("row", "doc_id", "key_a", "key_b", "item_id", "best.n_equal", "best.n_words")
    out = materialise(out, "bench-overlaps", small=True)
    scratch.drop()
    return out


def find_overlaps(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_equal, n_words: every document row and item that overlap,
    with the best segment's equal words and length. ``options``: those of ``overlaps``."""
    return overlaps(docs, items, **options).select("doc_id", "item_id", "n_equal", "n_words")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that overlap with no item, with their own columns; rows are told
    apart by id and text, null ids too."""
    found = overlaps(docs, items, id_col, text_col, **options).selectExpr("key_a AS __a", "key_b AS __b").distinct()
    found = broadcast_if_small(materialise(found, "bench-docs"), 200_000)
    made = dict(zip(("__a", "__b"), row_keys(F.col(id_col).cast("long"), F.col(text_col).cast("string")), strict=True))
    return docs.withColumns(made).join(found, ["__a", "__b"], "left_anti").select(*docs.columns)
