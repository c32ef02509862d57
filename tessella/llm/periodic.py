"""Stretches of a text that repeat themselves: runs of words with a period.

A run is a stretch of consecutive words in which words ``q`` apart are equal, q being the
least such number, of at least ``exponent`` periods and ``least`` words, that no word beside
it continues. Runs of a text are found by lags: a run of period q and n words has n - q
equal pairs at lag q. The pairs of every lag are counted first, exactly: for the words that
are frequent in the text by an autocorrelation through the FFT, for the rare ones by the
differences of their places. Only a lag with as many pairs as a run needs, beyond those of
runs found at its divisors, is scanned for islands of equal pairs.

Each text is a task of its own, of its own length: n log n for each frequent word and
n^1.5 for the rare ones at most, and some 60 bytes a word.

Defined results: null and empty texts have no words and no runs; repeated rows, and rows
with null ids, each give a row; an empty table gives none; words are told apart by their
code points; texts are read whole whatever their length. Only the id and the text are read,
so that other columns may be called anything.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .rules import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def frequent_from(n: int) -> int:
    """Occurrences from which an autocorrelation is cheaper than all pairs of places."""
    return 8 + int(math.sqrt(n * math.log2(n + 1)) / 1.5)


def lag_counts(ids: np.ndarray, top: int) -> np.ndarray:
    """How many words equal the one q places on, for every lag q up to ``top``."""
    n = len(ids)
    counts = np.zeros(top + 1, np.int64)
    often = np.bincount(ids)
    heavy = np.flatnonzero(often > frequent_from(n))
    if len(heavy):
        size = 1 << (n + top).bit_length()  # so long that no lag wraps around
        spectrum = np.zeros(size // 2 + 1)
        for word in heavy:
            f = np.fft.rfft(ids == word, size)
            spectrum += f.real**2 + f.imag**2
        counts += np.rint(np.fft.irfft(spectrum, size)[: top + 1]).astype(np.int64)
    places = np.argsort(ids, kind="stable")
    places = places[often[ids[places]] <= frequent_from(n)]
    words = ids[places]
    at, step = np.arange(len(places)), 0
    while len(at):
        step += 1
        at = at[at + step < len(places)]
        at = at[words[at + step] == words[at]]
        apart = places[at + step] - places[at]
        near = apart <= top  # places rise, so that no later one is nearer
        at = at[near]
        counts += np.bincount(apart[near], minlength=top + 1)
    counts[0] = 0
    return counts


def islands(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of True begin, and where they end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def runs_of(ids: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    top = len(ids) // exponent
    if top < 1 or len(ids) < least:
        return []
    lags = np.arange(top + 1)
    needed = np.maximum(least, exponent * lags) - lags
    left = lag_counts(ids, top)
    found = {}
    for q in np.flatnonzero(left[1:] >= needed[1:]) + 1:
        if left[q] < needed[q]:
            continue
        starts, ends = islands(ids[:-q] == ids[q:])
        enough = ends - starts >= needed[q]
        for start, end in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            length = end - start + int(q)
            if (start, length) in found:  # by a divisor of q, its least period
                continue
            found[start, length] = int(q)
            again = lags[2 * q : length : q]
            left[again] -= length - again  # the run's own pairs at multiples of its period
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words with one period left of each run, joined by single spaces."""
    if not runs:
        return " ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return " ".join(w for w, k in zip(words, kept, strict=True) if k)


def numbered(words: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in slices(batches):
            sizes, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text or "")
                own = runs_of(numbered(words), exponent, least)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                texts.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(id_col: Column, text: Column) -> Column:
    """The texts of a tenth of all ids, told by h = crc32(id), with a period from a word on:
    g = h div 10, word a = g % n, period 1 + (n - a) div (3 + g % 8). Others stay as they are."""
    h = F.crc32(id_col.cast("string"))
    made = F.transform(F.array(F.struct(words_of(text).alias("w"), h.alias("h"))), lambda x: planted(x["w"], x["h"]))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(made, 0)).otherwise(text)


def planted(words: Column, h: Column) -> Column:
    n, g = F.size(words), F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")


def digests(runs: Column) -> dict[str, Column]:
    """n_runs; start, length, period and exponent of the longest run; a digest of all."""
    first = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 0)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    length = -first["l"]
    return {
        "n_runs": F.size(runs).cast("long"), "start": first["s"], "length": length, "period": first["p"],
        "exponent_milli": F.floor(length * 1000 / first["p"]).cast("long"), "runs_sha256": F.sha2(listed, 256),
    }
