"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text's token count is the
sum over its distinct pre-tokens of frequency times pieces. Pieces are counted
once per distinct pre-token of the whole corpus and joined to the frequencies.

Plan: (1) one Python pass writes each document's distinct pre-tokens and their
frequencies; (2) the corpus vocabulary is aggregated from that table and its
pieces counted; (3) the most frequent pre-tokens, a bounded number of bounded
length, are broadcast, so that no hot word is ever shuffled: a histogram of their
frequencies, a few hundred numbers, gives the cut; (4) the tail is joined by a
shuffle. Sums are per row, so repeated rows each keep theirs.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
each give a row; other columns are ignored, whatever they are called; an empty table
gives none; very long texts are counted whole, and their pre-tokens are one row each.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Characters whose classes (letter, decimal digit, space, other) every Unicode version
#: and the standard library agree on. Texts with others are split by the tokenizer's own
#: splitter.
UNSTABLE = re.compile(
    "[^\t\n\r -~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-Ωα-ωА-я"
    "–—‘-”•…€ぁ-ゖァ-ヺ一-龥가-힣]"
)
#: The vocabulary's pattern for such texts, in the standard library's words.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Longest pre-token, in bytes, and number of pre-tokens that may be broadcast: 12 MB at most.
HOT_BYTES, HOT_ROWS = 48, 200_000
#: Rows whose frequencies a task holds at once.
ROWS = 128


def load(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


class Splitter:
    """Cuts a text into the pre-tokens of a byte-level BPE; special strings,
    which the library takes as one token by default, are pre-tokens too."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import pre_tokenizers

        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
            spec = json.load(file)
        # The whole tokenizer takes much memory; its splitter is all that is used here.
        self.own = pre_tokenizers.ByteLevel(add_prefix_space=spec["pre_tokenizer"]["add_prefix_space"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

    def parts(self, text: str) -> list[str]:
        if UNSTABLE.search(text):
            cut = self.own.pre_tokenize_str(text)
            return [text[a:b] for _, (a, b) in cut]
        return SPLIT.findall(text)

    def count(self, text: str) -> Counter:
        found: Counter = Counter()
        end = 0
        for m in self.special.finditer(text):
            found.update(self.parts(text[end : m.start()]))
            found[m[0]] += 1
            end = m.end()
        found.update(self.parts(text[end:] if end else text))
        return found


def most_used(vocab: DataFrame) -> DataFrame:
    """(pre, n_pieces) of the short pre-tokens used most, ``HOT_ROWS`` at most: those from a
    frequency on that is found on a scale of eighths of powers of two."""
    step = F.floor(F.log2("used") * 8).cast("int")
    short = vocab.where(F.octet_length("pre") <= HOT_BYTES).withColumn("step", step)
    rows, cut = 0, 1 << 30
    for r in short.groupBy("step").count().orderBy(F.desc("step")).collect():  # 512 rows at most
        rows += r["count"]
        if rows > HOT_ROWS:
            break
        cut = r["step"]
    return short.where(F.col("step") >= cut).select("pre", "n_pieces")


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 1024,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            row, doc_id, text = batch.columns
            texts = [x or "" for x in text.to_pylist()]
            counts = [splitter.count(x) for x in texts]
            ends = np.cumsum([0, *map(len, counts)])
            pairs = pa.StructArray.from_arrays(
                [pa.array([k for c in counts for k in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], ["pre", "freq"]
            )
            n_bytes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [row, doc_id, n_bytes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["row", "doc_id", "n_bytes", "counts"]
            )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n = [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["pre", "used", "n_pieces"]
            )

    chosen = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    held = materialise(
        chosen.mapInArrow(
            frequencies, "row long, doc_id long, n_bytes long, counts array<struct<pre: string, freq: bigint>>"
        ),
        "token-freq",
    )
    long = held.select("row", F.inline("counts"))
    used = held.select(F.inline("counts")).groupBy("pre").agg(F.sum("freq").alias("used"))
    vocab = materialise(used.mapInArrow(pieces, "pre string, used long, n_pieces long"), "token-vocab")
    hot = materialise(most_used(vocab), "token-hot")
    weight = (F.col("freq") * F.col("n_pieces")).alias("n")
    # Only ``row`` travels with the pre-tokens; each row's own values join its sum at the end.
    own = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_bytes")]
    common = long.join(F.broadcast(hot), "pre").select("row", weight, *own)
    rare = (
        long.join(F.broadcast(hot.select("pre")), "pre", "left_anti")
        .join(vocab.select("pre", "n_pieces"), "pre")
        .select("row", weight, *own)
    )
    none = held.select("row", F.lit(0).cast("long").alias("n"), "doc_id", "n_bytes")
    total = common.unionAll(rare).unionAll(none).groupBy("row")
    total = total.agg(F.sum("n").alias("n_tokens"), F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
