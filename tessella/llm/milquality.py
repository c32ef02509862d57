"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded: shares of character classes,
repetition and word shape, and hashed word counts. A hidden layer follows; gated
attention (a softmax over a passage's tanh branch times its sigmoid branch) weighs
the passages, and the weighted sum is scored by a logistic unit. Only document
labels are known, so that the attention is learned from them alone.

Training runs on the driver, on at most ``sample`` labelled documents that are not
held out, chosen by a hash of their ids, and on at most ``passages`` evenly spaced
passages of each: 13 MB of features a thousand documents. Scoring covers all rows and
all passages.

Defined results: null texts count as empty; a text without words is one passage of
zeros; repeated rows each give a row, and of an id's rows the text that sorts first is
learned from; of repeated labels the mean decides, a tie counts as 1; null labels are
left out; with labels of one class, or none, every score is their share (0.5 for none);
other columns are ignored, whatever they are called; an empty table gives no rows and
teaches nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = 128
BUCKETS = 32
#: Classes of bytes; the rest are letters of no class (0) by default.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#*$%&", "|<>", "\"'()[]{}", "@/\\_=+-~^`", " \t\n\r\x0b\x0c")
TABLE = np.zeros(256, np.uint8)
for _k, _c in enumerate(CLASSES, 1):
    TABLE[np.frombuffer(_c.encode(), np.uint8)] = _k
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES + 7 + BUCKETS


def encode(text: str) -> np.ndarray:
    """One row of features per passage of PASSAGE words."""
    import xxhash

    words = WORD.findall(text)
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    lines = [x for x in text.split("\n") if x.strip()]
    dup_lines = 1 - len(set(lines)) / max(1, len(lines))
    per_line = min(1.0, len(lines) / len(words))
    starts = range(0, len(words), PASSAGE)
    out = np.zeros((len(starts), N_FEATURES), np.float32)
    for row, i in zip(out, starts, strict=True):
        part = words[i : i + PASSAGE]
        raw = np.frombuffer(" ".join(part).encode(), np.uint8)
        row[:N_CLASSES] = np.bincount(TABLE[raw], minlength=N_CLASSES) / len(raw)
        counts = Counter(part)
        n = len(part)
        row[N_CLASSES : N_CLASSES + 7] = (
            len(raw) / n / 10, len(counts) / n, max(counts.values()) / n,
            sum(map(eq, part, part[1:])) / n, dup_lines, per_line, min(1.0, n / PASSAGE),
        )
        for word, k in counts.items():
            row[N_CLASSES + 7 + xxhash.xxh32_intdigest(word) % BUCKETS] += k / n
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMIL:
    """h = tanh(xW + b); a = softmax(w (tanh(hV) * sigmoid(hU))); score = sigmoid(sum(a h) u + c)."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.p = mean, scale, params

    @classmethod
    def start(cls, x: np.ndarray, hidden: int, gates: int, rng) -> AttentionMIL:
        r = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        d = x.shape[1]
        params = {"W": r(d, hidden), "b": np.zeros(hidden), "V": r(hidden, gates), "U": r(hidden, gates), "w": r(gates, 1)[:, 0], "u": r(hidden, 1)[:, 0], "c": np.zeros(1)}
        return cls(x.mean(0), x.std(0) + 1e-3, params)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """Scores of the bags that begin at ``starts``, and what backward() needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "sizes": sizes, "y": sigmoid(z @ p["u"] + p["c"])}

    def gradients(self, f: dict, target: np.ndarray, starts: np.ndarray) -> dict:
        p, n = self.p, len(target)
        dy = (f["y"] - target) / n
        out = {"u": f["z"].T @ dy, "c": np.array([dy.sum()])}
        dz = np.repeat(dy, f["sizes"])[:, None] * p["u"]
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        tg = ds[:, None] * p["w"]
        out["w"] = (f["t"] * f["g"]).T @ ds
        dt, dg = tg * f["g"] * (1 - f["t"] ** 2), tg * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dh *= 1 - f["h"] ** 2
        out["W"], out["b"] = f["x"].T @ dh, dh.sum(0)
        return out

    def train(self, bags: list[np.ndarray], target: np.ndarray, epochs: int, rng, rate: float = 0.01, decay: float = 1e-4, batch: int = 256) -> None:
        """Adam over shuffled batches of bags."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                starts = np.concatenate([[0], np.cumsum([len(bags[j]) for j in part])[:-1]]).astype(int)
                f = self.forward(np.concatenate([bags[j] for j in part]), starts)
                step += 1
                for k, g in self.gradients(f, target[part], starts).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


def spaced(bag: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows of a bag, evenly spaced."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).astype(int)]


def remainder(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(3))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 4000, passages: int = 64, hidden: int = 24, gates: int = 16, epochs: int = 40, seed: int = 7,
) -> AttentionMIL | float:
    """The model, or the share of label 1 where there is nothing to tell apart."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 1))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("__y"))
    known = hashed_sample(known, "__id", sample)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [spaced(encode(t or ""), passages).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["id", "y", "raw"])

    chosen = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    chosen = chosen.join(F.broadcast(known), "__id")  # at most ``sample`` rows of 16 bytes
    chosen = chosen.groupBy("__id", "__y").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))  # one row an id
    rows = chosen.mapInArrow(encoded, "id long, y double, raw binary").toArrow().sort_by([("id", "ascending"), ("raw", "ascending")])
    target = rows["y"].to_numpy()
    if not len(target) or target.min() == target.max():
        return float(target.mean()) if len(target) else 0.5
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows["raw"].to_pylist()]
    rng = np.random.default_rng(seed)
    model = AttentionMIL.start(np.concatenate(bags), hidden, gates, rng)
    model.train(bags, target, epochs, rng)
    return model


def score(docs: DataFrame, model: AttentionMIL | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_attention for every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, held, text = batch.columns
            for lo in range(0, len(batch), 256):
                bags = [encode(t or "") for t in text[lo : lo + 256].to_pylist()]
                sizes = np.array([len(x) for x in bags])
                if isinstance(model, float):
                    y, top = np.full(len(bags), model), 1 / sizes
                else:
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    f = model.forward(np.concatenate(bags), starts)
                    y, top = f["y"], np.maximum.reduceat(f["a"], starts)
                yield pa.RecordBatch.from_arrays(
                    [doc_id[lo : lo + 256], held[lo : lo + 256], pa.array(y), pa.array((y >= 0.5).astype(np.int32)), pa.array(sizes, pa.int64()), pa.array(top)],
                    ["doc_id", "held_out", "score", "predicted", "n_passages", "top_attention"],
                )

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(F.col(id_col)) == 1, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_attention double"
    return chosen.mapInArrow(scored, schema)
