"""Similarity join on word n-grams with a MinHash LSH forest.

Every text becomes its set of n-word shingles. Texts of equal sets are one class, so
exact copies cost one representative. Each of ``trees`` prefix tries holds every text
under ``depth`` MinHash values; in a trie's order, texts that share a prefix stand
together and are its node. Tries are tables: a node's name is a hash of its prefix.

A text begins at the full depth and its prefix is shortened by one value at a time
until the recall expected for it reaches the target. Two texts of similarity t share a
prefix of d values in some trie with the chance p(d) = 1 - (1 - t^d)^trees. A text that
has met c others at depth d, and may miss one more that is just at the threshold, is
expected to have (c + p(d)) / (c + 1) of its partners. So texts in crowded nodes stop
early, at long prefixes, and lonely ones go down to where p(d) alone reaches the target
(7 of 10 values at 0.8, 32 tries and 0.999), which is the shortest prefix ever stored.
Two texts are candidates if they share the prefix at which either of them stops.
Candidates, directly or through others, form a component.

Verification is exact on the whole sets. A component is dealt into chunks of bounded
size; pairs of chunks that hold candidates are compared as blocks by matrix products,
so no list of pairs is ever emitted: a block yields each text's link count and a
spanning forest of its links, and the forests' components are the classes. Counting
the links of m near copies takes (m / chunk)^2 blocks, spread over tasks.

Where only classes are asked for, members of large components are first compared with
the heads of their nodes, one pair each; after that only nodes with members of several
classes need blocks, and in them only texts outside the node's commonest class against
the others, which is linear in m.

Defined results: words are runs without white space. A text with fewer than n words is
one shingle of all of them; one without words, null texts too, is alone in its class
and has no links. Repeated rows are copies of each other. Of equal least ids of a class
the first row read is kept. Rows with a null id take part; a class of such rows only
has a null class_id. Other columns are ignored, whatever they are called; an empty
table gives no rows; texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, materialise, row_keys, slices
from .components import components
from .decontam import Words, factors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_CHUNK, CHUNK = 32, 256  # texts in a chunk of a small and of a large component
CHUNK_SHINGLES = 1 << 20  # the most shingles of a chunk with more than one text
COLUMNS = 4096


class PlainWords(Words):
    def hashes(self, text: str) -> np.ndarray:
        words = WORD.findall(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word windows."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, np.uint64)
    f = factors(n + 1)
    h = np.full(len(words) - n + 1, f[-1], np.uint64)
    for j in range(n):
        h += words[j : j + len(h)] * f[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def min_hashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The upper half of the smallest product with each odd multiplier, in blocks."""
    out = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    step = max(1, (1 << 18) // len(multipliers))
    for i in range(0, len(low), step):
        x = low[i : i + step, None] * multipliers[None, :]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, x.min(0))
    return out


def chance(threshold: float, depth: int, trees: int) -> float:
    """That two texts at the threshold share a prefix of ``depth`` values in some trie."""
    return 1 - (1 - threshold**depth) ** trees


def shortest_prefix(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix, up to ``depth``, that reaches the recall for a lonely text."""
    for k in range(depth, 0, -1):
        if chance(threshold, k, trees) >= recall:
            return k
    raise ValueError("even one value a trie misses the target recall: use more trees")


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int, trees: int, depth: int, least: int) -> DataFrame:
    """(row, doc_id, key_a, key_b, digest, n_shingles, nodes, deep) of every row: per trie the
    prefix of ``least`` values as one hash, and the values beyond, ``bits`` of each, in one number."""
    bits = deep_bits(depth, least)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo = PlainWords()
        multipliers = factors(trees * depth).astype(np.uint32) | np.uint32(1)
        mix = factors(least + 1)
        for batch in slices(batches):
            row, doc_id, key_a, key_b, text = batch.columns
            digests, sizes, nodes, deep = [], [], [], []
            for x in text.to_pylist():
                s = shingle_set(memo.hashes(x or ""), n)
                digests.append(xxhash.xxh128_hexdigest(s.tobytes()))
                sizes.append(len(s))
                if not len(s):
                    nodes.append(np.empty(0, np.int64))
                    deep.append(np.empty(0, np.int64))
                    continue
                m = min_hashes(s, multipliers).reshape(trees, depth).astype(np.uint64)
                h = (m[:, :least] * mix[None, :least]).sum(1) + np.arange(trees, dtype=np.uint64) * mix[least]
                nodes.append((h ^ (h >> np.uint64(31))).view(np.int64))
                more = np.zeros(trees, np.int64)
                for k in range(least, depth):
                    more = (more << bits) | (m[:, k] & np.uint64((1 << bits) - 1)).astype(np.int64)
                deep.append(more)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [row, doc_id, key_a, key_b, pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(nodes, lists), pa.array(deep, lists)],
                ["row", "doc_id", "key_a", "key_b", "digest", "n_shingles", "nodes", "deep"],
            )

    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), *row_keys(doc_id, text), text.alias("text"))
    schema = "row long, doc_id long, key_a long, key_b long, digest string, n_shingles long, nodes array<long>, deep array<long>"
    return chosen.mapInArrow(sign, schema)


def deep_bits(depth: int, least: int) -> int:
    return min(32, 62 // max(1, depth - least))


def candidate_sets(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(key_a, key_b, shingles) of the rows with the given keys, once per key. Sets take more
    room than texts, so they are made again for the few that need them; the texts move
    only where the keys are too many to be broadcast."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = PlainWords()
        for part in slices(batches, 256):
            sets = [shingle_set(memo.hashes(x or ""), n).tobytes() for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(sets, pa.binary())], ["key_a", "key_b", "shingles"])

    text = F.col(text_col).cast("string")
    rows = docs.select(*row_keys(F.col(id_col).cast("long"), text), text.alias("text"))
    rows = rows.join(broadcast_if_small(keys, KEYS), ["key_a", "key_b"], "left_semi")
    return rows.mapInArrow(make, "key_a long, key_b long, shingles binary").dropDuplicates(["key_a", "key_b"])


def forest(members: DataFrame, threshold: float, trees: int, depth: int, least: int, recall: float, scratch: Scratch) -> DataFrame:
    """(row, node, open, head) of the nodes at which texts stop, from (row, tree, node, deep)
    rows of the shortest prefixes. ``open``: the row stops here; others of the node have
    longer prefixes. ``head``: the node's least row."""
    bits = deep_bits(depth, least)
    met = members.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    met = scratch.table(members.join(met, ["tree", "node"]), "lsh-met")

    def at(levels: Column) -> DataFrame:
        prefix = F.expr(f"shiftright(deep, cast({bits} * ({depth} - level) as int))")
        each = met.select("*", F.explode(levels).alias("level"))
        return each.select("row", "level", F.xxhash64("tree", "node", "level", prefix).alias("node"))

    def recall_at(level: Column, others: Column) -> Column:
        p = F.element_at(F.array(*(F.lit(chance(threshold, k, trees)) for k in range(1, depth + 1))), level.cast("int"))
        return (others + p) / (others + 1)

    # How many a row meets at each depth: those of its fullest node. It stops at the
    # longest prefix that is expected to reach the recall.
    levels = F.sequence(F.lit(least), F.lit(depth))
    every = at(levels)
    sizes = every.groupBy("level", "node").agg((F.count("*") - 1).alias("others")).where("others > 0")
    enough = every.join(sizes, ["level", "node"]).groupBy("row", "level").agg(F.max("others").alias("others"))
    stops = enough.where(recall_at(F.col("level"), F.col("others")) >= recall).groupBy("row").agg(F.max("level").alias("stop"))
    stops = scratch.table(stops, "lsh-stops")
    met = met.join(stops, "row", "left").withColumn("stop", F.coalesce("stop", F.lit(least)))
    each = met.select("*", F.explode(F.sequence(F.lit(least), F.col("stop"))).alias("level"))
    prefix = F.expr(f"shiftright(deep, cast({bits} * ({depth} - level) as int))")
    each = each.select("row", F.xxhash64("tree", "node", "level", prefix).alias("node"), (F.col("stop") == F.col("level")).alias("open"))
    each = scratch.table(each, "lsh-trie")
    live = each.groupBy("node").agg(F.count("*").alias("n"), F.min("row").alias("head"), F.max("open").alias("any"))
    live = scratch.table(live.where("n > 1 and any").select("node", "head"), "lsh-live")
    return scratch.table(each.join(live, "node"), "lsh-nodes")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 blocks."""
    values = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b), dtype=np.int32), [len(x) for x in (*a, *b)])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.concatenate([[0], np.cumsum(values[1:] != values[:-1])])
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(column):
        return out
    column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
    edges = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
    for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        block = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        block[owner[i:j], column[i:j] - k * COLUMNS] = 1
        out += block[: len(a)] @ block[len(a) :].T
    return out


def compare(a: dict, b: dict, same: bool, threshold: float) -> tuple[list, list]:
    """Link counts (row, n) and forest edges (u, v) between two chunks, or within one."""
    size_a, size_b = np.array([len(x) for x in a["sets"]]), np.array([len(x) for x in b["sets"]])
    common = intersections(a["sets"], b["sets"])
    linked = common >= threshold * (size_a[:, None] + size_b[None, :] - common) - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    counts = [(r, int(n)) for r, n in zip(a["rows"], linked @ b["weights"], strict=True) if n]
    if not same:
        counts += [(r, int(n)) for r, n in zip(b["rows"], linked.T @ a["weights"], strict=True) if n]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        u, v = a["rows"][i], b["rows"][j]
        if find(u) != find(v):
            parent[find(u)] = find(v)
            edges.append((u, v))
    return counts, edges


SIDES = "u long, v long, n long"


def block(key, table, threshold: float):
    """Compares the two sides of a block, or its one side with itself."""
    sides = [{"rows": [], "weights": [], "sets": []} for _ in range(2)]
    columns = (table.column(x).to_pylist() for x in ("side", "row", "weight", "shingles"))
    for side, row, weight, raw in zip(*columns, strict=True):
        for k, v in (("rows", row), ("weights", weight), ("sets", np.frombuffer(raw, np.uint64))):
            sides[side][k].append(v)
    for s in sides:
        s["weights"] = np.array(s["weights"], np.int64)
    same = key[1].as_py() == key[2].as_py()
    counts, edges = compare(sides[0], sides[0] if same else sides[1], same, threshold)
    rows = [(u, None, c) for u, c in counts] + [(u, v, None) for u, v in edges]
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], ["u", "v", "n"])


def compared(placed: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(u, v, n): link counts (u, n) and forest edges (u, v) of ``placed`` rows (row, root,
    part, parts, weight, shingles). A component of one part is compared as a whole; of
    others, the pairs of parts that share a node (row, node, open) in which one is open."""
    zero = F.lit(0).cast("long")
    one = placed.where("parts = 1").select("root", zero.alias("a"), zero.alias("b"), zero.alias("side"), "row", "weight", "shingles")
    many = placed.where("parts > 1")
    where = many.select("row", "root", "part").join(nodes.select("row", "node", "open"), "row")
    where = scratch.table(where.groupBy("root", "node", "part").agg(F.max("open").alias("open")), "lsh-where")
    left = where.withColumnsRenamed({"part": "a", "open": "open_a"})
    right = where.withColumnsRenamed({"part": "b", "open": "open_b"})
    blocks = left.join(right, ["root", "node"]).where("a <= b and (open_a or open_b)").select("root", "a", "b").distinct()
    blocks = scratch.table(blocks, "lsh-blocks")
    sides = blocks.select("root", "a", "b", zero.alias("side"), F.col("a").alias("part")).unionAll(
        blocks.where("a < b").select("root", "a", "b", (zero + 1).alias("side"), F.col("b").alias("part"))
    )
    split = sides.join(many, ["root", "part"]).select("root", "a", "b", "side", "row", "weight", "shingles")
    run = lambda key, table: block(key, table, threshold)
    return scratch.table(one.unionAll(split).groupBy("root", "a", "b").applyInArrow(run, SIDES), "lsh-links", small=True)


def parts_of(texts: Column, shingles: Column) -> Column:
    """Chunks of a component: of about twice the root of its texts each, within bounds."""
    chunk = F.least(F.greatest(2 * F.sqrt(texts), F.lit(LEAST_CHUNK)), F.lit(CHUNK))
    return F.greatest(F.ceil(texts / chunk), F.ceil(shingles / CHUNK_SHINGLES)).cast("long")


def head_links(placed: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(u, v) links between rows and the heads of their nodes, each pair compared once."""
    pairs = nodes.where("row <> head").select("row", "head").distinct()
    sets = placed.select("row", "shingles")
    heads = sets.withColumnsRenamed({"row": "head", "shingles": "other"})
    both = scratch.table(pairs.join(placed.select("row"), "row"), "lsh-pairs").join(sets, "row").join(heads, "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            row, head, mine, other = batch.columns
            linked = []
            for x, y in zip(mine, other, strict=True):
                a, b = (np.frombuffer(z.as_py(), np.uint64) for z in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(common >= threshold * (len(a) + len(b) - common) - 1e-6)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([row.filter(keep), head.filter(keep)], ["u", "v"])

    chosen = both.select("row", "head", "shingles", "other")
    return scratch.table(chosen.mapInArrow(run, "u long, v long"), "lsh-heads", small=True)


def class_links(placed: DataFrame, nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(u, v) links that give the classes of large components, without counting all links."""
    known = head_links(placed, nodes, threshold, scratch)
    roots = components(known, scratch)
    held = placed.select("row", "root").join(nodes.select("row", "node", "open"), "row")
    held = held.join(roots.select(F.col("u").alias("row"), F.col("root").alias("class")), "row", "left")
    held = scratch.table(held.withColumn("class", F.coalesce("class", "row")), "lsh-held")
    # Nodes with several classes, and the commonest one of each.
    counts = held.groupBy("node", "class").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("node").agg(F.count("*").alias("k"), F.max_by("class", F.struct("n", "class")).alias("common")).where("k > 1")
    mixed = scratch.table(mixed.select("node", "common"), "lsh-mixed")
    left = held.join(mixed, "node").select("row", "root", "node", (F.col("class") != F.col("common")).alias("open"))
    left = scratch.table(left, "lsh-left")
    # Rows that are odd somewhere have chunks of their own, so that the others are not compared among themselves.
    odd = left.groupBy("row", "root").agg(F.max("open").alias("odd"))
    rows = odd.join(placed.select("row", F.octet_length("shingles").alias("bytes")), "row")
    sums = rows.groupBy("root", "odd").agg(F.count("*").alias("m"), F.sum("bytes").alias("s"))
    sums = sums.select("root", "odd", parts_of(F.col("m"), F.col("s") / 8).alias("k"))
    part = F.pmod(F.xxhash64("row"), F.col("k")) * 2 + F.col("odd").cast("long")
    again = odd.join(scratch.table(sums, "lsh-parts"), ["root", "odd"]).select("row", "root", part.alias("part"), F.lit(2).cast("long").alias("parts"))
    again = again.join(placed.select("row", "weight", "shingles"), "row")
    found = compared(scratch.table(again, "lsh-again", small=True), left, threshold, scratch)
    return known.unionAll(found.where("v is not null").select("u", "v"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
    trees: int = 32, depth: int = 10, recall: float = 0.999, count_links: bool = True,
) -> DataFrame:
    """One row per row of docs: doc_id, key_a, key_b, class_id, n_links, is_kept.

    class_id is the least doc_id of the class; n_links counts the other rows whose
    Jaccard similarity is at least the threshold, copies included (null if not
    ``count_links``); is_kept marks one row of a class, that of the least doc_id.
    """
    scratch = Scratch(docs.sparkSession)
    least = shortest_prefix(threshold, trees, depth, recall)
    held = scratch.table(signatures(docs, id_col, text_col, n, trees, depth, least), "lsh-sets", small=True)
    classes = held.where("n_shingles > 0").groupBy("digest")
    classes = scratch.table(classes.agg(F.min("row").alias("rep"), F.count("*").alias("weight")), "lsh-classes")
    reps = held.join(classes.select(F.col("rep").alias("row"), "weight"), "row")
    reps = scratch.table(reps.select("row", "nodes", "deep"), "lsh-reps")
    members = reps.select("row", F.posexplode(F.arrays_zip("nodes", "deep")).alias("tree", "at")).select("row", "tree", F.col("at.nodes").alias("node"), "at.deep")
    nodes = forest(members, threshold, trees, depth, least, recall, scratch)
    groups = components(nodes.select(F.col("row").alias("u"), F.col("head").alias("v")), scratch)
    wide = groups.withColumnRenamed("u", "row").join(held.select("row", "key_a", "key_b", "n_shingles"), "row")
    wide = scratch.table(wide.join(classes.select(F.col("rep").alias("row"), "weight"), "row"), "lsh-wide")
    sums = wide.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    # Written first, so that the join deals its own rows and a large component's can be split.
    sums = scratch.table(sums.select("root", parts_of(F.col("m"), F.col("s")).alias("parts")), "lsh-sizes")
    placed = wide.join(sums, "root").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    sets = candidate_sets(docs, scratch.table(wide.select("key_a", "key_b").distinct(), "lsh-keys"), id_col, text_col, n)
    placed = placed.select("key_a", "key_b", "row", "root", "part", "parts", "weight").join(sets, ["key_a", "key_b"]).drop("key_a", "key_b")
    placed = scratch.table(placed, "lsh-placed", small=True)
    if count_links:
        found = compared(placed, nodes, threshold, scratch)
        links = found.where("v is not null").select("u", "v")
    else:
        found = compared(placed.where("parts = 1"), nodes, threshold, scratch)
        links = found.where("v is not null").select("u", "v")
        large = placed.where("parts > 1")
        if not large.isEmpty():
            links = links.unionAll(class_links(large, nodes, threshold, scratch))
    counts = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("linked"))
    roots = components(links, scratch)
    table = (
        classes.join(roots.withColumnRenamed("u", "rep"), "rep", "left")
        .join(counts.withColumnRenamed("u", "rep"), "rep", "left")
        .select("digest", "weight", F.coalesce("root", "rep").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    )
    rows = held.select("row", "doc_id", "key_a", "key_b", "digest", "n_shingles")
    rows = rows.join(table, F.when(F.col("n_shingles") > 0, rows["digest"]) == table["digest"], "left").drop(table["digest"])
    n_links = F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))
    rows = rows.select(
        "row", "doc_id", "key_a", "key_b", F.coalesce("root", "row").alias("root"),
        (n_links if count_links else F.lit(None).cast("long")).alias("n_links"),
    )
    rows = materialise(rows, "lsh-rows")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    # Written first, so that the join below deals its own rows and a large class can be split.
    heads = materialise(rows.groupBy("root").agg(F.min(order).alias("head")), "lsh-heads")
    scratch.drop()
    out = rows.join(heads, "root")
    return out.select(
        "doc_id", "key_a", "key_b", F.col("head.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("head.row")).alias("is_kept")
    )


#: Keys of 16 bytes that may be broadcast: 8 MB.
KEYS = 500_000


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near duplicates, with its own columns. Texts move only
    where more than ``KEYS`` rows go, or where rows repeat, in those."""
    found = near_duplicates(docs, id_col, text_col, count_links=False, **options)
    # Rows with equal keys are alike in id and text, and so in one class.
    keys = found.groupBy("key_a", "key_b").agg(F.max("is_kept").alias("kept"), F.count("*").alias("n"))
    keys = materialise(keys.where("not kept or n > 1"), "lsh-keys")
    gone, repeated = (keys.where(c).selectExpr("key_a AS __a", "key_b AS __b") for c in ("not kept", "kept and n > 1"))
    made = dict(zip(("__a", "__b"), row_keys(F.col(id_col).cast("long"), F.col(text_col).cast("string")), strict=True))
    keyed = docs.withColumns(made)
    left = keyed.join(broadcast_if_small(gone, KEYS), ["__a", "__b"], "left_anti")
    if not repeated.isEmpty():
        again = broadcast_if_small(repeated, KEYS)
        once = left.join(again, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"])
        left = left.join(again, ["__a", "__b"], "left_anti").unionByName(once)
    return left.select(*docs.columns)
