"""Quality rules: text statistics and a learned decision list, all in Spark's own
expressions.

Statistics are column expressions over the whole text. The list is learned by
sequential covering: a rule grows one threshold at a time by information gain on
two thirds of the labelled rows and is cut back on the other third; rows it covers
leave, and the next rule grows. Spark aggregates counts per feature and threshold;
the driver sees only those, a bounded number. The result is a chain of
``when(conditions, verdict)``.

Defined results: a null text counts as empty and has no words; texts of any length
count whole; repeated rows each give a row; of a document's repeated labels the mean
decides, a tie counting as good; of conditions with equal gain the first feature and
least threshold is taken; without labels, or with one class only, the list is empty and
keeps what the base rules keep; an empty table gives no rows and an empty list. Columns
named like results are replaced by them in ``apply_rules``, all others are kept; in
``passing`` every column is kept as it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hashed_sample, materialise

WINDOW = 8
SPLIT = r"[\x20\x09-\x0D]+"
#: Learned on: shares and means that mean the same for short and long texts.
FEATURES = (
    "f_symbols", "f_upper", "f_digits", "f_bangs", "f_punctuation", "f_word_length", "f_dup_lines",
    "f_repeats", "f_adjacent", "f_distinct", "f_line_words", "f_words",
)


def words_of(text: Column) -> Column:
    """The runs without white space, as an array."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT))


def count_of(text: Column, outside: str) -> Column:
    """How many characters are left without runs of ``outside``."""
    return F.length(F.regexp_replace(text, outside, "")).cast("long")


def share(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def repeated_cover(hashes: Column) -> Column:
    """From an array sorted by (h, i) of window hashes: words that lie in a window
    with a hash that another window has."""
    def again(x, i):
        near = [F.coalesce(F.get(hashes, i + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
        return near[0] | near[1]

    at = F.sort_array(F.transform(F.filter(hashes, again), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
    )
    return F.aggregate(at, start, step, lambda acc: acc["n"])


def text_statistics(docs: DataFrame, text_col: str = "text", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """docs with the base counts and the named ``FEATURES`` of each text added; only those are
    computed. Names of docs are neither those nor begin with two underscores, but for __id and __bad."""
    own = docs.columns
    t, w, h = F.col("__text"), F.col("__words"), F.col("__hash")
    df = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumns({"__words": words_of(t), "__lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    df = df.withColumns({"__hash": F.transform(w, lambda x: F.xxhash64(x)), "n_words": F.size(w).cast("long")})
    window = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + d) for d in range(1, WINDOW))))
    window = F.slice(window, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("__windows", window)
    g = F.col("__windows")
    some = F.size(F.array_distinct(g)) < F.size(g)
    pairs = F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(some, F.sort_array(pairs)))
    lines = F.col("__lines")
    chars = F.length(t).cast("long")
    df = df.withColumns({
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": count_of(t, "[^#*$%&|<>]+"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.col("__sorted").isNotNull(), repeated_cover(F.col("__sorted"))).otherwise(F.lit(0)).cast("long"),
        "__adjacent": F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i + 1), F.lit(False)))),
        "__distinct": F.size(F.array_distinct(h)),
        "__n_lines": F.size(lines),
        "__chars": chars,
        "__upper": count_of(t, r"\P{Lu}+"),
        "__digits": count_of(t, "[^0-9]+"),
        "__bangs": count_of(t, "[^!?]+"),
        "__punctuation": count_of(t, "[^.,;:]+"),
    })
    n = F.col("n_words")
    df = df.withColumns({
        "f_symbols": share(F.col("n_symbols"), F.col("__chars")),
        "f_upper": share(F.col("__upper"), F.col("__chars")),
        "f_digits": share(F.col("__digits"), F.col("__chars")),
        "f_bangs": share(F.col("__bangs"), F.col("__chars")),
        "f_punctuation": share(F.col("__punctuation"), F.col("__chars")),
        "f_word_length": share(F.col("word_chars"), n),
        "f_dup_lines": share(F.col("n_dup_lines"), F.col("__n_lines")),
        "f_repeats": share(F.col("n_repeat_words"), n),
        "f_adjacent": share(F.col("__adjacent"), n),
        "f_distinct": share(F.col("__distinct"), n),
        "f_line_words": share(n, F.col("__n_lines")),
        "f_words": F.log2(n + F.lit(1.0)),
        "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
    })
    # Filters on the results would be pushed below, and repeat all of this per element
    # of the arrays above; they do not pass a generator.
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *features)
    return df.select(*own, F.inline(F.array(F.struct(*made))))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def all_of(conditions: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in conditions], F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects, as an ordered conditional expression."""
    out = None
    for rule in rules:
        out = F.when(all_of(rule), False) if out is None else out.when(all_of(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, taken by a hash of the id; ``__bad``: label 0."""
    each = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    each = each.groupBy(F.col(id_col).cast("long").alias("__id")).agg((F.avg(label_col) < 0.5).cast("long").alias("__bad"))
    return hashed_sample(each, "__id", limit)


def with_bins(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """rows with ``k_<feature>``, how many cuts lie below the value."""
    def below(f: str) -> Column:
        listed = F.array(*map(F.lit, cuts[f]))
        return F.size(F.filter(listed, lambda c: c < F.col(f)))

    return rows.withColumns({f"k_{f}": below(f) for f in cuts})


def sums_by_bin(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """(good, bad) rows of every bin of every feature; bin k lies above k cuts."""
    each = [F.struct(F.lit(i).alias("f"), F.col(f"k_{f}").alias("k")) for i, f in enumerate(cuts)]
    stacked = rows.select("__bad", F.inline(F.array(*each))).groupBy("f", "k")
    out, names = {f: [(0, 0)] * (len(c) + 1) for f, c in cuts.items()}, list(cuts)
    for r in stacked.agg(F.sum(1 - F.col("__bad")).alias("good"), F.sum("__bad").alias("bad")).collect():
        out[names[r["f"]]][r["k"]] = (r["good"], r["bad"])
    return out


def best_condition(sums: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]], least: int):
    """The threshold with the largest information gain for bad rows, and its counts."""
    best, found = 0.0, None
    for f, bins in sums.items():
        good, bad = (sum(x[i] for x in bins) for i in (0, 1))
        if not bad or not good:
            continue
        before = math.log2(bad / (bad + good))
        low_good = low_bad = 0
        for k, cut in enumerate(cuts[f]):
            low_good, low_bad = low_good + bins[k][0], low_bad + bins[k][1]
            for above, g, b in ((False, low_good, low_bad), (True, good - low_good, bad - low_bad)):
                if b >= least and (gain := b * (math.log2(b / (b + g)) - before)) > best + 1e-9:
                    best, found = gain, (Condition(f, above, cut), g, b)
    return found


def centred(rows: DataFrame, rule: Rule) -> Rule:
    """The rule with each threshold halfway between the values on its two sides."""
    sides = rows.agg(*(
        f(F.when(c.column() == above, F.col(c.feature))).alias(f"{n}{k}")
        for k, c in enumerate(rule)
        for n, f, above in (("in", F.min if c.above else F.max, True), ("out", F.max if c.above else F.min, False))
    )).first()
    return tuple(
        Condition(c.feature, c.above, (sides[f"in{k}"] + sides[f"out{k}"]) / 2)
        if sides[f"in{k}"] is not None and sides[f"out{k}"] is not None else c
        for k, c in enumerate(rule)
    )


def learn_rules(
    stats: DataFrame, max_rules: int = 6, max_conditions: int = 3, bins: int = 24, least: int = 3, precision: float = 0.9
) -> list[Rule]:
    """Decision list over rows with ``__id``, ``__bad`` and ``FEATURES``."""
    at = [i / bins for i in range(1, bins)]
    marks = F.array(*map(F.lit, at))
    q, bad = (
        x.agg(*(F.percentile_approx(f, marks, F.lit(10_000)).alias(f) for f in FEATURES)).first()
        for x in (stats, stats.where("__bad = 1"))
    )
    cuts = {f: sorted({float(x) for r in (q, bad) for x in (r[f] or [])}) for f in FEATURES}
    cuts = {f: c for f, c in cuts.items() if c}
    grown = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(3)) > 0
    left, rules = materialise(with_bins(stats, cuts), "rules-bins"), []
    while len(rules) < max_rules and cuts:
        rule: list[Condition] = []
        rows = left.where(grown)
        while len(rule) < max_conditions:
            found = best_condition(sums_by_bin(rows, cuts), cuts, least)
            if not found:
                break
            rule.append(found[0])
            rows = rows.where(found[0].column())
            if not found[1]:
                break
        if not rule:
            break
        # Cut back to the prefix with the best share on the rows that grew nothing.
        prefixes = [tuple(rule[: k + 1]) for k in range(len(rule))]
        counts = left.where(~grown).agg(
            *(F.sum(F.when(all_of(p), v)).alias(f"{n}{k}") for k, p in enumerate(prefixes) for n, v in (("b", F.col("__bad")), ("a", F.lit(1))))
        ).first()
        scored = [((counts[f"b{k}"] or 0), (counts[f"a{k}"] or 0), p) for k, p in enumerate(prefixes)]
        b, a, chosen = max(scored, key=lambda x: ((x[0] + 1) / (x[1] + 2), -len(x[2])))
        if a < 1 or b < precision * a:
            break
        chosen = centred(left, chosen)
        rules.append(chosen)
        left = left.where(~all_of(chosen))
    return rules


def fit_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 20_000, **options,
) -> list[Rule]:
    """Learns from at most ``sample`` labelled ids; of repeated rows each counts."""
    chosen = labelled_sample(labels, id_col, label_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__body"))
    rows = rows.join(F.broadcast(chosen), "__id")  # 16 bytes a row and ``sample`` rows at most
    stats = text_statistics(rows, "__body").where("not base_failed").select("__id", "__bad", *FEATURES)
    return learn_rules(materialise(stats, "rules-stats"), **options)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(docs: DataFrame, rules: list[Rule], text_col: str) -> DataFrame:
    """``RESULTS`` beside the columns of docs, which are called own0, own1 and so on."""
    used = tuple(f for f in FEATURES if any(c.feature == f for rule in rules for c in rule))
    plain = docs.toDF(*(f"own{i}" for i in range(len(docs.columns))))
    df = text_statistics(plain, f"own{docs.columns.index(text_col)}", used)
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with the base counts, base_failed and kept."""
    own = [F.col(f"own{i}").alias(c) for i, c in enumerate(docs.columns) if c not in RESULTS]
    return judged(docs, rules, text_col).select(*own, *RESULTS)


def passing(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that apply_rules keeps, with their own columns only, whatever these are called."""
    kept = judged(docs, rules, text_col).where("kept")
    return kept.select(*(f"own{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
