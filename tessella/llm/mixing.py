"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic. The cells' token
weights are raked to the target share of each margin in turn, until every margin's
shares are within ``tolerance`` of their targets. Targets that contradict each other or the
empty cells are never met: once fifty rakings bring the shares less than a hundredth nearer,
or after ``most`` rakings, that is where it ends, and the difference left is logged as a
warning. A cell's factor is its raked by its own share of tokens. A
document is kept with probability min(1, scale x factor), the scale being such that the
expected tokens are ``budget`` of all; where that reaches 1, ``weight`` (scale x factor)
says how often to repeat the document so that shares come out exactly.

Targets come as (value, share) rows per margin, or else from the corpus: shares to
the power of ``temperature``, normalised. Values without a target get none of the
weight; targets without documents are left out and the rest scaled up; repeated rows of
a target add up. Tokens are words, or the numbers in ``tokens_col`` where given.

Everything is DataFrame functions. Up to ``one_task_cells`` cells (a counted bound)
are raked in one task without exchanges; of more, each margin's sums are aggregated and
joined, so that no task holds all. The driver sees sums and residuals only.

Defined results: null margins are the value '(none)'; a null or empty text has no tokens
and its document is drawn like others of its cell; repeated rows of an id are drawn
together, those of a null id too; an empty table gives no rows; texts of any length
count whole. Columns called topic, n_tokens, prob or weight are replaced by the results;
all others are kept, as long as none begins with two underscores.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, materialise
from .rules import words_of

MARGINS = ("source", "lang", "topic")
#: Values of a margin whose sums may be broadcast.
MANY = 100_000
#: Tests of the residual over which it has to fall by a hundredth.
PATIENCE = 10
log = logging.getLogger("tessella")
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def default_topic(text: Column, n_tokens: Column) -> Column:
    """A coarse kind of text: table, legal, numeric, note or prose."""
    return (
        F.when(text.like("%|%|%"), "table")
        .when(text.like("%License%"), "legal")
        .when(text.rlike("[0-9]{3}"), "numeric")
        .when(n_tokens < 100, "note")
        .otherwise("prose")
    )


def measured(docs: DataFrame, text_col: str = "text", topic=default_topic, tokens_col: str | None = None) -> DataFrame:
    """docs with __source, __lang, __topic and __tokens; all that drawing needs of a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.size(words_of(text)) if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0))
    df = docs.withColumn("__tokens", tokens.cast("long"))
    none = F.lit("(none)")
    return df.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), none), "__lang": F.coalesce(F.col("lang").cast("string"), none),
        "__topic": F.coalesce(topic(text, F.col("__tokens")), none),
    })


def with_target(cells: DataFrame, margin: str, given: DataFrame | None, temperature: float, small: bool, scratch: Scratch) -> DataFrame:
    """cells with ``t_<margin>``, the share its value is to have."""
    if given is not None:
        name, share = given.columns[:2]
        given = given.groupBy(F.col(name).cast("string").alias(margin)).agg(F.sum(F.col(share).cast("double")).alias("t"))
    wanted = F.pow("own", F.lit(temperature)) if given is None else F.coalesce("t", F.lit(0.0))
    if small:
        own = cells.withColumn("own", F.sum("n").over(Window.partitionBy(margin)).cast("double"))
        own = own if given is None else own.join(broadcast_if_small(given, MANY), margin, "left")
        own = own.withColumn("t", wanted)
        # A value's cells count it once between them.
        total = F.sum(F.col("t") * F.col("n") / F.col("own")).over(Window.partitionBy(F.lit(1)))
        return own.withColumn(f"t_{margin}", F.try_divide("t", total)).drop("own", "t")
    values = cells.groupBy(margin).agg(F.sum("n").cast("double").alias("own"))
    values = values if given is None else values.join(given, margin, "left")
    values = scratch.table(values.select(margin, wanted.alias("t")), "mix-targets")
    values = values.select(margin, F.try_divide("t", F.lit(values.agg(F.sum("t")).first()[0])).alias(f"t_{margin}"))
    return cells.join(broadcast_if_small(values, MANY), margin)


def margin_sum(cells: DataFrame, margin: str, small: bool) -> DataFrame:
    """cells with ``own``, the sum of w over the cells of equal margin."""
    if small:
        return cells.withColumn("own", F.sum("w").over(Window.partitionBy(margin)))
    sums = cells.groupBy(margin).agg(F.sum("w").alias("own"))
    return cells.join(broadcast_if_small(sums, MANY), margin)


def rake(cells: DataFrame, rounds: int, small: bool, write) -> DataFrame:
    """``w`` scaled to each margin's targets in turn, ``rounds`` times. Cells of many tasks are
    written after each margin, whose sums and rows are both made of them."""
    for _ in range(rounds):
        for margin in MARGINS:
            cells = margin_sum(cells, margin, small)
            w = F.coalesce(F.try_divide(F.col("w") * F.col(f"t_{margin}"), F.col("own")), F.lit(0.0))
            cells = cells.withColumn("w", w).drop("own")
            cells = cells if small else write(cells)
    return write(cells) if small else cells


def raked(cells: DataFrame, rounds: int, tolerance: float, most: int, small: bool) -> tuple[DataFrame, float, Scratch]:
    """The cells as near to their targets as they come, how near that is, and what holds
    them. The residual is tested after every ``rounds`` rakings, however cells are raked."""
    held, past = None, []
    for _ in range(max(1, -(-most // rounds))):
        last, held = held, Scratch(cells.sparkSession)
        cells = rake(cells, rounds, small, lambda df, held=held: held.table(df.coalesce(1) if small else df, "mix-raked"))
        cells = cells.coalesce(1) if small else cells
        past.append(residual(cells))
        if last:
            last.drop()
        if past[-1] <= tolerance or len(past) > PATIENCE and past[-1] > 0.99 * past[-1 - PATIENCE]:
            break
    if past[-1] > max(tolerance, 1e-9):
        log.warning("targets are not met: after %d rakings shares differ by up to %.3g", rounds * len(past), past[-1])
    return cells, past[-1], held


def residual(cells: DataFrame) -> float:
    """The largest difference between a value's share of w and its target."""
    off = None
    for m in MARGINS:
        x = cells.groupBy(m).agg(F.sum("w").alias("s"), F.max(f"t_{m}").alias("t")).select(F.abs(F.col("s") - F.col("t")).alias("off"))
        off = x if off is None else off.unionAll(x)
    return off.agg(F.max("off")).first()[0] or 0.0


def scale_of(cells: DataFrame, budget: float) -> float:
    """The scale q for which sum(n min(1, q f)) is ``budget`` of all n. Cells that q takes
    whole are set aside and q computed anew for the rest, until they stay the same."""
    every = cells.agg(F.sum("n").cast("double")).first()[0]
    q = 0.0
    while True:
        whole = F.col("f") * F.lit(q) >= 1
        n, spent = cells.agg(F.sum(F.when(whole, F.col("n"))).cast("double"), F.sum(F.when(~whole, F.col("n") * F.col("f")))).first()
        rest = budget * every - (n or 0.0)
        if not spent:
            return q if rest <= 0 else math.inf
        new = rest / spent
        if new <= q * (1 + 1e-12):
            return new
        q = new


def calibrated_cells(
    cells: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: dict[str, float] | None = None,
    rounds: int = 5, tolerance: float = 1e-12, most: int = 1000, budget: float = 0.5, one_task_cells: int = 100_000,
) -> DataFrame:
    """source, lang, topic, prob, weight of (source, lang, topic, n) rows."""
    scratch = Scratch(cells.sparkSession)
    cells = cells.where("n > 0")
    found = cells.limit(one_task_cells + 1).count()
    if not found:
        return cells.select(*MARGINS, F.lit(0.0).alias("prob"), F.lit(1.0).alias("weight"))
    small = found <= one_task_cells
    cells = (cells.coalesce(1) if small else cells).withColumn("w", F.col("n").cast("double"))
    for margin in MARGINS:
        cells = with_target(cells, margin, (targets or {}).get(margin), ({**TEMPERATURE, **(temperature or {})})[margin], small, scratch)
    cells, _, last = raked(cells, rounds, tolerance, most, small)
    all_n, all_w = cells.agg(F.sum("n").cast("double"), F.sum("w")).first()
    f = F.coalesce(F.try_divide(F.col("w") * F.lit(all_n), F.lit(all_w) * F.col("n")), F.lit(0.0))
    cells = cells.withColumn("f", f)
    q = F.when(F.col("f") == 0, F.lit(0.0)).otherwise(F.lit(scale_of(cells, budget)) * F.col("f"))
    out = cells.select(*MARGINS, F.least(q, F.lit(1.0)).alias("prob"), F.greatest(q, F.lit(1.0)).alias("weight"))
    out = materialise(out, "mix-probs")
    scratch.drop()
    last.drop()
    return out


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw(
    df: DataFrame, id_col: str = "doc_id", seed: int = 42, broadcast_rows: int = 50_000, **options,
) -> DataFrame:
    """The drawn rows of ``measured`` ones, with topic, n_tokens, prob and weight added."""
    cells = df.groupBy(*(F.col(f"__{m}").alias(m) for m in MARGINS)).agg(F.sum("__tokens").alias("n"))
    cells = materialise(cells, "mix-cells")
    found = calibrated_cells(cells, **options)
    # Cells without a token are left out of the raking; their documents have none to weigh.
    empty = cells.where("n = 0").select(*MARGINS, F.lit(0.0).alias("prob"), F.lit(1.0).alias("weight"))
    found = found.unionByName(empty).select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.col("prob").alias("__p"), F.col("weight").alias("__w"))
    found = broadcast_if_small(found, broadcast_rows)
    drawn = df.withColumn("__u", uniform(F.col(id_col), seed)).join(found, [f"__{m}" for m in MARGINS]).where("__u < __p")
    made = {"topic": "__topic", "n_tokens": "__tokens", "prob": "__p", "weight": "__w"}
    own = [F.col(c) for c in df.columns if c not in made and not c.startswith("__")]
    return drawn.select(*own, *(F.col(c).alias(name) for name, c in made.items()))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic=default_topic, tokens_col: str | None = None, **options,
) -> DataFrame:
    """The drawn rows of docs with topic, n_tokens, prob and weight added. The texts are
    read twice; where they are not wanted, write ``measured`` rows without them and ``draw``."""
    return draw(measured(docs, text_col, topic, tokens_col), id_col, **options)
