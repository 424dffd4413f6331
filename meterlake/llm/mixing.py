"""Mixing sources to target weights by iterative proportional fitting.

The tokens of a corpus are counted by cell (source, language, topic). Raking multiplies the cells' weights, margin by margin and round by
round, until each margin's shares are the target's to TOLERANCE; the weights then differ from the counts by a factor for each source,
language and topic. Targets that no weights meet at once are warned of, with how far off they stay.
A document of a cell is drawn with probability rate * weight / tokens of the cell. Draws are hashes of the document's key and text, so a run
can be repeated and rows don't depend on each other. How much is drawn:

* With a budget, that share of the tokens is expected, however small a cell is. Probabilities stop at 1: a value that has fewer tokens than
  its share is drawn whole and the others make up for it by their shares; a cell that reaches 1 stays there and the rest is raked on.
* Without, the rate is the largest that keeps every probability at most 1, or the one asked for if that is smaller. Margins are the targets'
  in expectation, but the rarest cell decides how much of the corpus is drawn.

Targets are shares by value; values without a target keep their own share of what the others leave (a share of 0 drops them). By default a
margin's target is tempered: shares to the power TEMPER, so large sources shrink and small ones grow.

The topic of a document is one of TOPICS classes of words by hash: the one whose share of the text's words exceeds its share of the corpus
most. It stands in for a topic model and is a column like the others: an input's own `topic` column is used where asked for.

Cells are a table like any other, never collected: there may be millions of sources. Up to AT_ONCE cells are raked by one task; beyond, a
round is three small aggregates and joins. Only the largest deviation of a margin reaches the driver.

Cases: null source or language is a value of its own; null and empty texts have no tokens, weigh nothing and are never drawn; repeated rows
count and are drawn together; an empty input gives an empty result.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bind, blank_null, dropped, whole_row, written

TOPICS = 8
TEMPER = 0.7
RATE = 1.0
#: Share of the tokens that the query and the pipeline's stage draw.
BUDGET = 0.7
#: Raking ends when no margin is off by more, or when so many rounds bring it no nearer.
TOLERANCE = 1e-6
PATIENCE = 50
#: Cells that one task rakes in memory.
AT_ONCE = 1 << 20
MARGINS = ("source", "lang", "topic")
SEPARATORS = r"[\x20\x09-\x0D]+"
DRAWS = 1 << 40


def topic_counts(text: Column, topics: int = TOPICS) -> Column:
    """array<bigint>: how many words of a text are in each class."""
    classes = F.transform(F.array_remove(F.split(text, SEPARATORS), ""), lambda w: F.pmod(F.xxhash64(w), F.lit(topics)).cast("int"))
    return bind(classes, lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(c, F.lit(t)))).cast("bigint") for t in range(topics)]))


def described(docs: DataFrame, topics: int = TOPICS, texts: bool = True) -> DataFrame:
    """docs with n_tokens (words), topic and a number to draw by; written, so that texts are split once. texts: keep them."""
    row = whole_row(docs, "n_tokens", "topic", "draw", *[] if texts else ["text"]).alias("row")
    counted = written(docs.select(row, topic_counts(blank_null(), topics).alias("words"), draw_number(docs).alias("draw")), "described")
    sums = counted.agg(*[F.coalesce(F.sum(F.get("words", F.lit(i))), F.lit(0)).alias(f"w{i}") for i in range(topics)]).first()
    total = max(1, sum(sums))
    tokens = F.aggregate("words", F.lit(0).cast("bigint"), lambda a, x: a + x)
    shares = F.array(*[F.lit(s / total) for s in sums])
    excess = F.transform("words", lambda w, i: F.struct((w / F.greatest(F.col("n_tokens"), F.lit(1)) - F.get(shares, i)).alias("by"), (-i).alias("first")))
    counted = counted.withColumn("n_tokens", tokens)
    topic = F.when(F.col("n_tokens") > 0, (-F.array_max(excess)["first"]).cast("int"))
    return counted.select("row.*", "draw", "n_tokens", topic.alias("topic"))


def draw_number(docs: DataFrame, key: str = "doc_id", seed: int = 11) -> Column:
    return F.xxhash64(key, "text", F.lit(seed))


def targets_for(cells: DataFrame, margin: str, given: dict | None = None, temper: float = TEMPER) -> DataFrame:
    """(_value, target) with targets that sum to 1: the given shares, or the counts' shares tempered."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens"))
    if given:
        spark = cells.sparkSession
        kind = cells.schema[margin].dataType.simpleString()
        asked = spark.createDataFrame(list(given.items()), f"_value {kind}, share double")
        left = max(0.0, 1.0 - sum(given.values()))
        sums = sums.join(F.broadcast(asked), F.col(margin).eqNullSafe(F.col("_value")), "left").drop("_value")
        rest = sums.agg(F.sum(F.when(F.col("share").isNull(), F.col("tokens")))).first()[0]
        sums = sums.withColumn("weight", F.coalesce("share", F.col("tokens") * F.lit(left / rest if rest else 0.0)))
    else:
        sums = sums.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(temper)))
    total = sums.agg(F.sum("weight")).first()[0] or 1.0
    return sums.select(F.col(margin).alias("_value"), (F.col("weight") / F.lit(total)).alias("target"))


def settled(trail: list[float], tolerance: float) -> bool:
    """Whether raking is done, from the largest deviation of each round: within the tolerance, or no nearer than PATIENCE rounds ago."""
    return trail[-1] < tolerance or (len(trail) > PATIENCE and trail[-1] > 0.99 * trail[-1 - PATIENCE])


def _rake_at_once(margins: list[str], tolerance: float):
    def run(batches):
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        weight, cap = rows["weight"].to_numpy(), rows["cap"].to_numpy()
        fixed = np.isinf(weight)
        steps = []
        for m in margins:
            code = pc.dictionary_encode(rows[m].combine_chunks(), null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            goal = np.zeros(code.max() + 1)
            goal[code] = rows[f"_target_{m}"].to_numpy()
            steps.append((code, goal))
        trail: list[float] = []
        while not trail or not settled(trail, tolerance):
            worst = 0.0
            for code, goal in steps:
                full = np.bincount(code, np.where(weight >= cap, cap, 0.0), len(goal))
                free = np.bincount(code, np.where(weight >= cap, 0.0, weight), len(goal))
                off = np.divide(goal, full + free, out=np.zeros_like(goal), where=full + free > 0)
                by = np.divide(goal - full, free, out=off.copy(), where=(free > 0) & (goal > full))
                weight = np.where(fixed, weight, weight * by[code])
                worst = max(worst, np.abs(off[code][weight > 0] - 1.0).max(initial=0.0))
            trail.append(worst)
        out = rows.drop_columns([*(f"_target_{m}" for m in margins), "cap", "weight"]).append_column("weight", pa.array(np.minimum(weight, cap))).append_column("_worst", pa.array(np.full(len(weight), trail[-1])))
        yield from out.to_batches(1 << 14)

    return run


def _rake_tables(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float) -> tuple[DataFrame, float]:
    """Every step writes the cells with one margin set right and drops the state before; it moves one row a cell and one a value."""
    state, first, trail = cells, True, []
    over = F.col("weight") >= F.col("cap")
    while not trail or not settled(trail, tolerance):
        worst = 0.0
        for m, target in targets.items():
            now = state.groupBy(F.col(m).alias("_now")).agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"))
            ratio = F.coalesce(F.col("target") / F.nullif(F.col("full") + F.col("free"), F.lit(0.0)), F.lit(0.0))
            by = F.when((F.col("free") > 0) & (F.col("target") > F.col("full")), (F.col("target") - F.col("full")) / F.col("free")).otherwise(ratio)
            off = now.join(target, F.col("_now").eqNullSafe(F.col("_value"))).select("_value", ratio.alias("_off"), by.alias("_by"))
            new = state.join(off, F.col(m).eqNullSafe(F.col("_value")), "left")
            new = new.withColumn("weight", F.when(F.col("weight") == float("inf"), F.col("weight")).otherwise(F.col("weight") * F.coalesce("_by", F.lit(0.0))))
            seen = Observation()
            new = new.observe(seen, F.max(F.when(F.col("weight") > 0, F.abs(F.col("_off") - 1.0))).alias("off")).select(*cells.columns)
            new = written(new, "weights", release=False)
            worst = max(worst, seen.get["off"] or 0.0)
            if not first:
                dropped(state)
            state, first = new, False
        trail.append(worst)
    return state.withColumn("weight", F.least("weight", "cap")).drop("cap"), trail[-1]


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, at_once: int = AT_ONCE) -> DataFrame:
    """cells (margins, tokens) with weight: shares whose margins are the targets. Cells that no weights can serve get none.

    Goes on until no margin is off by the tolerance; where no weights meet the targets, a warning tells how far off they stay. Up to
    `at_once` cells are raked by one task in memory, more as tables. Cells may bring a cap that their weight stops at, and a weight to
    start from; an infinite one stays at the cap. A margin's step then moves what is below the caps.
    """
    kept = [f for f in cells.schema.fields if f.name not in ("cap", "weight")]
    if "cap" not in cells.columns:
        cells = cells.withColumns({"cap": F.lit(float("inf")), "weight": F.col("tokens").cast("double")})
    if cells.count() > at_once:
        raked, worst = _rake_tables(cells, targets, tolerance)
    else:
        rows = cells
        for m, target in targets.items():
            goal = target.select(F.col("_value").alias("_of"), F.col("target").alias(f"_target_{m}"))
            rows = rows.join(goal, F.col(m).eqNullSafe(F.col("_of")), "left").drop("_of").fillna(0.0, [f"_target_{m}"])
        rows = rows.repartition(1).sortWithinPartitions(*targets)
        kind = T.StructType([*kept, T.StructField("weight", T.DoubleType()), T.StructField("_worst", T.DoubleType())])
        seen = Observation()
        raked = written(rows.mapInArrow(_rake_at_once(list(targets), tolerance), kind).observe(seen, F.max("_worst").alias("worst")).drop("_worst"), "weights", release=False)
        worst = seen.get["worst"] or 0.0
    if worst >= tolerance:
        warnings.warn(f"mixing: no weights meet the targets of {', '.join(targets)} at once; the largest share off stays {worst:.2g} off", stacklevel=2)
    return raked


def level(sums: DataFrame, amount: float) -> float:
    """The factor for which least(most, factor * target), summed over the rows, is the amount."""
    factor = 0.0
    while True:
        full = F.col("most") <= F.col("target") * F.lit(factor)
        have, rest = sums.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("target")))).first()
        if not rest:
            return float("inf")
        new = (amount - (have or 0)) / rest
        if new <= factor * (1 + 1e-12):
            return factor
        factor = new


def budgeted(cells: DataFrame, targets: dict[str, DataFrame], budget: float) -> tuple[DataFrame, dict[str, DataFrame]]:
    """cells with caps, and targets in tokens that add up to `budget` of the corpus, or to all that the targets leave.

    A value with fewer tokens than its share gives all it has, whole; the others make up for it by their shares.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    live = F.lit(True)
    for m, target in targets.items():
        goal = target.select(F.col("_value").alias("_of"), F.col("target").alias(f"_target_{m}"))
        cells = cells.join(goal, F.col(m).eqNullSafe(F.col("_of")), "left").drop("_of")
        live = live & (F.coalesce(f"_target_{m}", F.lit(0.0)) > 0)
    cells = written(cells.withColumn("_live", live).drop(*[f"_target_{m}" for m in targets]), "live", release=False)
    amount = min(budget * total, cells.where("_live").agg(F.sum("tokens")).first()[0] or 0)
    goals, whole = {}, F.lit(False)
    out = cells
    for m, target in targets.items():
        sums = cells.where("_live").groupBy(m).agg(F.sum("tokens").alias("most")).join(target, F.col(m).eqNullSafe(F.col("_value"))).select("_value", "target", "most")
        sums = written(sums, "most", release=False)
        share = F.col("target") * F.lit(level(sums, amount))
        goals[m] = written(sums.select("_value", F.least("most", share).alias("target")), "goals", release=False)
        out = out.join(sums.select(F.col("_value").alias("_of"), (F.col("most") <= share).alias(f"_whole_{m}")), F.col(m).eqNullSafe(F.col("_of")), "left").drop("_of")
        whole = whole | F.coalesce(f"_whole_{m}", F.lit(False))
    weight = F.when(~F.col("_live"), 0.0).when(whole, float("inf")).otherwise(F.col("tokens") * F.lit(amount / total if total else 0.0))
    return out.withColumns({"cap": F.col("tokens").cast("double"), "weight": weight}).drop("_live", *[f"_whole_{m}" for m in targets]), goals


def probabilities(docs: DataFrame, targets: dict[str, dict] | None = None, rate: float = RATE, temper: float = TEMPER, margins=MARGINS, budget: float | None = None) -> DataFrame:
    """docs (with the margins' columns and n_tokens) with probability and drawn. budget: share of the tokens to expect, instead of a rate."""
    filled = docs.where("n_tokens > 0")
    cells = written(filled.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "counts")
    goals = {m: written(targets_for(cells, m, (targets or {}).get(m), temper), "targets") for m in margins}
    raked = rake(*(budgeted(cells, goals, budget) if budget else (cells, goals))).withColumn("ratio", F.col("weight") / F.col("tokens"))
    most = raked.agg(F.max("ratio"), F.sum("tokens")).first()
    scale = 1.0 if budget else min(1.0 / most[0], rate * float(most[1])) if most[0] else 0.0
    chance = raked.select(*[F.col(m).alias(f"to_{m}") for m in margins], F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)).alias("chance"))
    same = reduce(lambda a, b: a & b, [F.col(f"of_{m}").eqNullSafe(F.col(f"to_{m}")) for m in margins])
    # the row as one struct, so that no column of the input meets a name used here
    rows = docs.select(whole_row(docs, "probability", "drawn").alias("row"), *[F.col(m).alias(f"of_{m}") for m in margins], F.col("n_tokens").alias("size"), F.col("draw").alias("lot"))
    out = rows.join(chance, same, "left")
    chance = F.when(F.col("size") > 0, F.coalesce("chance", F.lit(0.0))).otherwise(F.lit(0.0))
    out = out.select("row", "lot", chance.alias("chance"))
    return out.select("row.*", F.col("chance").alias("probability"), (F.pmod(F.col("lot"), F.lit(DRAWS)) < F.col("chance") * float(DRAWS)).alias("drawn"))


def deviations(mixed: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, margins=MARGINS) -> DataFrame:
    """(margin, value, asked, expected): of what `probabilities` gives, each value's share that was asked for and the share of the tokens that
    are expected to be drawn. They differ where a budget makes a value give all it has, or where no weights meet the targets at once."""
    filled = mixed.where("n_tokens > 0")
    cells = written(filled.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("drawn")), "drawn", release=False)
    total = cells.agg(F.sum("drawn")).first()[0] or 0.0
    parts = []
    for m in margins:
        asked = targets_for(cells, m, (targets or {}).get(m), temper)
        got = cells.groupBy(F.col(m).alias("of")).agg((F.sum("drawn") / F.lit(total or 1.0)).alias("expected"))
        rows = asked.join(got, F.col("_value").eqNullSafe(F.col("of")))
        parts.append(rows.select(F.lit(m).alias("margin"), F.col("_value").cast("string").alias("value"), F.col("target").alias("asked"), "expected"))
    return reduce(DataFrame.unionByName, parts)
