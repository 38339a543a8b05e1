"""Do sources take positions?  Items answered with 0 or 1, a one-dimensional model of them, and the test of it.

An item is one fact told, denied, framed or left out by the sources of a story.  The model is that a source u answers 1 on an
item i with probability sigmoid(a_i + b_i theta_u); it is fitted by steps over all items, which stay distributed, while
the positions themselves, one number for each source and fit, travel with the step.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.plans.durable import durable

#: What the items' parameters are held back by (a and b), and how many steps and how little movement end a fit.
HOLD_A, HOLD_B, MOST_STEPS, STILL = 0.1, 1.0, 400, 1e-7
#: Steps whose curvature is remembered.
PAST = 6
#: The same for the fits of a test, which need ranges and correlations only.
STILL_TEST, MOST_STEPS_TEST = 1e-3, 40
#: Positions of all fits of a run together (8 bytes each travel with every step).
MOST_POSITIONS = 4_000_000
#: The rule of a signal: stable, separated, and both clearly better than with shuffled names.
LEAST_ANSWERS, LEAST_R, LEAST_APART, BEAT_R, BEAT_APART = 15, 0.7, 0.15, 0.15, 2
#: Poisson weights of resampled stories: cumulative shares of 0, 1, 2, ... draws.
_DRAWS = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(9)]


def position_items(told: DataFrame, omissions: DataFrame, frames: DataFrame, voices: DataFrame) -> DataFrame:
    """``(story_id, type, item, unit, y)`` of the four kinds of items.

    ``told`` (story_id, item, unit, denies) has what sources say of a fact; a fact on which they differ is a stance item.
    ``omissions`` (story_id, item, unit, told): what units report of the facts of a story, or leave out; an item needs three units, one
    that tells it and one that does not.  ``frames`` (story_id, item, word, unit): loaded words used for a fact, an item where at least three units tell the fact and some, not
    all, use the word.  ``voices`` (story_id, voice, unit): who is quoted, an item where at least three units of the story quote someone and not all of them this
    one.  Stories with fewer than three units have no items but omissions.

    What repeated rows say is put together first and written down, so that all that follows grows with facts and units, not with the reports.
    """
    answers = durable(told.groupBy("story_id", "item", "unit").agg(F.min(F.when(F.col("denies"), 0).otherwise(1)).alias("y")), "answers")
    wide = answers.select("story_id", "unit").distinct().where("unit IS NOT NULL").groupBy("story_id").agg(F.count(F.lit(1)).alias("__n")).where("__n >= 3").select("story_id")
    uses, quotes = durable(frames.select("story_id", "item", "word", "unit").distinct(), "uses"), durable(voices.select("story_id", "voice", "unit").distinct(), "quotes")
    answers, uses, quotes = (x.join(wide, "story_id", "left_semi") for x in (answers, uses, quotes))
    split = answers.groupBy("story_id", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    stance = answers.join(split.where("n >= 2 AND ones BETWEEN 1 AND n - 1"), ["story_id", "item"], "left_semi")
    left = durable(omissions.groupBy("story_id", "item", "unit").agg(F.max(F.col("told").cast("int")).alias("y")), "omissions")
    sized = left.groupBy("story_id", "item").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).where("n >= 3 AND ones >= 1 AND ones < n")
    omitted = left.join(sized, ["story_id", "item"], "left_semi")
    used = uses.groupBy("story_id", "item", "word").agg(F.count(F.lit(1)).alias("ones"))
    framed = used.join(split.where("n >= 3").select("story_id", "item", "n"), ["story_id", "item"]).where("ones < n").select("story_id", "item", "word")
    framing = framed.join(answers.select("story_id", "item", "unit"), ["story_id", "item"]).join(uses.withColumn("y", F.lit(1)), ["story_id", "item", "word", "unit"], "left")
    quoting = quotes.select("story_id", "unit").distinct()
    many = quoting.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    carried = quotes.groupBy("story_id", "voice").agg(F.count(F.lit(1)).alias("ones")).join(many, "story_id").where("ones < n").select("story_id", "voice")
    voiced = carried.join(quoting, "story_id").join(quotes.withColumn("y", F.lit(1)), ["story_id", "voice", "unit"], "left")
    row = lambda df, kind, item: df.select("story_id", F.lit(kind).alias("type"), item.cast("string").alias("item"), F.col("unit").cast("string").alias("unit"), F.coalesce("y", F.lit(0)).cast("int").alias("y"))
    return (
        row(stance, "stance", F.col("item"))
        .unionByName(row(omitted, "omission", F.col("item")))
        .unionByName(row(framing, "framing", F.concat_ws(" ", "item", "word")))
        .unionByName(row(voiced, "voices", F.col("voice")))
    )


@dataclass
class Fit:
    """One fit: the real answers (0) or a shuffled set, the resampling of stories (None: every story once), and where its ascent stands."""

    answers: int
    resample: int | None
    theta: np.ndarray  # where the likelihood is asked for next
    moved: float = math.inf
    at: np.ndarray | None = None  # the best so far, with its value, slope along the sphere, direction and share of it tried
    value: float = -math.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    share: float = 1.0
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def advance(self, value: float, slope: np.ndarray, bend: np.ndarray) -> None:
        """On to the next place, keeping mean 0 and deviation 1: a limited-memory quasi-Newton ascent.

        A step that does not raise the likelihood enough is halved.  The first direction is the slope along the sphere, divided by
        the curvature of each unit.
        """
        outward = float((slope * self.theta).mean())
        along = slope - slope.mean() - outward * self.theta
        if self.at is not None and value < self.value + 1e-4 * self.share * float(self.way @ self.slope) and self.share > 1e-6:
            self.share /= 2
        else:
            if self.at is not None:
                step, change = self.theta - self.at, self.slope - along
                if step @ change > 1e-12:
                    self.past = [*self.past[1 - PAST :], (step, change)]
            plain = along / (bend + max(outward, 0.0) + 1e-9)
            self.at, self.value, self.slope, self.share = self.theta, value, along, 1.0
            self.way = self._turned(along, 1 / (bend + max(outward, 0.0) + 1e-9))
            if self.way @ along <= 0:
                self.past, self.way = [], plain
            self.moved = float(np.abs(_standard(self.at + plain) - self.at).max(initial=0))
        self.theta = _standard(self.at + self.share * self.way)

    def _turned(self, slope: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The inverse curvature of the last steps, times the slope."""
        q, used = slope.copy(), []
        for step, change in reversed(self.past):
            a = (step @ q) / (step @ change)
            q = q - a * change
            used.append(a)
        q = scale * q
        for (step, change), a in zip(self.past, reversed(used)):
            q = q + step * (a - (change @ q) / (step @ change))
        return q


def start(units: list[str]) -> np.ndarray:
    """Fixed first positions: 32 bits of the names' MD5, mean 0 and deviation 1."""
    return _standard(np.array([int(hashlib.md5(u.encode()).hexdigest()[:8], 16) / 2**32 for u in units]))


def _standard(x: np.ndarray) -> np.ndarray:
    x = x - x.mean()
    return x / max(x.std(), 1e-9)


def answer_sheets(items: DataFrame, units: list[str], shuffles: int = 0, rounds: int = 0) -> DataFrame:
    """(answers, story_id, sheet, weights): each item with its answers, written down; sets 1 to ``shuffles`` have the names permuted inside each story.

    A permutation deals the names of a story, in order, to the same names in the order of a keyed hash, and is the same for all
    items of the story.  ``weights`` tells how often each of ``rounds`` resamplings draws the story.
    """
    spark = items.sparkSession
    numbers = spark.createDataFrame([(u, i) for i, u in enumerate(units)], "unit string, number int")
    base = items.select("story_id", "type", "item", "unit", "y", F.lit(0).alias("answers"))
    if shuffles:
        names = items.select("story_id", "unit").distinct().withColumn("answers", F.explode(F.sequence(F.lit(1), F.lit(shuffles))))
        of = W.partitionBy("answers", "story_id")
        order = names.withColumn("i", F.row_number().over(of.orderBy("unit"))).withColumn("j", F.row_number().over(of.orderBy(F.xxhash64("answers", "story_id", "unit"), "unit")))
        moved = order.select("answers", "story_id", "unit", "i").join(order.select("answers", "story_id", F.col("unit").alias("to"), F.col("j").alias("i")), ["answers", "story_id", "i"])
        base = base.unionByName(items.join(moved, ["story_id", "unit"]).select("story_id", "type", "item", F.col("to").alias("unit"), "y", "answers"))
    share = lambda r: F.pmod(F.xxhash64("story_id", "answers", r), F.lit(1 << 40)) / float(1 << 40)
    draw = lambda r: sum((F.when(share(r) >= c, 1).otherwise(0) for c in _DRAWS), F.lit(0))
    weights = F.transform(F.sequence(F.lit(1), F.lit(rounds)), draw) if rounds else F.array().cast("array<int>")
    told = base.join(F.broadcast(numbers), "unit") if len(units) <= 100_000 else base.join(numbers, "unit")
    sheet = told.groupBy("answers", "story_id", "type", "item").agg(F.array_sort(F.collect_list(F.struct("number", "y"))).alias("sheet"))
    spread = sheet.select("answers", "story_id", "sheet", weights.alias("weights")).repartition(2 * spark.sparkContext.defaultParallelism)
    return durable(spread, "sheets")


def item_parameters(t: np.ndarray, y: np.ndarray, item: np.ndarray, n: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """a and b of ``n`` items, each the maximum of its own concave likelihood, by at most ``inner`` Newton steps from 0."""
    a, b = np.zeros(n), np.zeros(n)
    total = lambda x: np.bincount(item, x, n)
    for _ in range(inner):
        p = 1 / (1 + np.exp(-(a[item] + b[item] * t)))
        r, w = y - p, p * (1 - p)
        ga, gb = total(r) - HOLD_A * a, total(r * t) - HOLD_B * b
        aa, ab, bb = total(w) + HOLD_A, total(w * t), total(w * t * t) + HOLD_B
        det = aa * bb - ab * ab
        da, db = np.clip((bb * ga - ab * gb) / det, -2, 2), np.clip((aa * gb - ab * ga) / det, -2, 2)
        a, b = a + da, b + db
        if max(np.abs(da).max(initial=0), np.abs(db).max(initial=0)) < 1e-11:
            break
    return a, b


def _sums(sheets: DataFrame, fits: list[Fit], inner: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each fit the likelihood, and its slope and curvature for every unit, summed over all items at their best parameters.

    A task adds up its items and leaves a row for each fit and unit.
    """
    shared = sheets.sparkSession.sparkContext.broadcast([(f.answers, f.resample, f.theta) for f in fits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = shared.value
        slope = np.zeros((len(fits), len(fits[0][2]) + 1))  # the last place holds the likelihood
        bend = np.zeros_like(slope)
        for batch in batches:
            which = batch.column(0).to_numpy()
            size = np.array(batch.column(1).value_lengths(), np.int64)
            flat = batch.column(1).flatten()
            unit, y = (flat.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(len(size)), size)
            weights = np.array(batch.column(2).flatten(), np.float64).reshape(len(size), -1)
            for k, (answers, resample, theta) in enumerate(fits):
                weight = (which == answers) * (1.0 if resample is None else weights[:, resample])
                used = weight[row] > 0
                number = np.cumsum(weight > 0) - 1
                item, u, told, w = number[row[used]], unit[used], y[used], weight[row[used]]
                a, b = item_parameters(theta[u], told, item, int((weight > 0).sum()), inner)
                p = 1 / (1 + np.exp(-(a[item] + b[item] * theta[u])))
                slope[k, :-1] += np.bincount(u, w * (told - p) * b[item], len(theta))
                bend[k, :-1] += np.bincount(u, w * p * (1 - p) * b[item] ** 2, len(theta))
                held = (HOLD_A * a**2 + HOLD_B * b**2) / 2
                slope[k, -1] += (w * np.log(np.where(told > 0, p, 1 - p))).sum() - (weight[weight > 0] * held).sum()
        fit, u = np.indices(slope.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(fit), pa.array(u), pa.array(slope.ravel()), pa.array(bend.ravel())], ["fit", "unit", "slope", "bend"])

    parts = sheets.select("answers", "sheet", "weights").mapInArrow(run, "fit long, unit long, slope double, bend double")
    found = parts.groupBy("fit", "unit").agg(F.sum("slope").alias("slope"), F.sum("bend").alias("bend")).toArrow()
    sums = np.zeros((2, len(fits), len(fits[0].theta) + 1))
    sums[:, found["fit"].to_numpy(), found["unit"].to_numpy()] = found["slope"].to_numpy(), found["bend"].to_numpy()
    return [(float(g[-1]), g[:-1], h[:-1]) for g, h in zip(*sums)]


def step(sheets: DataFrame, fits: list[Fit], inner: int = 50) -> None:
    """One pass over all items for every fit; then each moves uphill on the sphere of mean 0 and deviation 1.

    Where it comes to rest, plain gradient steps with the scale renewed after each rest too.
    """
    for f, found in zip(fits, _sums(sheets, fits, inner)):
        f.advance(*found)


def fit_all(sheets: DataFrame, units: list[str], wanted: list[tuple[int, int | None]], still: float = STILL, most: int = MOST_STEPS) -> list[Fit]:
    """Fits for pairs of (answers, resample), side by side until each stands still; those that do drop out."""
    fits = [Fit(a, r, start(units)) for a, r in wanted]
    at_once = max(1, MOST_POSITIONS // max(1, len(units)))
    for lo in range(0, len(fits), at_once):
        for _ in range(most):
            live = [f for f in fits[lo : lo + at_once] if f.moved > still]
            if not live:
                break
            step(sheets, live)
    for f in fits:
        f.theta = f.theta if f.at is None else f.at
    return fits


def counted_units(items: DataFrame, least: int) -> dict[str, int]:
    """Units with at least ``least`` answers, by name; more than MOST_POSITIONS are refused."""
    counts = items.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if counts.count() > MOST_POSITIONS:
        raise ValueError("positions are for sources, of which there are too many here")
    return {r.unit: r.n for r in counts.orderBy("unit").toLocalIterator()}


def ideal_points(items: DataFrame, least: int = LEAST_ANSWERS) -> DataFrame:
    """``(unit, theta, answers)``: positions of the units with ``least`` answers and more, mean 0, deviation 1.

    The unit with most answers (the first by name on a tie) is on the positive side.  Items come as of ``position_items``; repeated
    answers of a unit on an item count as often as they come.
    """
    items = durable(items.select("story_id", "type", "item", "unit", "y"), "items")
    counts = counted_units(items, least)
    units = list(counts)
    rows = []
    if units:
        fit = fit_all(answer_sheets(items, units), units, [(0, None)])[0]
        side = max(range(len(units)), key=lambda i: (counts[units[i]], -i))
        turned = fit.theta * (1.0 if fit.theta[side] >= 0 else -1.0)
        rows = [(u, float(x), counts[u]) for u, x in zip(units, turned)]
    return items.sparkSession.createDataFrame(rows, "unit string, theta double, answers long")


def first_step(items: DataFrame, least: int = LEAST_ANSWERS) -> DataFrame:
    """``(unit, theta)`` after one step from the fixed start, items at their first Newton step: what a fit does, small enough to be checked."""
    items = durable(items.select("story_id", "type", "item", "unit", "y"), "items")
    units = list(counted_units(items, least))
    fit = Fit(0, None, start(units) if units else np.empty(0))
    if units:
        step(answer_sheets(items, units), [fit], inner=1)
    return items.sparkSession.createDataFrame([(u, float(x)) for u, x in zip(units, fit.theta)], "unit string, theta double")


def measured(positions: DataFrame) -> DataFrame:
    """``(answers, r, separated)`` from (answers, round, unit, theta), round 0 the fit to all stories.

    r is the mean correlation of the resampled positions with those (up to sign); separated is the share of pairs of units whose
    5 to 95 % ranges lie apart, counted from the order of their ends, without the pairs.
    """
    main = positions.where("round = 0").select("answers", "unit", F.col("theta").alias("base"))
    both = positions.where("round > 0").join(main, ["answers", "unit"])
    corr = both.groupBy("answers", "round").agg(F.corr("theta", "base").alias("c")).where("c IS NOT NULL AND NOT isnan(c)")
    r = corr.groupBy("answers").agg(F.avg(F.abs("c")).alias("r"))
    turned = both.join(corr, ["answers", "round"]).withColumn("t", F.when(F.col("c") < 0, -F.col("theta")).otherwise(F.col("theta")))
    ranges = turned.groupBy("answers", "unit").agg(F.percentile("t", 0.05).alias("lo"), F.percentile("t", 0.95).alias("hi"))
    ends = ranges.select("answers", F.col("lo").alias("x"), F.lit(0).alias("end")).unionByName(ranges.select("answers", F.col("hi").alias("x"), F.lit(1).alias("end")))
    before = F.sum("end").over(W.partitionBy("answers").orderBy("x", "end").rowsBetween(W.unboundedPreceding, W.currentRow))
    apart = ends.withColumn("ended", before).where("end = 0").groupBy("answers").agg(F.sum("ended").alias("apart"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("n") > 1, F.col("apart") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0)
    return r.join(apart, "answers").select("answers", "r", share.alias("separated"))


def position_test(items: DataFrame, rounds: int = 20, shuffles: int = 3, least: int = LEAST_ANSWERS) -> DataFrame:
    """``(stories, items, units, r, separated, null_r, null_separated, signal)``, one row.

    Stories are resampled ``rounds`` times with Poisson weights drawn from a hash of story and round; the names are shuffled inside
    each story ``shuffles`` times, each with a third of the rounds (five at least).  All fits run side by side.  With fewer than four units there is no signal
    and nothing is measured (null).
    """
    spark = items.sparkSession
    items = durable(items.select("story_id", "type", "item", "unit", "y"), "items")
    units = list(counted_units(items, least))
    size = items.agg(F.count_distinct("story_id").alias("stories"), F.count_distinct("story_id", "type", "item").alias("items")).withColumn("units", F.lit(len(units)).cast("long"))
    if len(units) < 4:
        empty = F.lit(None).cast("double")
        return size.select("*", empty.alias("r"), empty.alias("separated"), empty.alias("null_r"), empty.alias("null_separated"), F.lit(False).alias("signal"))
    few = max(5, rounds // 3)
    sheets = answer_sheets(items, units, shuffles, max(rounds, few))
    wanted = [(s, r) for s in range(shuffles + 1) for r in [None, *range(rounds if s == 0 else few)]]
    rows = [(f.answers, 0 if f.resample is None else f.resample + 1, u, float(x)) for f in fit_all(sheets, units, wanted, STILL_TEST, MOST_STEPS_TEST) for u, x in zip(units, f.theta)]
    found = measured(spark.createDataFrame(rows, "answers int, round int, unit string, theta double"))
    of = lambda c, real: F.avg(F.when((F.col("answers") == 0) == real, F.col(c)))
    real = found.agg(of("r", True).alias("r"), of("separated", True).alias("separated"), of("r", False).alias("null_r"), of("separated", False).alias("null_separated"))
    real = real.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in real.columns])
    signal = (F.col("r") >= LEAST_R) & (F.col("separated") >= LEAST_APART) & (F.col("r") >= F.col("null_r") + BEAT_R) & (F.col("separated") >= BEAT_APART * F.col("null_separated"))
    return size.join(F.broadcast(real.withColumn("signal", signal)), F.lit(True))
