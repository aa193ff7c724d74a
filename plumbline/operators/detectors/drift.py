"""The period before each period, a running mean, and a drift sum that starts again after
each signal: over any number of periods, side by side.

Periods are sorted by ranges, stored and cut into blocks. What a block does to the state
that comes in is a small summary: the running mean goes through an affine map, and the
drift sum through a map of pieces, each of which either shifts the sum or has forgotten
it, since a sum that was clamped at zero or has signalled no longer depends on how it
came. The summaries of at most MAX_BLOCKS blocks (and one more per sorted range) are put
together in order; then all blocks are walked at the same time from their own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.sequences import neighbours
from plumbline.plans.lookup import scratch_path
from plumbline.plans.workers import ship

ship(__name__)

ALPHA = 0.4
SIGNAL = 0.15
# Blocks are as long as MAX_BLOCKS of them need to be, but not shorter than MIN_BLOCK.
MIN_BLOCK, MAX_BLOCKS = 8192, 4096
PIECES = "block bigint, lo array<double>, hi array<double>, value array<double>, moves array<boolean>"


def in_order(periods: DataFrame, min_block: int | None = None) -> DataFrame:
    """``periods`` (period, n, rate) stored in order, with ``place`` and ``block``."""
    spark = periods.sparkSession
    path = scratch_path(spark, "periods")
    (periods.orderBy("period").select("period", "n", "rate", F.monotonically_increasing_id().alias("place"))
     .write.parquet(path))
    ordered = spark.read.parquet(path)
    size = max(MIN_BLOCK if min_block is None else min_block, -(-ordered.count() // MAX_BLOCKS))
    within = F.expr(f"(place & {(1 << 33) - 1}) div {size}")
    # A range holds fewer than 2 ** 33 places, so its blocks stay below the next one's.
    return ordered.withColumn("block", F.shiftleft(F.shiftright("place", 33), 33) + within)


def period_steps(ordered: DataFrame) -> DataFrame:
    """Every period with the one before it: period, n, rate, p_period, p_n, p_rate."""
    before = {"p_period": "period", "p_n": "n", "p_rate": "rate"}
    return neighbours(ordered, [], "block", ["place"], before, -1).drop("place", "block")


def period_drift(ordered: DataFrame, minimum: float) -> DataFrame:
    """(period, rate, ewma, cusum) where the drift sum reaches the signal.

    Only periods with ``minimum`` records and a rate count; the first of them starts the
    running mean and adds no drift. No periods give no rows.
    """
    blocks = sorted(r.block for r in ordered.select("block").distinct().collect())
    usable = ordered.where((F.col("n") >= F.lit(minimum)) & F.col("rate").isNotNull())
    enter = {b: (None, 0.0) for b in blocks}
    if len(blocks) > 1:
        means = {r.block: r for r in _walked(usable, lambda b: Mean(), MEAN).collect()}
        smooth = None
        for b in blocks:
            enter[b] = (smooth, 0.0)
            if b in means:
                r = means[b]
                smooth = r.first if smooth is None else r.scale * smooth + r.shift
        held = dict(enter)
        pieces = {r.block: r for r in _walked(usable, lambda b: Drift(held[b][0]), PIECES).collect()}
        drift = 0.0
        for b in blocks:
            enter[b] = (enter[b][0], drift)
            if b in pieces:
                drift = through(pieces[b], drift)
    known = dict(enter)
    return _walked(usable, lambda b: Signals(*known[b]), "period string, rate double, ewma double, cusum double")


def through(r, drift: float) -> float:
    """The drift sum behind a block whose map is ``r``."""
    i = next(i for i, hi in enumerate(r.hi) if drift < hi or i == len(r.hi) - 1)
    return max(0.0, drift + r.value[i]) if r.moves[i] else r.value[i]


MEAN = "block bigint, scale double, shift double, first double"


class Mean:
    """The running mean behind a block: ``scale`` * incoming + ``shift``, or ``first`` where
    nothing came in."""

    def __init__(self):
        self.scale, self.shift, self.first = 1.0, 0.0, None

    def add(self, period: str, rate: float) -> None:
        self.scale *= 1 - ALPHA
        self.shift = ALPHA * rate + (1 - ALPHA) * self.shift
        self.first = rate if self.first is None else ALPHA * rate + (1 - ALPHA) * self.first

    def rows(self, block: int, done: bool) -> list[tuple]:
        return [(block, self.scale, self.shift, self.first)] if done else []


class Drift:
    """The drift sum behind a block for every sum that may come in, from 0 to SIGNAL: pieces
    [lo, hi) that move it by ``value``, or that end at ``value`` wherever they began."""

    def __init__(self, smooth: float | None):
        self.smooth = smooth
        self.pieces = [(0.0, SIGNAL, 0.0, True)]

    def add(self, period: str, rate: float) -> None:
        self.smooth = rate if self.smooth is None else ALPHA * rate + (1 - ALPHA) * self.smooth
        step = rate - self.smooth
        new: list[tuple] = []
        for lo, hi, value, moves in self.pieces:
            value += step
            if not moves:
                value = max(0.0, value)
                parts = [(lo, hi, 0.0 if value >= SIGNAL else value, False)]
            else:
                a, b = min(max(lo, -value), hi), max(min(hi, SIGNAL - value), lo)
                parts = [(lo, a, 0.0, False), (a, b, value, True), (b, hi, 0.0, False)]
            for p in parts:
                if p[0] >= p[1]:
                    continue
                if new and new[-1][2:] == p[2:]:
                    new[-1] = (new[-1][0], p[1], *p[2:])
                else:
                    new.append(p)
        self.pieces = new

    def rows(self, block: int, done: bool) -> list[tuple]:
        return [(block, *map(list, zip(*self.pieces, strict=True)))] if done else []


class Signals:
    """Where the drift sum reaches the signal, from the state that comes in."""

    def __init__(self, smooth: float | None, drift: float):
        self.smooth, self.drift, self.found = smooth, drift, []

    def add(self, period: str, rate: float) -> None:
        self.smooth = rate if self.smooth is None else ALPHA * rate + (1 - ALPHA) * self.smooth
        self.drift = max(0.0, self.drift + rate - self.smooth)
        if self.drift >= SIGNAL:
            self.found.append((period, rate, self.smooth, self.drift))
            self.drift = 0.0

    def rows(self, block: int, done: bool) -> list[tuple]:
        found, self.found = self.found, []
        return found


def _walked(usable: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Each block's periods in order through ``start(block)``, which takes rows and gives rows."""
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
             "array<double>": pa.list_(pa.float64()), "array<boolean>": pa.list_(pa.bool_())}
    out = pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk = None, None

        def batch(done: bool) -> Iterator[pa.RecordBatch]:
            rows = walk.rows(at, done)
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)],
                                                 schema=out)

        for b in batches:
            for block, period, rate in zip(*(b.column(n).to_pylist() for n in ("block", "period", "rate")), strict=True):
                if block != at:
                    if walk:
                        yield from batch(True)
                    at, walk = block, start(block)
                walk.add(period, rate)
            if walk:
                yield from batch(False)
        if walk:
            yield from batch(True)

    rows = usable.select("block", "place", "period", "rate")
    return rows.repartition("block").sortWithinPartitions("block", "place").mapInArrow(run, schema)
