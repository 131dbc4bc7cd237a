"""Bootstrap of the mean difference over rows.

Every draw is a counter-based hash, so any task can make any draw at any time: there
is no generator whose state would tie rows to an order or a task.

``bias_interval_rows`` gives each row a Poisson(1) weight per replicate, from a hash of
row and replicate. Arrow batches are reduced to two vectors of replicate sums per group;
only those are shuffled, so a group with most of the rows costs nothing extra. Its
sizes vary a little from one replicate to the next.

``bias_interval_exact`` draws exactly as many rows as there are. Rows have places in a
hashed order and lie in blocks of ``BLOCK``; first, the draws of a replicate are counted per block in one task, and then
each block makes its own draws among its rows. Draws themselves are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaymill.config import DEFAULTS
from assaymill.operators.agreement import grouped
from assaymill.operators.bootstrap import poisson_steps
from assaymill.operators.clean import finite_rows
from assaymill.operators.ordered import ROWS_PER_BUCKET, hex_digits, positions
from assaymill.operators.splits import shuffle_key
from assaymill.session import written

# fixed values: multipliers of a published 32-bit finaliser, and the golden ratio
MIX = (2246822507, 3266489909)
GOLDEN = 2654435769
# ------------------------------------------------------------------------------
BLOCK = 65536
STEPS = tuple(math.ceil(c * 2**32) for c in poisson_steps())
ROWS = 32  # of one block of draws, which stays in the cache
DRAWS = 1 << 14  # counted at once, likewise
REPLICATES = 64  # that share the first half of each draw's hash
COMMON = 6  # weights up to this are told by comparisons, the rare larger ones by search


def mix_into(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits that spreads every bit; ``x`` is overwritten."""
    for shift, factor in ((16, MIX[0]), (13, MIX[1])):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def mixed(x: np.ndarray) -> np.ndarray:
    """The same, of a copy."""
    x = np.array(x, np.uint32)
    return mix_into(x, np.empty_like(x))


def drawn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 random bits of two counters."""
    return mixed(np.asarray(a, np.uint32) ^ mixed(b))


_STEPS = np.array([step for step in STEPS if step < 2**32], np.uint32)


def weights(u: np.ndarray, w: np.ndarray | None = None, above: np.ndarray | None = None) -> np.ndarray:
    """Poisson(1) numbers of 32-bit draws, by inversion, as bytes; ``w`` and ``above`` are room for them."""
    w = np.empty(u.shape, np.uint8) if w is None else w
    above = np.empty(u.shape, bool) if above is None else above
    np.greater_equal(u, _STEPS[0], out=w.view(bool))
    for step in _STEPS[1:COMMON]:
        np.greater_equal(u, step, out=above)
        np.add(w, above.view(np.uint8), out=w)
    rare = np.nonzero(above)
    w[rare] += np.searchsorted(_STEPS[COMMON:], u[rare], side="right").astype(np.uint8)
    return w


def _half(row_id: str, seed: int, start: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")


def _kept(by: Sequence[str], schema: T.StructType) -> list[T.StructField]:
    return [schema[c] for c in by]


def bias_interval_rows(
    df: DataFrame, row_id: str, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = (), seed: int = DEFAULTS.seed, replicates: int = 2000
) -> DataFrame:
    """Percentile interval with a Poisson(1) weight per row and replicate."""
    by = list(by)
    rows = finite_rows(df, truth, pred).select(*by, _half(row_id, seed, 1).alias("_a"), _half(row_id, seed, 9).alias("_b"), (F.col(pred) - F.col(truth)).cast("double").alias("_d"))
    sums = T.StructType([*_kept(by, rows.schema), T.StructField("_part", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("_n", "_m", "_s")]])
    counters = (np.arange(replicates, dtype=np.uint64) * np.uint64(GOLDEN)).astype(np.uint32)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, found = TaskContext.get().partitionId(), {}
        shape = (ROWS, replicates)
        u, spare, w, above, real = (np.empty(shape, kind) for kind in (np.uint32, np.uint32, np.uint8, bool, float))
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            a, b, d = get("_a").astype(np.uint32), get("_b").astype(np.uint32), get("_d")
            keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * len(d)
            codes, names = pd.factorize(pd.Index(keys, tupleize_cols=False))
            for code, name in enumerate(names):
                own = np.flatnonzero(codes == code)
                total = found.setdefault(name, [np.zeros(1), np.zeros(replicates), np.zeros(replicates)])
                total[0] += len(own)
                for at in range(0, len(own), ROWS):
                    rows = own[at : at + ROWS]
                    n = len(rows)
                    np.add(b[rows, None], counters[None, :], out=u[:n])
                    mix_into(u[:n], spare[:n])
                    np.bitwise_xor(u[:n], a[rows, None], out=u[:n])
                    mix_into(u[:n], spare[:n])
                    real[:n] = weights(u[:n], w[:n], above[:n])
                    both = np.stack([np.ones(n), d[rows]]) @ real[:n]
                    total[1] += both[0]
                    total[2] += both[1]
        for name, total in found.items():
            yield pa.RecordBatch.from_pydict(
                {**{c: pa.array([v], batch.schema.field(c).type) for c, v in zip(by, name)}, "_part": pa.array([part], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("_n", "_m", "_s"), total)}}
            )

    def add(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        for c in ("_n", "_m", "_s"):
            total = np.sum([np.frombuffer(x) for x in table.column(c).to_pylist()], axis=0)
            first = first.set_column(first.schema.get_field_index(c), c, pa.array([total.tobytes()], pa.binary()))
        return first

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, m, s = (np.frombuffer(batch.column(c)[k].as_py()) for c in ("_n", "_m", "_s"))
                with np.errstate(invalid="ignore", divide="ignore"):
                    value = np.where(m > 0, s / m, np.nan)
                size = len(m)
                yield pa.RecordBatch.from_pydict({**{c: pa.array([batch.column(c)[k].as_py()] * size, batch.schema.field(c).type) for c in by}, "n_rows": pa.array([int(n[0])] * size, pa.int64()), "stat": pa.array(value, mask=~(m > 0))})

    # A row costs as many draws as there are replicates: spread the few bytes of each over all cores.
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    partial = rows.repartition(tasks).mapInArrow(weigh, sums)
    fan = max(1, int(tasks**0.5))
    partial = partial.withColumn("_part", F.col("_part") % fan).groupBy(*by, "_part").applyInArrow(add, sums).groupBy(*by).applyInArrow(add, sums)
    values = partial.mapInArrow(stats, T.StructType([*_kept(by, rows.schema), T.StructField("n_rows", T.LongType()), T.StructField("stat", T.DoubleType())]))
    return _interval(values, by, "poisson row")


def draws_per_block(size: int, reps: Sequence[int], seed: int, block: int = BLOCK, at_once: int = DRAWS) -> list[np.ndarray]:
    """How many of the ``size`` draws of each replicate fall into each block of rows (a power of two)."""
    counts = [np.zeros(-(-size // block), np.int64) for _ in reps]
    seeds = mixed(np.array([(rep + seed) % 2**32 for rep in reps], np.uint32))
    u, spare, place = np.empty(at_once, np.uint32), np.empty(at_once, np.uint32), np.empty(at_once, np.uint64)
    # A place is the upper half of draw times size, its block what is left without 16 more bits.
    shift = np.uint64(32 + block.bit_length() - 1)
    for first in range(0, size, at_once):
        half = mixed((np.arange(first, min(size, first + at_once), dtype=np.uint64) * np.uint64(GOLDEN)).astype(np.uint32))
        m = len(half)
        for k, count in enumerate(counts):
            np.bitwise_xor(half, seeds[k], out=u[:m])
            mix_into(u[:m], spare[:m])
            np.multiply(u[:m], np.uint64(size), out=place[:m], dtype=np.uint64)
            np.right_shift(place[:m], shift, out=place[:m])
            n = np.bincount(place[:m].view(np.int64))
            count[: len(n)] += n
    return counts


def bias_interval_exact(
    df: DataFrame, row_id: str, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = (), seed: int = DEFAULTS.seed, replicates: int = 2000
) -> DataFrame:
    """Percentile interval where every replicate draws as many rows as its group has.

    Groups of fewer than 2**32 rows: a draw has 32 bits. Rows that share an id are
    ordered by their difference.
    """
    by = list(by)
    rows = written(finite_rows(df, truth, pred).select(*by, F.col(row_id).alias("_id"), shuffle_key(row_id, seed).alias("_key"), (F.col(pred) - F.col(truth)).cast("double").alias("_d")))
    digits = hex_digits(-(-rows.count() // ROWS_PER_BUCKET))
    placed = positions(rows, by, F.substring("_key", 1, digits), ["_key", "_id", "_d"], "_place").withColumn("_place", F.col("_place") - 1)
    blocks = written(placed.select(*by, "_d", F.floor(F.col("_place") / BLOCK).alias("_block"), (F.col("_place") % BLOCK).alias("_at"), F.col("_place_of").alias("_size")))
    sizes = blocks.groupBy(*by).agg(F.max("_size").alias("_size"))
    wanted_reps = sizes.where("_size IS NOT NULL").select(*by, "_size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_rep"))
    tasks = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted_reps = wanted_reps.repartition(tasks, "_rep")
    counted = T.StructType([*_kept(by, rows.schema), *[T.StructField(c, T.LongType()) for c in ("_rep", "_block", "_draws")]])

    block, at_once = BLOCK, DRAWS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups: dict[tuple, list[int]] = {}
            for row in pdf.itertuples(index=False):
                groups.setdefault((*row[: len(by)], int(row[len(by)])), []).append(int(row[len(by) + 1]))
            for (*key, size), reps in groups.items():
                if size >= 2**32:
                    raise ValueError("a group has 2**32 rows or more: use the Poisson form")
                for at in range(0, len(reps), REPLICATES):
                    own = reps[at : at + REPLICATES]
                    for rep, n in zip(own, draws_per_block(size, own, seed, block, at_once)):
                        here = np.flatnonzero(n)
                        yield pd.DataFrame({**{c: [v] * len(here) for c, v in zip(by, key)}, "_rep": rep, "_block": here, "_draws": n[here]})

    draws = wanted_reps.mapInPandas(count, counted)
    summed = T.StructType([*_kept(by, rows.schema), T.StructField("_rep", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_m", T.LongType())])

    def resample(key: tuple, values: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        d = values.sort_values("_at")["_d"].to_numpy()
        rep, n = wanted["_rep"].to_numpy(np.int64), wanted["_draws"].to_numpy(np.int64)
        most = int(n.max()) if len(n) else 0
        counters = mixed((np.arange(most, dtype=np.uint64) * np.uint64(GOLDEN)).astype(np.uint32) + np.uint32((int(key[-1]) * MIX[0]) % 2**32))
        s = np.empty(len(n))
        for k in range(len(n)):
            u = mixed(mixed(np.array([rep[k] + seed + 1])) ^ counters[: n[k]]).astype(np.uint64)
            s[k] = d[((u * np.uint64(len(d))) >> np.uint64(32)).astype(np.int64)].sum()
        return pd.DataFrame({**{c: [v] * len(n) for c, v in zip(by, key)}, "_rep": rep, "_s": s, "_m": n})

    keys = [*by, "_block"]
    sums = blocks.select(*keys, "_d", "_at").groupBy(*keys).cogroup(draws.groupBy(*keys)).applyInPandas(resample, summed)
    values = sums.groupBy(*by, "_rep").agg((F.sum("_s") / F.sum("_m")).alias("stat"), F.sum("_m").alias("n_rows"))
    return _interval(values, by, "multinomial row")


def _interval(values: DataFrame, by: Sequence[str], method: str) -> DataFrame:
    return grouped(
        values,
        by,
        False,
        F.count("stat").alias("replicates"),
        F.avg("stat").alias("boot_mean"),
        F.percentile("stat", F.lit(0.025)).alias("ci_low"),
        F.percentile("stat", F.lit(0.975)).alias("ci_high"),
        F.lit(method).alias("method"),
        F.max("n_rows").alias("n_rows"),
    )
