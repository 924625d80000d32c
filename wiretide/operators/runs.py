"""Ordered operators over keyed rows that stay balanced when one key is huge.

``Window.partitionBy(key)`` sends a whole key to one task. A ``Run`` counts the rows of every
key, cuts the keys that hold more than one task should at split points of their own
order, and lets windows run on ``(key, cut)``. What a cut needs from its neighbours is
one small carry row, joined back by broadcast: there are at most ``MAX_CUTS`` cuts plus
as many hot keys, whatever the data size. Results never depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, FractionalType, IntegralType, TimestampNTZType, TimestampType

from wiretide.functions.scalar import micros
from wiretide.storage import Dealt, checkpointed, checkpointed_as_dealt, stored

#: A key with more rows is cut into pieces of about this many. Only beyond ``MAX_CUTS`` pieces
#: over all keys (6.5 billion rows in hot keys) do the pieces themselves grow.
ROWS_PER_CUT = 100_000
MAX_CUTS = 65_536
SAMPLES_PER_CUT = 40

CUT = "__cut"
LAST_CUT = "__last_cut"
HOT, N_SPLITS = "__hot", "__n_splits"
_ALL = "__all"


def _same(left: str, right: str, names: Sequence[str]) -> Column:
    tests = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    return reduce(lambda a, b: a & b, tests)


def attach(df: DataFrame, other: DataFrame, on: Sequence[str], small: bool = True) -> DataFrame:
    """Left join; NULL keys match. ``small``: the other table is bounded by the number of cuts."""
    extra = [c for c in other.columns if c not in on]
    joined = df.alias("l").join((F.broadcast(other) if small else other).alias("r"), _same("l", "r", on), "left")
    return joined.select("l.*", *[F.col(f"r.{c}").alias(c) for c in extra])


def _comparable(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The order columns as numbers or text that Python compares as Spark does. Times become
    microseconds, which no session zone can change; a NULL comes first."""
    out = []
    for name in order:
        col, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            col = micros(col, kind)
        elif isinstance(kind, DateType):
            col = F.unix_date(col).cast("bigint")
        elif isinstance(kind, (IntegralType, BooleanType)):
            col = col.cast("bigint")
        elif isinstance(kind, BinaryType):
            col = F.coalesce(F.hex(col), F.lit(""))
        elif not isinstance(kind, FractionalType):
            col = F.coalesce(col.cast("string"), F.lit(""))
        if isinstance(kind, (TimestampType, TimestampNTZType, DateType, IntegralType, BooleanType)):
            col = F.coalesce(col, F.lit(-(2**63)).cast("bigint"))
        out.append(col.alias(name))
    return out


def split_points(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_cut: int | None = None
) -> dict[tuple, list[tuple]]:
    """Split points of every key too large for one task: key -> sorted comparable order tuples.

    One pass counts the rows of each key (keys only, with map-side sums). If some key is too
    large, a second one draws about ``SAMPLES_PER_CUT`` rows per cut from such keys, ranks them
    in Spark and brings one point per cut to the driver. The sample only places cuts.
    """
    least = rows_per_cut or ROWS_PER_CUT
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__rows")).where(F.col("__rows") > least)
    hot = sizes.orderBy(F.desc("__rows")).limit(MAX_CUTS).collect()
    per_cut = max(least, -(-sum(r["__rows"] for r in hot) // MAX_CUTS))
    hot = [tuple(r[: len(keys)]) for r in hot if r["__rows"] > per_cut]
    if not hot:
        return {}
    numbered = df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(hot)], df.select(*keys).schema.add(HOT, "integer"))
    narrow = df.select(*keys, *_comparable(df, order)).alias("l")
    rows = narrow.join(F.broadcast(numbered).alias("r"), _same("l", "r", keys)).select(HOT, *[F.col(f"l.{o}") for o in order])
    fraction = min(1.0, SAMPLES_PER_CUT / per_cut)
    drawn = rows.sample(fraction, seed=7) if fraction < 1 else rows
    rank = F.row_number().over(Window.partitionBy(HOT).orderBy(*order))
    stride = max(1, round(per_cut * fraction))
    points = drawn.withColumn("__rank", rank).where((F.col("__rank") > 1) & (F.col("__rank") % stride == 1 % stride))
    cuts: dict[tuple, set[tuple]] = {}
    for row in points.select(HOT, *order).collect():
        cuts.setdefault(hot[row[0]], set()).add(tuple(row[1:]))
    return {key: sorted(points) for key, points in cuts.items()}


def _array(values: pd.Series | list) -> np.ndarray:
    found = values.to_numpy() if isinstance(values, pd.Series) else np.array(values)
    return found if found.dtype.kind in "if" else np.array(list(values), dtype=object)


def _place(points: list[tuple], columns: list[np.ndarray], depth: int = 0) -> np.ndarray:
    """How many of the sorted points are at or before each row. One search per column; only rows
    that tie with points look at the next one."""
    mine = _array([p[depth] for p in points])
    low, high = np.searchsorted(mine, columns[depth], "left"), np.searchsorted(mine, columns[depth], "right")
    if depth + 1 == len(columns):
        return high
    out = low.copy()
    for a in np.unique(low[low < high]):
        at = np.flatnonzero((low == a) & (high > a))
        out[at] += _place(points[a : high[at[0]]], [c[at] for c in columns], depth + 1)
    return out


def _cut_index(splits):
    """Arrow function (hot key number, order struct) -> cut; split points come as a broadcast value."""

    def cut(hot: pd.Series, at: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(hot), np.int32)
        for key in hot.dropna().unique():
            rows = np.flatnonzero((hot == key).to_numpy())
            out[rows] = _place(splits.value[int(key)], [_array(at[c].iloc[rows]) for c in at.columns])
        return pd.Series(out)

    return F.pandas_udf(cut, "int")


def mark_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Mapping[tuple, list[tuple]]
) -> DataFrame:
    """Add ``__cut`` (NULL for keys that stay whole) and ``__last_cut``. Rows are joined with the
    number of their hot key only, never with its split points."""
    spark = df.sparkSession
    schema = df.select(*keys).schema.add(HOT, "integer").add(N_SPLITS, "integer")
    small = spark.createDataFrame([(*key, i, len(points)) for i, (key, points) in enumerate(cuts.items())], schema)
    place = _cut_index(spark.sparkContext.broadcast(list(cuts.values())))
    marked = attach(df, small, keys).withColumn(CUT, place(F.col(HOT), F.struct(*_comparable(df, order))))
    return (
        marked.withColumn(CUT, F.when(F.col(HOT).isNotNull(), F.col(CUT)))
        .withColumn(LAST_CUT, F.coalesce(F.col(CUT) == F.col(N_SPLITS), F.lit(True)))
        .drop(HOT, N_SPLITS)
    )


@dataclass(frozen=True)
class Run:
    """Rows with keys, a total order and the cuts of hot keys; every method keeps the cuts, so
    steps that follow each other share one layout.

    ``cut_keys`` are the keys whose rows were cut. A run over more keys (``within``) uses the same
    cuts. A step needs its input twice, for the rows and for the carries; what an earlier step added
    is stored before that, so a chain of steps costs the sum of its steps.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    pieces: int = 0
    cut_keys: tuple[str, ...] = ()
    pending: bool = False  # whether the rows carry a step that would have to be done again
    dealt: bool = False  # whether the rows of a key and cut are in one task already
    sorted: bool = False  # whether they also follow each other there; in order, if it is total
    asked: bool = False  # whether a step in the rows' plan asks for that; else a reader of buckets may not keep it

    # -- plumbing -----------------------------------------------------------------

    @property
    def _parts(self) -> list[str]:
        return [*self.keys, CUT] if self.split else list(self.keys)

    @property
    def _deal(self) -> list[str]:
        """Columns that rows are dealt by; rows of finer keys are then together too."""
        return [*self.cut_keys, CUT] if self.split else list(self.cut_keys)

    @property
    def window(self):
        return Window.partitionBy(*self._parts).orderBy(*self.order)

    def _upto_here(self):
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _carry(self, per_cut: Mapping[str, Column], across: Mapping[str, Column]) -> DataFrame:
        """One row per key and cut of a hot key: ``per_cut`` aggregates, then ``across`` cuts."""
        hot = self.df.where(F.col(CUT).isNotNull())
        rows = hot.groupBy(*self._parts).agg(*[c.alias(n) for n, c in per_cut.items()])
        return rows.select(*self._parts, *[c.alias(n) for n, c in across.items()])

    def _attach(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """Carries to their rows; there are few unless keys are finer than those of the cuts. Those are stored, so
        that Spark knows their size when it chooses the join."""
        few = self.keys == self.cut_keys
        return attach(rows, carry if few else stored(carry, "carry"), self._parts, small=few)

    def _with(self, df: DataFrame) -> "Run":
        return replace(self, df=df)

    def _stepped(self, df: DataFrame) -> "Run":
        return replace(self, df=df, pending=self.split, sorted=self.sorted and self.keys == self.cut_keys, asked=True)

    def _ready(self) -> "Run":
        return self.store() if self.pending else self

    def _point(self) -> Column:
        return F.struct(*self.order)

    @property
    def _tasks(self) -> int:
        return max(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.pieces)

    def deal(self) -> "Run":
        """The rows dealt by key and cut, not stored: what is added to them from here on is not shuffled."""
        return replace(self, df=self.df.repartition(self._tasks, *self._deal), dealt=True, sorted=False, asked=True)

    def store(self) -> "Run":
        """The rows dealt by key and cut and written to the shared folder."""
        dealt = self if self.dealt and self.asked else self.deal()
        rows = checkpointed_as_dealt(Dealt(dealt.df, self._deal, self.order, self._tasks))
        return replace(self, df=rows, pending=False, dealt=True, sorted=True, asked=False)

    def in_order(self) -> DataFrame:
        """The rows dealt and sorted by key and cut, for functions over whole tasks. Where nothing in the plan of
        dealt rows asks for that, a window does, which also sorts them."""
        dealt = self if self.dealt else self.deal()
        rows = dealt.df
        if not dealt.asked:
            nth = F.row_number().over(Window.partitionBy(*self._deal).orderBy(*self.order))
            rows = rows.withColumn("__nth", nth).where(F.col("__nth") > 0).drop("__nth")
        return rows if dealt.sorted else rows.sortWithinPartitions(*self._deal, *self.order)

    def done(self) -> DataFrame:
        """The rows without the bookkeeping columns."""
        return self.df.drop(CUT, LAST_CUT, _ALL)

    # -- rows and columns ---------------------------------------------------------

    def select(self, *cols, order: Sequence[str] | None = None) -> "Run":
        """Other columns; keys and order (or their new names for it) must be among them. Where a row becomes
        several, they must come in their order."""
        keep = [*(k for k in self.keys if k.startswith("__")), *([CUT, LAST_CUT] if self.split else [])]
        return replace(self, df=self.df.select(*cols, *keep), order=tuple(order or self.order))

    def where(self, test: Column) -> "Run":
        return self._with(self.df.where(test))

    def with_columns(self, columns: Mapping[str, Column]) -> "Run":
        return self._with(self.df.withColumns(dict(columns)))

    def within(self, *more: str) -> "Run":
        """The same rows and cuts, each key divided by more columns."""
        return replace(self, keys=(*self.keys, *more))

    # -- operators ----------------------------------------------------------------

    def last_known(self, columns: Mapping[str, Column]) -> "Run":
        """Most recent non-null value up to and including the row, per column. Wrap
        several columns in one ``when(cond, struct(..))`` to carry them as a row."""
        self, names = self._ready(), list(columns)
        local = self.df.withColumns(
            {n: F.last(columns[n], ignorenulls=True).over(self._upto_here()) for n in names}
        )
        if not self.split:
            return self._with(local)
        before = Window.partitionBy(*self.keys).orderBy(CUT).rowsBetween(
            Window.unboundedPreceding, -1
        )
        held = {
            n: F.max_by(F.struct(columns[n].alias("v")), F.when(columns[n].isNotNull(), self._point()))
            for n in names
        }
        carry = self._carry(
            {f"__k_{n}": c for n, c in held.items()},
            {f"__c_{n}": F.last(f"__k_{n}", ignorenulls=True).over(before) for n in names},
        )
        joined = self._attach(local, carry)
        filled = {n: F.coalesce(F.col(n), F.col(f"__c_{n}")["v"]) for n in names}
        return self._stepped(joined.withColumns(filled).drop(*[f"__c_{n}" for n in names]))

    def _neighbour(self, columns: Mapping[str, Column], step: int) -> "Run":
        self, names = self._ready(), list(columns)
        boxed = {n: F.struct(columns[n].alias("v")) for n in names}
        move = F.lag if step < 0 else F.lead
        local = self.df.withColumns({f"__n_{n}": move(boxed[n], 1).over(self.window) for n in names})
        if self.split:
            edge = F.max_by if step < 0 else F.min_by
            cuts = Window.partitionBy(*self.keys).orderBy(CUT)
            carry = self._carry(
                {f"__k_{n}": edge(boxed[n], self._point()) for n in names},
                {f"__c_{n}": move(f"__k_{n}", 1).over(cuts) for n in names},
            )
            local = self._attach(local, carry)
        picked = {
            n: (F.coalesce(f"__n_{n}", f"__c_{n}") if self.split else F.col(f"__n_{n}"))["v"]
            for n in names
        }
        scratch = [f"__{p}_{n}" for p in "nc" for n in names]
        return self._stepped(local.withColumns(picked).drop(*scratch))

    def lag(self, columns: Mapping[str, Column]) -> "Run":
        """Values of the row before."""
        return self._neighbour(columns, -1)

    def lead(self, columns: Mapping[str, Column]) -> "Run":
        """Values of the row after."""
        return self._neighbour(columns, 1)

    def running_sum(self, columns: Mapping[str, Column]) -> "Run":
        """Sum up to and including the row; NULL counts as nothing."""
        self, names = self._ready(), list(columns)
        local = self.df.withColumns({n: F.sum(columns[n]).over(self._upto_here()) for n in names})
        if not self.split:
            return self._with(local)
        before = Window.partitionBy(*self.keys).orderBy(CUT).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carry = self._carry(
            {f"__k_{n}": F.sum(columns[n]) for n in names},
            {f"__c_{n}": F.sum(f"__k_{n}").over(before) for n in names},
        )
        joined = self._attach(local, carry)
        total = {
            n: F.when(F.col(n).isNull() & F.col(f"__c_{n}").isNull(), None).otherwise(
                F.coalesce(n, F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0))
            )
            for n in names
        }
        return self._stepped(joined.withColumns(total).drop(*[f"__c_{n}" for n in names]))

    def total(self, columns: Mapping[str, Column]) -> "Run":
        """Sum over all rows of the key, on every row."""
        self, names = self._ready(), list(columns)
        whole = Window.partitionBy(*self._parts)
        local = self.df.withColumns({n: F.sum(columns[n]).over(whole) for n in names})
        if not self.split:
            return self._with(local)
        everywhere = Window.partitionBy(*self.keys)
        carry = self._carry(
            {f"__k_{n}": F.sum(columns[n]) for n in names},
            {f"__c_{n}": F.sum(f"__k_{n}").over(everywhere) for n in names},
        )
        joined = self._attach(local, carry)
        full = {n: F.coalesce(F.col(f"__c_{n}"), F.col(n)) for n in names}
        return self._stepped(joined.withColumns(full).drop(*[f"__c_{n}" for n in names]))


def run(
    df: DataFrame | Run,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_cut: int | None = None,
) -> Run:
    """Start ordered work on ``df``. ``order`` must be total and non-null inside a key.
    Without keys all rows count as one key. Rows that are laid out for these keys (or fewer) and
    this order keep their layout: nothing is counted or cut again."""
    keys, order = tuple(keys), tuple(order)
    if isinstance(df, Run):
        if df.order == order and keys and keys[: len(df.cut_keys)] == df.cut_keys:
            return replace(df, keys=keys)
        df = df.done()
    if not keys:
        df = df.withColumn(_ALL, F.lit(0))
        keys = (_ALL,)
    cuts = split_points(df, keys, order, rows_per_cut)
    if not cuts:
        return Run(df, keys, order, False, 0, keys)
    return Run(mark_cuts(df, keys, order, cuts), keys, order, True, pieces(cuts), keys)


def rows_of(df: DataFrame | Run) -> DataFrame:
    return df.done() if isinstance(df, Run) else df


def pieces(cuts: Mapping[tuple, list[tuple]]) -> int:
    return sum(len(points) + 1 for points in cuts.values())


def lay_out(df: DataFrame | Run, keys: Sequence[str], order: Sequence[str], rows_per_cut: int | None = None) -> Run:
    """:func:`run`, with the rows stored as they are cut: the layout that several steps share."""
    return run(df, keys, order, rows_per_cut).store()


def spread(df: DataFrame) -> DataFrame:
    """Before costly per-row work: at least one task per core if the input comes in fewer.
    Inputs with enough splits are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame) -> DataFrame:
    """An expensive intermediate that later steps read more than once, stored."""
    return checkpointed(df)
