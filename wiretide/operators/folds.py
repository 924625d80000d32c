"""Sequential state machines over ordered rows, one state per key.

Some steps (framing, minimum-gap throttling, pending-request queues) decide each row
from what they decided before, so windows cannot express them. A :class:`Step` holds
such a rule once; batch jobs run it here and streams run it from a state store
(``wiretide.streaming``).

Rows are shuffled by key and cut, sorted inside the partition and streamed through
``mapInArrow``, so memory is one Arrow batch plus the state. A key too large for one task is
cut as in ``runs``. Cuts start from the state their left neighbour ends with, and there are two
ways to find these states:

- A step that can sum up a cut (:meth:`Step.sum_up`) maps every possible entry state to the exit
  state. One walk makes the maps, one pass over the maps alone enters each key's cuts from left to
  right, and a second walk gives the rows: two walks, whatever the states do.
- For others the walk is repeated over cuts whose entry state changed, until none does. Framing
  forgets its past (:attr:`Step.forgets`): its first walk keeps rows too, and only cuts that turn out
  to be entered otherwise than at the start are walked again. A queue may take a walk per cut, over
  those cuts.

The result is always that of one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wiretide.operators.runs import CUT, LAST_CUT, Run, attach, run
from wiretide.storage import Buckets


#: So many groups are named one by one in a filter.
MAX_LISTED = 1_000


class Step:
    """One sequential rule. State must be JSON-friendly and canonical."""

    #: DDL of the rows ``feed`` and ``finish`` return, without the key columns.
    output: str
    #: Columns ``feed`` reads; nothing else goes to Python.
    needs: Sequence[str]
    #: Columns of ``output`` that are ``base`` plus what the cut alone decides.
    places: Sequence[str] = ()
    #: Whether most cuts are entered with the state of a fresh start, or nearly so. Their rows are
    #: then kept from the first walk, and only cuts entered otherwise are walked again.
    forgets: bool = False

    def start(self) -> Any:
        """State before the first row of a key."""
        raise NotImplementedError

    def feed(self, state: Any, rows: pd.DataFrame, base: int) -> tuple[pd.DataFrame, Any]:
        """Consume rows in order. ``base`` is the summed :meth:`weight` of all earlier
        rows of the key."""
        raise NotImplementedError

    def finish(self, state: Any, base: int) -> pd.DataFrame | None:
        """Rows to add after the last row of a key."""
        return None

    def weight(self, rows: pd.DataFrame) -> int:
        """Additive position of rows, e.g. bytes; kept apart from the state so that the
        state can settle."""
        return 0

    def sum_up(self, rows: pd.DataFrame) -> Any:
        """The rows of a whole cut as a JSON-friendly map of entry states to exit states, or None if
        there is no such map."""
        return None

    def pass_through(self, state: Any, summed: Any) -> Any:
        """The exit state of a cut that is entered with ``state``. Raises :class:`NoMap` if the map
        does not hold for it."""
        raise NoMap


class NoMap(Exception):
    """A cut cannot be summed up for some state; it has to be walked."""


def _plain(value: Any) -> Any:
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float) and value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def _segments(table: pa.Table, names: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows with equal key values."""
    changed = np.zeros(len(table), bool)
    changed[:1] = True
    for name in names:
        col = table.column(name).combine_chunks()
        same = pc.fill_null(pc.equal(col[1:], col[:-1]), False)
        empty = pc.is_null(col, nan_is_null=pa.types.is_floating(col.type))
        changed[1:] |= ~pc.or_(same, pc.and_(empty[1:], empty[:-1])).to_numpy(zero_copy_only=False)
    starts = changed.nonzero()[0].tolist()
    head = table.select(list(names)).take(starts).to_pandas(integer_object_nulls=True)
    body = table.drop_columns(list(names)).to_pandas(integer_object_nulls=True)
    for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(table)])):
        yield tuple(_plain(head[n].iloc[i]) for n in names), body.iloc[lo:hi].reset_index(drop=True)


def _walker(
    step: Step,
    keys: Sequence[str],
    schema: StructType,
    entries: dict[tuple, tuple[str, int]],
    want_exits: bool,
    want_rows: bool,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = [*keys, CUT, LAST_CUT]
    own = [f for f in schema.names if f not in names]

    def pack(key: tuple, rows: pd.DataFrame) -> pa.RecordBatch:
        cols = {}
        for name, value in zip(names, key, strict=True):
            cols[name] = pa.array([value] * len(rows), type=arrow.field(name).type)
        for name in own:
            kind = arrow.field(name).type
            cols[name] = pa.Array.from_pandas(rows[name], type=kind) if name in rows else pa.nulls(len(rows), kind)
        return pa.RecordBatch.from_arrays([cols[n] for n in arrow.names], schema=arrow)

    def close(group: tuple, state: Any, base: int, seen: int) -> Iterator[pa.RecordBatch]:
        if want_exits and group[-2] is not None:
            yield pa.RecordBatch.from_pylist(
                [
                    dict.fromkeys(schema.names)
                    | dict(zip(names, group))
                    | {"__state": json.dumps(state, sort_keys=True), "__weight": seen}
                ],
                schema=arrow,
            )
        if want_rows and group[-1]:
            tail = step.finish(state, base + seen)
            if tail is not None and len(tail):
                yield pack(group, tail)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        state, base, seen = None, 0, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for group, rows in _segments(table, names):
                if group != current:
                    if current is not None:
                        yield from close(current, state, base, seen)
                    current, seen = group, 0
                    entry = entries.get(group[:-1])
                    state = json.loads(entry[0]) if entry else step.start()
                    base = entry[1] if entry else 0
                out, state = step.feed(state, rows, base + seen)
                seen += step.weight(rows)
                if want_rows and out is not None and len(out):
                    yield pack(group, out)
        if current is not None:
            yield from close(current, state, base, seen)

    return walk


def _summing(step: Step, keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per cut: its map as JSON (NULL: none) and its weight. Holds the rows of one cut."""
    names = [*keys, CUT, LAST_CUT]

    def close(group: tuple, parts: list[pd.DataFrame], schema: pa.Schema) -> pa.RecordBatch:
        rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        summed = step.sum_up(rows)
        cells = [*group[:-1], None if summed is None else json.dumps(summed), step.weight(rows)]
        fields = [*(schema.field(n) for n in names[:-1]), pa.field("__map", pa.string()), pa.field("__weight", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, fields, strict=True)], schema=pa.schema(fields))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, schema = None, [], None
        for batch in batches:
            schema = batch.schema
            for group, rows in _segments(pa.Table.from_batches([batch]), names):
                if group != current:
                    if current is not None:
                        yield close(current, parts, schema)
                    current, parts = group, []
                parts.append(rows)
        if current is not None:
            yield close(current, parts, schema)

    return walk


def _entering(step: Step, keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entry state and position of every cut, from maps in the order of the cuts: one map is held."""
    width = len(keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, base = None, None, 0
        for batch in batches:
            states, bases = [], []
            for row in zip(*(batch.column(i).to_pylist() for i in range(width + 3)), strict=True):
                if row[:width] != current:
                    current, state, base = row[:width], step.start(), 0
                states.append(json.dumps(state, sort_keys=True))
                bases.append(base)
                try:
                    state = step.pass_through(state, json.loads(row[-2])) if row[-2] else _raise()
                except NoMap:  # from here on this key has to be walked
                    states[-1] = None
                base += row[-1]
            columns = [*(batch.column(i) for i in range(width + 1)), pa.array(states, pa.string()), pa.array(bases, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: width + 1], "__state", "__weight"])

    return walk


def _raise() -> Any:
    raise NoMap


def fold(
    df: DataFrame | Run,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    rows_per_cut: int | None = None,
) -> DataFrame:
    """Run ``step`` over the rows of every key in order. The result has the key columns
    and ``step.output``. ``order`` must be total and non-null inside a key."""
    return fold_run(df, keys, order, step, rows_per_cut=rows_per_cut).done()


def fold_run(
    df: DataFrame | Run,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    out_order: Sequence[str] = (),
    rows_per_cut: int | None = None,
) -> Run:
    """:func:`fold` as a run ordered by ``out_order`` (output columns that grow along the input's
    order): its rows keep the cuts they came from, so further steps need no new ones. Rows that are
    laid out for these keys and this order are walked as they are."""
    keys, order = list(keys), list(order)
    laid = run(df, keys, order, rows_per_cut)
    if laid.keys != laid.cut_keys:
        laid = run(laid.done(), keys, order, rows_per_cut)
    split = laid.split
    if split and not step.forgets and (laid.pending or not laid.dealt):
        own = [c for c in dict.fromkeys([*keys, *order, *step.needs]) if c not in keys or not c.startswith("__")]
        laid = laid.select(*own).store()  # it is walked more than once
    marked = laid.df
    if not split:
        marked = marked.withColumns({CUT: F.lit(None).cast("int"), LAST_CUT: F.lit(True)})
    key_fields, cut_field = [marked.schema[k] for k in keys], marked.schema[CUT]
    # A fixed count, since merging small partitions would serialise the Python work; with the number of cuts it
    # grows with the data.
    tasks = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), laid.pieces)
    there = replace(laid, sorted=False).in_order() if split else marked.repartition(tasks, *keys, CUT).sortWithinPartitions(*keys, CUT, *order)
    ordered = there.select(*keys, CUT, LAST_CUT, *step.needs)

    entries: dict[tuple, tuple[str, int]] = {}
    schema = StructType([*key_fields, cut_field, marked.schema[LAST_CUT], *StructType.fromDDL(step.output).fields])
    if split and step.forgets:
        rows = _walked_once(ordered, keys, key_fields, cut_field, step, schema, out_order, tasks)
        return Run(rows, tuple(keys), tuple(out_order), split, laid.pieces, tuple(keys), dealt=True, sorted=True)
    if split:
        entries = _entries(ordered, keys, key_fields, cut_field, step)

    rows = ordered.mapInArrow(_walker(step, keys, schema, entries, False, True), schema)
    return Run(rows if split else rows.drop(CUT, LAST_CUT), tuple(keys), tuple(out_order), split, laid.pieces, tuple(keys), split)


def _walked_once(ordered: DataFrame, keys: list[str], key_fields: list, cut_field, step: Step, schema: StructType,
                 out_order: Sequence[str], tasks: int) -> DataFrame:
    """The rows of a step that forgets. Every cut is walked from a fresh start; its rows, counted from
    the cut's first, are stored with its exit. Cuts that are entered otherwise are walked again, and so once
    more are those whose entry that changes. All walks go to the same buckets, so rows stay with their cuts and
    are written once; of a cut, what its last walk gave is read."""
    full, fresh = StructType([*schema.fields]).add("__state", "string").add("__weight", "long"), json.dumps(step.start(), sort_keys=True)
    cut_schema, names, spark = StructType([*key_fields, cut_field]), [*keys, CUT], ordered.sparkSession
    kept = Buckets(spark, "walk", names, out_order, tasks)
    exits, used, last = {}, {}, {}

    def walked(nth: int, rows: DataFrame, late: dict[tuple, str]) -> None:
        entered = {g: (state, 0) for g, state in late.items()}
        kept.add(rows.mapInArrow(_walker(step, keys, full, entered, True, True), full).withColumn("__walk", F.lit(nth)))
        ended = kept.rows().where((F.col("__walk") == nth) & F.col("__state").isNotNull())
        found = ended.select(*names, "__state", "__weight").collect()
        exits.update({tuple(r[: len(names)]): (r["__state"], r["__weight"]) for r in found})
        used.update(late)
        last.update(dict.fromkeys(late, nth))

    def late(entries: dict[tuple, tuple[str, int]]) -> dict[tuple, str]:
        return {g: state for g, (state, _) in entries.items() if state != used.get(g, fresh)}

    walked(0, ordered, {})
    entries = {}
    for nth in range(2):
        # the exits of the first walk may settle already; other steps may take many walks to
        entries = _settled(ordered, keys, key_fields, cut_field, step, exits, entries) if nth else _enter(exits, len(keys))
        changed = late(entries)
        if not changed:
            break
        walked(nth + 1, _only(ordered, spark.createDataFrame(list(changed), cut_schema), names), changed)
    places = [(*g, base, last.get(g, 0)) for g, (_, base) in entries.items()]
    placed = attach(kept.close(), spark.createDataFrame(places, cut_schema.add("__base", "long").add("__last", "integer")), names)
    rows = placed.where(F.col("__state").isNull() & (F.col("__walk") == F.coalesce("__last", F.lit(0))))
    return rows.withColumns({p: F.col(p) + F.coalesce("__base", F.lit(0)) for p in step.places}).select(*schema.names)


def _entries(ordered: DataFrame, keys: list[str], key_fields: list, cut_field, step: Step) -> dict[tuple, tuple[str, int]]:
    """Entry state and position of every cut of the hot keys; one row per cut comes to the driver."""
    exit_schema = StructType([*key_fields, cut_field]).add("__state", "string").add("__weight", "long")
    todo, width = ordered.where(F.col(CUT).isNotNull()), len(keys)
    entries: dict[tuple, tuple[str, int]] = {}
    if type(step).sum_up is not Step.sum_up:
        map_schema = StructType([*key_fields, cut_field]).add("__map", "string").add("__weight", "long")
        maps = todo.mapInArrow(_summing(step, keys), map_schema)
        in_order = maps.repartition(*keys).sortWithinPartitions(*keys, CUT)
        found = {tuple(r[: width + 1]): (r["__state"], r["__weight"]) for r in in_order.mapInArrow(_entering(step, keys), exit_schema).collect()}
        if all(state is not None for state, _ in found.values()):
            return found
    walk = _walker(step, keys, exit_schema, entries, True, False)
    exits = {tuple(r[: width + 1]): (r["__state"], r["__weight"]) for r in todo.mapInArrow(walk, exit_schema).collect()}
    return _settled(ordered, keys, key_fields, cut_field, step, exits)


def _settled(ordered: DataFrame, keys: list[str], key_fields: list, cut_field, step: Step, exits: dict[tuple, tuple[str, int]],
             entries: dict[tuple, tuple[str, int]] | None = None) -> dict[tuple, tuple[str, int]]:
    """Entry state and position of every cut, from the exits that fresh starts, or those of ``entries``, lead
    to: cuts whose entry changes are walked again until none does."""
    exit_schema = StructType([*key_fields, cut_field]).add("__state", "string").add("__weight", "long")
    entries, width = entries or {}, len(keys)
    while True:
        settled = _enter(exits, width)
        moved = [g for g, (state, _) in settled.items() if _state_of(entries, g, step) != state]
        entries = settled
        if not moved:
            return entries
        groups = ordered.sparkSession.createDataFrame(moved, StructType([*key_fields, cut_field]))
        walk = _walker(step, keys, exit_schema, entries, True, False)
        for row in _only(ordered, groups, [*keys, CUT]).mapInArrow(walk, exit_schema).collect():
            exits[tuple(row[: width + 1])] = (row["__state"], row["__weight"])


def _state_of(entries: dict, group: tuple, step: Step) -> str:
    return entries[group][0] if group in entries else json.dumps(step.start(), sort_keys=True)


def _enter(exits: dict[tuple, tuple[str, int]], width: int) -> dict[tuple, tuple[str, int]]:
    """Entry state and position of every cut from the exits to its left."""
    entries = {}
    cuts: dict[tuple, list[int]] = {}
    for group in exits:
        cuts.setdefault(group[:width], []).append(group[width])
    for key, present in cuts.items():
        present.sort()
        base = 0
        for left, right in zip(present, present[1:]):
            base += exits[(*key, left)][1]
            entries[(*key, right)] = (exits[(*key, left)][0], base)
    return entries


def _only(df: DataFrame, groups: DataFrame, names: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of the given groups (at most one group per cut, so broadcast). A test of a hash comes
    first where there are few: unlike a join it reaches the rows' source through windows and explodes."""
    if how == "left_semi":
        hashes = [r[0] for r in groups.select(F.xxhash64(*names)).limit(MAX_LISTED + 1).collect()]
        if len(hashes) <= MAX_LISTED:
            df = df.where(F.xxhash64(*names).isin(hashes))
    test = [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]
    return df.alias("l").join(F.broadcast(groups).alias("r"), test, how)
