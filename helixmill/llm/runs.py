"""Runs of equal or nearly equal consecutive events.

Both forms use one identity: number the events of an entity in order; number them again within each canonical value;
while a run lasts, the two numbers rise together, so their difference names the run. The canonical value of an event is
whether it is close enough to the event before it, so a chain of small steps is one run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helixmill.llm.arrays import flat_text, slices
from helixmill.session import cut


def run_heads(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First event and length of each run, given for each event whether it goes on from the one before."""
    if not len(linked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.arange(len(linked))
    within = np.where(linked, np.cumsum(linked), np.cumsum(~linked)) - 1
    island = number - within
    i = np.flatnonzero(linked)
    if not len(i):
        return number, np.ones(len(linked), np.int64)
    # an island of linked events, with the event it hangs on, is a run
    head = np.flatnonzero(np.diff(island[i], prepend=island[i[0]] - 1))
    size = np.diff(np.append(head, len(i))) + 1
    first = i[head] - 1
    alone = ~linked & ~np.append(linked[1:], False)
    first = np.concatenate([first, np.flatnonzero(alone)])
    size = np.concatenate([size, np.ones(int(alone.sum()), np.int64)])
    order = np.argsort(first)
    return first[order], size[order]


def symbol_runs(batches: Iterable[pa.RecordBatch], step: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        batch = batch.filter(pc.is_valid(batch.column("text")))
        text = batch.column("text")
        if pc.all(pc.equal(pc.binary_length(text), pc.utf8_length(text))).as_py() is not False:
            flat, offsets = flat_text(text)
        else:
            flat = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), np.uint32)
            offsets = np.append(0, np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False)))
        code = flat.astype(np.int64)
        linked = np.zeros(len(code), bool)
        linked[1:] = np.abs(np.diff(code)) <= step
        linked[offsets[:-1][offsets[:-1] < len(code)]] = False
        first, size = run_heads(linked)
        keep = size >= least
        first, size = first[keep], size[keep]
        row = np.searchsorted(offsets, first, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid").take(pa.array(row)), pa.array((first - offsets[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(code[first].astype(np.int32)), pa.array(code[first + size - 1].astype(np.int32))],
            ["rid", "run_start", "run_len", "first_code", "last_code"],
        )


def collapse_symbols(df: DataFrame, rid: str, text: str, step: int = 1, least: int = 1) -> DataFrame:
    """Runs in which each symbol's code differs by at most ``step`` from the one before, of ``least`` symbols or more.

    The row is the entity, its text the event sequence: no shuffle, and a very long text is one row's work. Null ids
    and texts give no runs, empty texts neither.
    """
    rows = df.where(F.col(rid).isNotNull() & F.col(text).isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: symbol_runs(it, step, least), "rid bigint, run_start int, run_len int, first_code int, last_code int")


def event_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted events of a partition, numbered; ``edge`` marks the first and the last one."""
    piece, number, held = TaskContext.get().partitionId(), 0, None

    def out(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        n = np.arange(number, number + rows.num_rows)
        edge = n == 0
        edge[-1:] |= last
        number += rows.num_rows
        rows = rows.append_column("piece", pa.array(np.full(len(n), piece, np.int32))).append_column("n", pa.array(n)).append_column("edge", pa.array(edge))
        yield from rows.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        entity, v, o = (batch.column(c) for c in ("entity", "v", "o"))
        linked = np.zeros(batch.num_rows, bool)
        linked[1:] = pc.and_(pc.equal(entity[1:], entity[:-1]), pc.equal(v[1:], v[:-1])).to_numpy(zero_copy_only=False)
        first, size = run_heads(linked)
        at = pa.array(first)
        rows = pa.table([entity.take(at), v.take(at), o.take(at), o.take(pa.array(first + size - 1)), pa.array(size)], ["entity", "v", "first", "last", "events"])
        if held is not None:
            if rows["entity"][0] == held["entity"][0] and rows["v"][0] == held["v"][0]:
                both = pa.table([held["entity"], held["v"], held["first"], rows["last"][:1], pc.add(held["events"], rows["events"][:1])], held.schema.names)
                rows = pa.concat_tables([both, rows.slice(1)])
            else:
                rows = pa.concat_tables([held, rows])
        yield from out(rows.slice(0, rows.num_rows - 1), False)
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from out(held, True)


def collapse_events(df: DataFrame, entity: str, order: str, value: str, parts: int | None = None) -> DataFrame:
    """Collapse runs of equal consecutive values of each entity: ``value``, ``events``, ``first`` and ``last``, ``duration``.

    ``order`` is a number (a position or a time); ties are taken in the order of ``value``. Values compare with
    blanks trimmed and case ignored; null is a value like any other. Rows with a null entity or order are left out.
    The events are range-sorted by entity and order into partitions of like size (``parts`` of them, by default those of
    a shuffle), so that an entity with most of the rows is spread over many tasks. Runs are found inside each; only the
    first and the last run of a partition can go on in another, and these few are then joined.
    """
    canon = F.coalesce(F.lower(F.trim(F.col(value).cast("string"))), F.lit("\0null"))
    rows = df.where(F.col(entity).isNotNull() & F.col(order).isNotNull()).select(F.col(entity).alias("entity"), F.col(order).alias("o"), canon.alias("v"))
    by = ("entity", "o", "v")
    pieces = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("entity", "o"))
    runs = cut(pieces.mapInArrow(event_runs, f"entity {kind}, v string, first {number}, last {number}, events bigint, piece int, n bigint, edge boolean"))
    inner = runs.where("not edge").select("entity", "v", "events", "first", "last")
    chain = W.partitionBy("entity").orderBy("piece", "n")  # two rows a partition at most
    goes_on = (F.lag("v").over(chain) == F.col("v")) & (F.lag("piece").over(chain) != F.col("piece"))
    outer = runs.where("edge").withColumn("open", F.when(goes_on, 0).otherwise(1))
    outer = outer.withColumn("run", F.sum("open").over(chain)).groupBy("entity", "v", "run").agg(F.sum("events").alias("events"), F.min("first").alias("first"), F.max("last").alias("last"))
    whole = inner.unionByName(outer.drop("run"))
    return whole.select("entity", F.when(F.col("v") != "\0null", F.col("v")).alias("value"), "events", "first", "last", (F.col("last") - F.col("first")).alias("duration"))
