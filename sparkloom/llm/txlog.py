"""Operator 12: reassemble the transaction log of many sources.

A log row has a source, a number, what it does, a key and a value. Each source
runs one transaction after another; a commit applies what remains of its
transaction to one shared store.

What becomes of a change follows from what comes after it in its source: the
next savepoint, rollback, commit or abort. If that is a rollback, it undoes the
change. If it is a savepoint, no later rollback reaches the change, as a rollback
keeps its savepoint, and the next commit or abort decides. So one secondary sort
by (source, number), read backwards, needs no more memory than the next control
row and the next end. A second one by (key, commit, number) streams what each
change overwrites. A third one by commit numbers the commits and sums up.

Each sort is by ranges of the whole key, from a bounded sample of keys (20 a
partition), so a source or key of any size is spread over partitions. What a
partition hands to the next is one tuple; the driver sees one a partition, and
their number is a parameter that the input does not change. Lost executors are
made good by Spark from tables in the shared folder, and the order of rows is
total, so a repeated task gives the same rows.

Nulls: a row without a number or an action has no place in the log and is left
out; null is a source and a key of its own; a null value deletes its key. Ties: rows that agree in
source and number stand in the order of ``tie``; rows that agree in that too are
interchangeable but for their value, and stand by it. Repeated rows are rows of
their own: a repeated commit is an empty one. Commits of equal numbers stand by
source, null last, then tie. An empty log gives empty tables. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import table

COMMIT, ABORT, SAVEPOINT, ROLLBACK, CHANGE = range(5)
#: Sampled keys a partition, from which the bounds of a sort are taken.
SAMPLED = 20
#: A commit's place among all commits.
PLACE = ("commit_seq", "commit_null", "commit_source", "commit_tie")


@dataclass
class Reassembled:
    """undone: kind (abort or rollback), seq, by_seq (null: the end of the log), key, source, value.
    commits: the places of all commits. deltas: the commit's place, seq, key, old and new value, in
    which null stands for a key that is not stored."""

    undone: DataFrame
    commits: DataFrame
    deltas: DataFrame
    partitions: int


def sorted_ranges(rows: RDD, n: int, descending: bool = False) -> RDD:
    """(key, value) rows in n ranges of keys, each in order; range 0 has the least keys."""
    total = rows.count()
    part = min(1.0, SAMPLED * n / max(total, 1))
    got = sorted(rows.keys().sample(False, part, 17).collect()) if total else []
    bounds = [got[len(got) * i // n] for i in range(1, n)] if got else []
    return rows.repartitionAndSortWithinPartitions(n, lambda k: bisect.bisect_right(bounds, k), not descending)


def carried(rows: RDD, last: Callable[[Iterator], object], merge: Callable[[object, object], object], backwards: bool = False) -> list:
    """What reaches each partition from those before it: ``last`` gives a partition's own tuple
    (None if it has no rows), merge(state, own) what is handed on. One tuple a partition is collected."""
    own = dict(rows.mapPartitionsWithIndex(lambda i, it: [(i, last(it))]).collect())
    state, out = None, [None] * len(own)
    for i in sorted(own, reverse=backwards):
        out[i] = state
        state = state if own[i] is None else merge(state, own[i])
    return out


class Fate:
    """The state of the backward pass: what comes next in the source at hand."""

    def __init__(self, source=None, control=None, end=None):
        self.source, self.control, self.end = source, control, end

    def see(self, source: tuple, op: int, place: tuple) -> None:
        if op in (COMMIT, ABORT):
            self.control = self.end = (op, place)
        elif op != CHANGE:
            self.control = (op, place)


def _last_fate(it: Iterator) -> tuple | None:
    """(source, control, end, whether the partition has no other source)."""
    at, alone = None, True
    for (source, seq, tie), (op, _, _) in it:
        if at is None or at.source != source:
            alone = at is None
            at = Fate(source)
        at.see(source, op, (seq, *source, tie))
    return at and (at.source, at.control, at.end, alone)


def _merge_fate(state: tuple | None, own: tuple) -> tuple:
    source, control, end, alone = own
    if alone and state and state[0] == source:
        return source, control or state[1], end or state[2], True
    return own


def _fates(handed: list):
    def run(i: int, it: Iterator) -> Iterator[tuple]:
        at = Fate(*(handed[i] or (None,))[:3])
        for (source, seq, tie), (op, key, value) in it:
            if at.source != source:
                at = Fate(source)
            place = (seq, *source, tie)
            if op == CHANGE:
                source_name = None if source[0] else source[1]
                if at.control and at.control[0] == ROLLBACK:
                    yield ("rollback", seq, at.control[1][0], source_name, tie, key, value, None, None, None, None)
                elif at.end and at.end[0] == COMMIT:
                    yield ("change", seq, None, source_name, tie, key, value, *at.end[1])
                else:
                    yield ("abort", seq, at.end[1][0] if at.end else None, source_name, tie, key, value, None, None, None, None)
            elif op == COMMIT:
                yield ("commit", None, None, None, None, None, None, *place)
            at.see(source, op, place)

    return run


def _last_value(it: Iterator) -> tuple | None:
    got = None
    for k, v in it:
        got = (k[0], v)
    return got


def _overwrites(handed: list):
    def run(i: int, it: Iterator) -> Iterator[tuple]:
        at = handed[i]
        for (key, c_seq, c_null, c_source, c_tie, seq, *_), value in it:
            yield (c_seq, c_null, c_source, c_tie, seq, None if key[0] else key[1], at[1] if at and at[0] == key else None, value)
            at = (key, value)

    return run


def reassemble(log: DataFrame, partitions: int | None = None) -> Reassembled:
    """log: source string, seq long, tie long, op int (COMMIT to CHANGE), key long, value of any type."""
    spark = log.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = table(log.where(F.col("seq").isNotNull() & F.col("op").isNotNull()).select("source", F.col("seq").cast("long"), F.coalesce(F.col("tie").cast("long"), F.lit(0)).alias("tie"), F.col("op").cast("int"), F.col("key").cast("long"), "value"), "log")
    value = d.schema["value"].dataType
    order = lambda v: (v is None, v if v is not None else 0)
    rows = d.rdd.map(lambda r: (((r[0] is None, r[0] or ""), r[1], r[2]), (r[3], r[4], r[5])))
    rows = sorted_ranges(rows, n, descending=True)
    handed = carried(rows, _last_fate, _merge_fate, backwards=True)
    place = [StructField("commit_seq", LongType()), StructField("commit_null", LongType()), StructField("commit_source", StringType()), StructField("commit_tie", LongType())]
    schema = StructType([StructField("kind", StringType()), StructField("seq", LongType()), StructField("by_seq", LongType()), StructField("source", StringType()), StructField("tie", LongType()), StructField("key", LongType()), StructField("value", value), *place])
    number = lambda r: r if r[8] is None else (*r[:8], int(r[8]), *r[9:])
    fates = table(spark.createDataFrame(rows.mapPartitionsWithIndex(_fates(handed)).map(number), schema, verifySchema=False), "fates")
    changes = fates.where("kind = 'change'").select("key", *PLACE, "seq", "tie", "value").rdd
    changes = sorted_ranges(changes.map(lambda r: ((order(r[0]), *r[1:7], order(r[7])), r[7])), n)
    handed = carried(changes, _last_value, lambda _, own: own)
    deltas = spark.createDataFrame(changes.mapPartitionsWithIndex(_overwrites(handed)), StructType([*place, StructField("seq", LongType()), StructField("key", LongType()), StructField("old", value), StructField("new", value)]), verifySchema=False)
    undone = fates.where("kind IN ('abort', 'rollback')").select("kind", "seq", "by_seq", "key", "source", "value")
    return Reassembled(undone, fates.where("kind = 'commit'").select(*PLACE), table(deltas, "deltas"), n)


def states(got: Reassembled, measures: dict, every: int = 16) -> DataFrame:
    """epoch, commits and the sums of the measures (columns over deltas) after each epoch of
    ``every`` commits, the last with what is left. Commits without a change count too."""
    names = list(measures)
    d = got.commits.select(*PLACE, F.lit(1).alias("_is"), *[F.lit(0).cast("long").alias(x) for x in names])
    d = d.union(got.deltas.select(*PLACE, F.lit(0), *[c.cast("long").alias(x) for x, c in measures.items()]))
    d = table(d.groupBy(*PLACE).agg(F.sum("_is").alias("_is"), *[F.sum(x).alias(x) for x in names]), "commits")
    m = len(PLACE)
    rows = sorted_ranges(d.rdd.map(lambda r: (tuple(r[:m]), tuple(r[m:]))), got.partitions)
    zero = (0,) * (1 + len(names))
    plus = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))

    def total(it: Iterator) -> tuple:
        out = zero
        for _, v in it:
            out = plus(out, v)
        return out

    handed = carried(rows, total, lambda s, own: plus(s or zero, own))
    whole = rows.values().fold(zero, plus)[0]

    def run(i: int, it: Iterator) -> Iterator[tuple]:
        at = handed[i] or zero
        for _, v in it:
            # equal commits are one row here; all but the first are empty
            first = (at[0] + 1, *plus(at, v)[1:])
            last = plus(at, v)
            for k in range(first[0], last[0] + 1):
                if k % every == 0 or k == whole:
                    yield (-(-k // every), k, *last[1:])
            at = last

    schema = StructType([StructField(x, LongType()) for x in ("epoch", "commits", *names)])
    return got.deltas.sparkSession.createDataFrame(rows.mapPartitionsWithIndex(run), schema, verifySchema=False)
