"""Helpers that keep ordered, keyed work bounded per task.

A window over ``PARTITION BY key`` puts every row of a key in one task.  When
one key may hold a third of the table that task never ends, so ``Ordered``
switches to range-partitioned segments: rows are sorted by (key, order) once,
the sorted table is checkpointed, and each window runs inside a segment.  What
crosses a segment border (last row, running total, ...) travels through a
summary with one row per (key, segment).

Small inputs keep the plain window.  "Small" is decided from the planner's own
size estimate, without running a job.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WINDOW_BYTES = "spark.tallyloom.windowBytes"
DRIVER_ROWS = "spark.tallyloom.driverRows"
QUERY_BYTES = "spark.tallyloom.queryBytes"
_DEFAULTS = {WINDOW_BYTES: 512 << 20, DRIVER_ROWS: 4096, QUERY_BYTES: 64 << 20}


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def plan_bytes(df: DataFrame) -> int:
    """Upper estimate of a DataFrame's size, from the optimizer's statistics.

    Without column statistics the optimizer multiplies the sizes of joined tables, so its figure
    is capped at eight times everything the plan reads.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(int(str(plan.stats().sizeInBytes())), 8 * read)


def is_small(df: DataFrame) -> bool:
    return plan_bytes(df) <= setting(df.sparkSession, WINDOW_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; fall back to a local one in tests only."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    import os
    import shutil

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-pkg-"), "tallyloom")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder on the same shared storage as the checkpoints."""
    import uuid

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work all cores when the input is too small to have many partitions.
    Larger inputs already arrive in one partition per file split and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * (64 << 20) else df


class Ordered:
    """Rows of each key in a total order; windowed columns that survive hot keys.

    ``order`` must be a total order inside a key (append an id column).
    """

    SEG = "__seg"

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], _seg: bool | None = None):
        self.keys, self.order = list(keys), list(order)
        if _seg is None:
            _seg = not is_small(df)
            if _seg:
                df = cut_lineage(df.sort(*self.keys, *self.order).withColumn(self.SEG, F.spark_partition_id()))
        self.df, self.seg = df, _seg

    # -- reshaping that keeps the segment layout --------------------------------
    def _with(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.order, _seg=self.seg)

    def filter(self, cond) -> "Ordered":
        return self._with(self.df.filter(cond))

    def with_column(self, name: str, col: Column) -> "Ordered":
        return self._with(self.df.withColumn(name, col))

    def regrouped(self, keys: list[str], order: list[str]) -> "Ordered":
        """The same rows under other keys, without another sort: inside a new key, ``order`` must be the order they are sorted in."""
        return Ordered(self.df, keys, order, _seg=self.seg)

    def rows(self) -> DataFrame:
        return self.df.drop(self.SEG) if self.seg else self.df

    # -- windowed columns --------------------------------------------------------
    def add(self, **specs) -> "Ordered":
        """Add columns.  Each spec is one of ``prev/next/running/ahead(...)``."""
        keys = self.keys + ([self.SEG] if self.seg else [])
        base = W.partitionBy(*keys) if keys else W.partitionBy()
        forth, back = base.orderBy(*self.order), base.orderBy(*[F.desc(c) for c in self.order])
        df = self.df
        if not self.seg:
            return self._with(df.withColumns({n: s.local(back if s.reverse else forth) for n, s in specs.items()}))

        pos = F.struct(*self.order)
        carry = df.groupBy(*keys).agg(*[s.summary(pos).alias(f"__s_{n}") for n, s in specs.items()])
        across = W.partitionBy(*self.keys) if self.keys else W.partitionBy()
        carry = carry.select(*keys, *[s.across(F.col(f"__s_{n}"), across.orderBy(F.desc(self.SEG) if s.reverse else F.asc(self.SEG))).alias(f"__c_{n}")
                                      for n, s in specs.items()])
        local = df.withColumns({f"__l_{n}": s.boxed(back if s.reverse else forth) for n, s in specs.items()})
        cond = [local[k].eqNullSafe(carry[k]) for k in keys]
        joined = local.join(carry, cond, "left").select(
            *[local[c] for c in df.columns if c not in specs],
            *[s.merge(local[f"__l_{n}"], carry[f"__c_{n}"]).alias(n) for n, s in specs.items()],
        )
        return self._with(joined)


class _Neighbour:
    """Value of the previous (step=-1) or next (step=+1) row of the same key."""

    reverse = False

    def __init__(self, col, step: int):
        self.col, self.step = F.col(col) if isinstance(col, str) else col, step

    def boxed(self, win):
        f = F.lag if self.step < 0 else F.lead
        return f(F.struct(self.col.alias("v"))).over(win)

    def local(self, win):
        return (F.lag if self.step < 0 else F.lead)(self.col).over(win)

    def summary(self, pos):
        return (F.max_by if self.step < 0 else F.min_by)(F.struct(self.col.alias("v")), pos)

    def across(self, c, win):
        return (F.lag if self.step < 0 else F.lead)(c).over(win)

    def merge(self, local, carry):
        return F.coalesce(local, carry)["v"]


class _Running:
    """sum/min/max/last(non-null) over the rows before (or after) the current one.

    ``reverse`` runs over the backward order: Spark computes a frame up to UNBOUNDED FOLLOWING anew for every
    row, which takes the square of the rows, and one from UNBOUNDED PRECEDING by adding a row at a time.
    """

    def __init__(self, op: str, col, include: bool, reverse: bool):
        self.op, self.include, self.reverse = op, include, reverse
        self.col = F.col(col) if isinstance(col, str) else col

    def _frame(self, win):
        return win.rowsBetween(W.unboundedPreceding, 0 if self.include else -1)

    def _agg(self, c):
        if self.op == "last":
            return F.last(c, ignorenulls=True)
        return getattr(F, self.op)(c)

    def local(self, win):
        return self._agg(self.col).over(self._frame(win))

    boxed = local

    def summary(self, pos):
        if self.op == "last":
            by = F.when(self.col.isNotNull(), pos)
            return (F.min_by if self.reverse else F.max_by)(self.col, by)
        return self._agg(self.col)

    def across(self, c, win):
        return self._agg(c).over(_Running(self.op, c, False, self.reverse)._frame(win))

    def merge(self, local, carry):
        if self.op == "sum":
            return F.when(local.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
            )
        if self.op in ("min", "max"):
            return (F.least if self.op == "min" else F.greatest)(local, carry)
        return F.coalesce(local, carry)


def prev(col):
    return _Neighbour(col, -1)


def next_(col):
    return _Neighbour(col, +1)


def running(op: str, col, include: bool = True):
    return _Running(op, col, include, reverse=False)


def ahead(op: str, col, include: bool = False):
    return _Running(op, col, include, reverse=True)


def position(col=None):
    """1-based row position inside the key."""
    return _Running("sum", F.lit(1).cast("long") if col is None else col, True, False)


def first_per(df: DataFrame, keys: list, order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key.  A rank filter: Spark prunes each map task to ``n`` rows
    per key before the shuffle, so a hot key costs no more than any other."""
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)
