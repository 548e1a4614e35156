"""What the ordered operators share: a job's window, runs, pairs, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """A new folder under the shared spark.checkpoint.dir. It may be unset only where there is one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tracewright-settled"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df``, computed now, written to the shared folder and read back: lineage ends there, and rows can be pruned."""
    path = f"{work_dir(df.sparkSession)}/table.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW_VALUES, FEW_BYTES = 20_000, 8_000_000  # values of which what they tell is broadcast, and their length in all


def each_row(rows: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame], values: DataFrame | None = None) -> DataFrame:
    """``make(rows)``, where what ``by_value`` takes is wanted but values needn't be told apart."""
    return make(rows)


def by_value(rows: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame], values: DataFrame | None = None) -> DataFrame:
    """``make(rows)``, which adds what ``columns`` alone tell, but made once for each of their values (strings) and broadcast, if these are few.

    If not, it is made row by row, so nothing depends on how many there are. ``values``: a table of all values that may occur, by
    default the rows' own. Values are looked for now, so the rows should be a table that is there."""
    few = settled((rows if values is None else values).select(*columns).distinct().limit(FEW_VALUES + 1))
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in columns])
    n, length = few.agg(F.count(F.lit(1)), F.sum(size)).first()
    if n > FEW_VALUES or (length or 0) > FEW_BYTES:
        return make(rows)
    known = make(few.repartition(n_tasks(rows.sparkSession, 0)))
    known = known.select(*[F.col(c).alias(f"__{c}") for c in columns], *[c for c in known.columns if c not in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return rows.join(F.broadcast(known), same, "left").drop(*[f"__{c}" for c in columns])


ROWS_A_TASK = 20_000  # rows of jobs in one task; where steps are cleaned, a row takes about 15 kB in all of a task's sorts together


def n_tasks(spark: SparkSession, n_rows: int) -> int:
    """As many as Spark deals by default, and more where that would be over ``ROWS_A_TASK`` rows for each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_A_TASK))


def dealt(df: DataFrame, n_rows: int | None = None, by: str = "job_id") -> DataFrame:
    """``df`` dealt by job over tasks whose number grows with its rows (counted, if they aren't given).

    Spark would put tasks together by their bytes, but rows of few words shrink fifty times and more where they are
    written, so a task's memory would grow with the table. Windows by job need no other shuffle."""
    return df.repartition(n_tasks(df.sparkSession, df.count() if n_rows is None else n_rows), by)


def in_order(*order: str) -> Window:
    return Window.partitionBy("job_id").orderBy(*(order or ("ord",)))


def run_id(start: Column, *order: str) -> Column:
    """Numbers runs from 1, each of which begins where ``start`` holds."""
    return F.sum(F.coalesce(start, F.lit(True)).cast("int")).over(in_order(*order).rowsBetween(Window.unboundedPreceding, 0))


def paired(df: DataFrame, edge: Column, *order: str) -> DataFrame:
    """Adds ``first``: rows that pair with the next, taking edges (row, next row) from the left without overlap.

    Within each run of consecutive edges those at odd places are taken, which is the greedy choice."""
    w = in_order(*order)
    df = df.withColumn("__edge", F.coalesce(edge, F.lit(False)))
    df = df.withColumn("__run", F.sum((~F.col("__edge")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("job_id", "__run", "__edge").orderBy(*(order or ("ord",))))
    return df.withColumn("first", F.col("__edge") & (place % 2 == 1)).drop("__edge", "__run")


def fold(df: DataFrame, columns: list[str], order: list[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """job_id, state, rows: a fold over each job's rows in order, for decisions that depend on earlier decisions.

    A job is one recording, whose rows are few by nature; jobs run in parallel."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in dict.fromkeys(columns) if c not in order])))
    return df.groupBy("job_id").agg(rows.alias("rows")).select("job_id", F.aggregate("rows", start, step).alias("state"), "rows")


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once a row: a lambda's variable, where a column would be put into each of its uses."""
    return F.get(F.transform(F.array(value), of), F.lit(0))
