"""The table of jobs as a sink of streams: rows are created once and updated field by field, and a batch counts once.

    init(spark, root)
    changes.writeStream.foreachBatch(upsert(root))...
    jobs(spark, root)

A change is (id, updated, seq, kind, fields): kind ``create`` makes the job if there is none of that id; kind ``update``
sets the fields it names, null among them, of a job that was there before it. Fields that the table doesn't have are
left out. Changes are in force in the order of (updated, seq), whenever they arrive.

A batch is written under the name of its attempt, then one row says which attempt the batch is, so a batch that is sent
again after a failure changes nothing, and an attempt that died is never read. ``compact`` puts what all batches so far
have come to in the place of their rows.

Cases. A field set twice at the same (updated, seq) has the greater value. A change without an id is left out. Meta that
isn't a JSON object reads as none. A table that was never written to is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {"status": "string", "progress": "double", "message": "string", "input_path": "string", "output_path": "string", "error": "string", "meta_json": "string"}
# What a job has when it is created.
NEW = {"status": "queued", "progress": "0.0", "message": "Queued", "meta_json": "{}"}
CHANGE = "id long, updated long, seq long, kind string, fields map<string,string>"
MARK = "batch long, attempt string, covers array<string>"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def init(spark: SparkSession, root: str) -> None:
    """Make the table if there is none."""
    if not stored(spark, f"{root}/marks/*", MARK).head(1):
        mark(spark, root, -1, None)


def mark(spark: SparkSession, root: str, batch: int, attempt: str | None, covers: list[str] | None = None) -> None:
    spark.createDataFrame([(batch, attempt, covers)], MARK).coalesce(1).write.parquet(f"{root}/marks/{uuid.uuid4().hex}")


def attempts(spark: SparkSession, root: str) -> list[str]:
    """The attempts that count: of each batch the first by name; none that a compacted one covers."""
    marks = stored(spark, f"{root}/marks/*", MARK).where("attempt is not null").collect()  # one row for each batch since the last compaction
    first: dict[int, str] = {}
    for r in marks:
        first[r["batch"]] = min(first.get(r["batch"], r["attempt"]), r["attempt"])
    counted = set(first.values())
    covered = {x for r in marks if r["attempt"] in counted for x in r["covers"] or []}
    return sorted(counted - covered)


def upsert(root: str) -> Callable[[DataFrame, int], None]:
    """What a stream's foreachBatch does with each batch of changes."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if stored(spark, f"{root}/marks/*", MARK).where(F.col("batch") == number).head(1):
            return
        attempt = uuid.uuid4().hex
        known = F.map_filter(F.coalesce("fields", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*FIELDS))
        rows = batch.where("id is not null").select("id", "updated", "seq", "kind", known.alias("fields"))
        rows.write.parquet(f"{root}/changes/{attempt}")
        mark(spark, root, number, attempt)

    return write


def changes(spark: SparkSession, root: str) -> DataFrame:
    found = attempts(spark, root)
    return spark.read.schema(CHANGE).parquet(*[f"{root}/changes/{x}" for x in found]) if found else spark.createDataFrame([], CHANGE)


def in_force(rows: DataFrame) -> DataFrame:
    """id, born (the first create), and for each field ``set_<field>``: (updated, seq, value) of the change that holds."""
    at = F.struct("updated", "seq")
    creates = rows.where("kind = 'create'").groupBy("id").agg(F.min_by(F.struct("updated", "seq", "fields"), at).alias("born"))
    later = rows.where("kind = 'update'").join(creates, "id").where(at > F.struct("born.updated", "born.seq"))
    # One row for each field set, so a change without a field says nothing of it and one with a null does.
    fields = later.select("id", "updated", "seq", F.explode("fields").alias("field", "value"))
    last = fields.groupBy("id", "field").agg(F.max(F.struct("updated", "seq", F.struct("value").alias("to"))).alias("x"))
    by = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "x"))).alias("last"))  # a row for each field at most
    return creates.join(by, "id", "left")


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """id, the fields, created, updated and meta (a map) of every job."""
    rows = in_force(changes(spark, root))
    set_ = lambda f: F.try_element_at("last", F.lit(f))
    born = lambda f: F.coalesce(F.try_element_at("born.fields", F.lit(f)), F.lit(NEW.get(f)).cast("string"))
    value = lambda f, kind: F.when(set_(f).isNotNull(), set_(f)["to"]["value"]).otherwise(born(f)).try_cast(kind).alias(f)
    changed = F.array_max(F.transform(F.map_values("last"), lambda x: x["updated"]))
    out = rows.select("id", *[value(f, kind) for f, kind in FIELDS.items()], F.col("born.updated").alias("created"), F.coalesce(changed, F.col("born.updated")).alias("updated"))
    empty = F.create_map().cast("map<string,string>")
    return out.withColumn("meta", F.coalesce(F.when(F.try_parse_json("meta_json").isNotNull(), F.from_json("meta_json", "map<string,string>")), empty)).drop("meta_json")


def compact(spark: SparkSession, root: str) -> None:
    """Put the changes in force in the place of all changes of the batches so far. It counts once it is marked, at the end.

    Updates of jobs that aren't there yet stay, as an earlier create may still come."""
    covered = attempts(spark, root)
    if len(covered) < 2:
        return
    rows, attempt = changes(spark, root), uuid.uuid4().hex
    held = in_force(rows)
    create = held.select("id", "born.updated", "born.seq", F.lit("create").alias("kind"), "born.fields")
    entries = held.select("id", F.explode("last").alias("field", "x"))
    update = entries.select("id", "x.updated", "x.seq", F.lit("update").alias("kind"), F.map_from_arrays(F.array("field"), F.array("x.to.value")).alias("fields"))
    born = held.select("id", F.struct("born.updated", "born.seq").alias("__born"))
    early = rows.where("kind = 'update'").join(born, "id", "left").where(F.col("__born").isNull() | (F.struct("updated", "seq") <= F.col("__born"))).drop("__born")
    create.unionByName(update).unionByName(early).write.parquet(f"{root}/changes/{attempt}")
    lowest = stored(spark, f"{root}/marks/*", MARK).agg(F.min("batch")).first()[0]
    mark(spark, root, min(lowest, 0) - 1, attempt, covered)
