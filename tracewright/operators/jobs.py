"""Job log, profiles, cost, configuration and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import rules
from tracewright.functions.text import decimals


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, *v) for name, v in rules.PROFILES.items()], ["profile", *rules.PROFILE_FIELDS])


def with_profile(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Jobs with their profile's row, or the default's where the name is unknown."""
    named = jobs.join(profiles.select(F.col("profile").alias("known")).distinct(), F.col("profile") == F.col("known"), "left")
    return named.withColumn("profile", F.coalesce("known", F.lit(rules.DEFAULT_PROFILE))).drop("known").join(profiles, "profile")


def cost_estimate(profiles: DataFrame, prices: dict = rules.PRICES) -> DataFrame:
    """id (if there is one), profile, calls, images, input_tokens, output_tokens, usd.

    Prices of a million tokens are those of the row's own input_price and output_price where there are any."""
    c = F.col
    own = lambda name: F.coalesce(c(name).cast("double"), F.lit(float(prices[name.removesuffix("_price")]))) if name in profiles.columns else F.lit(float(prices[name.removesuffix("_price")]))
    made, check, look = F.ceil(c("max_events") / c("batch")), (c("risky") > 0).cast("int"), (c("reviews") > 0).cast("int")
    calls = F.least(c("max_calls"), made + check + look)
    events = F.least(c("max_events"), c("batch") * F.least(made, F.greatest(F.lit(0), c("max_calls") - check - look)))
    images = events * F.when(c("context"), 3).otherwise(1) + F.least("risky", "max_events") + F.least(c("reviews") * 2, c("max_events") * 2)
    read = calls * prices["call"] + events * prices["event"] + images * prices["image"]
    written = F.least("max_steps", "max_events") * prices["step"]
    usd = F.round(read / 1e6 * own("input_price") + written / 1e6 * own("output_price"), 4)
    return profiles.select(*[x for x in ("id",) if x in profiles.columns], "profile", calls.cast("long").alias("calls"), images.cast("long").alias("images"), read.cast("long").alias("input_tokens"), written.cast("long").alias("output_tokens"), usd.alias("usd"))


def call_budget(profiles: DataFrame) -> DataFrame:
    return profiles.select(*[x for x in ("id",) if x in profiles.columns], "profile", F.greatest(F.lit(1), F.col("max_calls") - 1 - (F.col("reviews") > 0).cast("int")).cast("long").alias("generation_calls"))


def latest(log: DataFrame) -> DataFrame:
    """The last row of each id in an append-only log (id, updated, seq, ...)."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated", "seq")).alias("r")).select("id", "r.*")


def job_state(log: DataFrame, fields: list[str]) -> DataFrame:
    """The present row of each id in a log of partial updates (id, updated, seq, fields): the last value set of each field."""
    at = F.struct("updated", "seq")
    return log.groupBy("id").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields], F.max("updated").alias("updated"))


def meta_of(x: Column) -> Column:
    """A JSON object as a map of strings; empty where it doesn't parse."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, "map<string,string>")), empty)


def created(jobs: DataFrame) -> DataFrame:
    """The first log row of each new job (id, input_path, meta, updated, seq): queued, without progress."""
    return jobs.select("id", "updated", "seq", F.lit("queued").alias("status"), F.lit(0.0).alias("progress"), F.lit("Queued").alias("message"), "input_path", F.coalesce("meta", F.lit("{}")).alias("meta"))


def status_line(progress: Column, message: Column, status: Column) -> Column:
    """Such as ``40% - Reading frames``; the status where there is no message."""
    share = F.floor(F.coalesce(progress.cast("double"), F.lit(0.0)) * 100).cast("int").cast("string")
    return F.concat(share, F.lit("% - "), F.coalesce(F.nullif(message, F.lit("")), status, F.lit("")))


def slowest_stage(jobs: DataFrame, meta: str) -> DataFrame:
    """id, stage, seconds: the stage that took longest by the timings in ``meta``, of equals the first by name."""
    stages = jobs.select("id", F.explode(meta_of(F.col(meta))).alias("stage", "value")).withColumn("seconds", F.col("value").try_cast("double")).where("seconds is not null")
    best = stages.groupBy("id").agg(F.min_by(F.struct("stage", "seconds"), F.struct(-F.col("seconds"), F.col("stage"))).alias("x"))
    return best.select("id", "x.stage", "x.seconds")


def truthy(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("1", "true", "yes", "on")


def capabilities(jobs: DataFrame) -> DataFrame:
    """id, model_ready, mode and mode_after_text: by the key (a placeholder is none), the switch that disables it, and text recognition."""
    key = F.trim(F.coalesce("key", F.lit("")))
    ready = (key != "") & (key != "replace_me") & ~truthy(F.col("disabled"))
    mode = lambda text: F.when(ready, "production_vision").when(text, "local_ocr_draft").otherwise("diagnostic_only")
    return jobs.select("id", ready.alias("model_ready"), mode(F.col("ocr_available")).alias("mode"), mode(F.col("ocr_count") > 0).alias("mode_after_text"))


def evaluation(steps: DataFrame, reports: DataFrame) -> DataFrame:
    """job_id, generation_source, steps, low_confidence, fault: a job that is ready for a demo must have no diagnostic steps."""
    rows = steps.groupBy("job_id", "generation_source").agg(F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("confidence").eqNullSafe(F.lit("high"))).alias("low_confidence"))
    rows = rows.join(reports.select("job_id", "readiness"), "job_id")
    return rows.select("job_id", "generation_source", "steps", "low_confidence", ((F.col("readiness") == "demo_ready") & F.col("generation_source").eqNullSafe(F.lit("diagnostic_fallback"))).alias("fault"))


def documents(steps: DataFrame, reports: DataFrame) -> DataFrame:
    """job_id, document: each job's procedure in Markdown: summary, phase sections, steps, what to check again, quality.

    ``steps``: cleaned, with place, section and phase; a job without steps has the summary and quality only."""
    sure = F.when(F.col("confidence") == "high", "").otherwise(F.concat(F.lit(" *(confidence: "), F.coalesce("confidence", F.lit("unknown")), F.lit(")*")))
    head = F.when(F.row_number().over(Window.partitionBy("job_id", "section").orderBy("place")) == 1, F.concat(F.lit("\n## "), "phase", F.lit("\n\n"))).otherwise("")
    said = F.concat(head, F.col("place").cast("string"), F.lit(". **"), F.coalesce("action", F.lit("")), F.lit("** - "), F.coalesce("expected_output", F.lit("")), sure)
    check = F.when(~F.col("confidence").eqNullSafe(F.lit("high")), F.concat(F.lit("- [ ] step "), F.col("place").cast("string")))
    rows = steps.select("job_id", "place", said.alias("line"), check.alias("check"))
    body = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("place", "line", "check"))).alias("x"))
    body = body.select("job_id", F.array_join("x.line", "\n").alias("body"), F.array_join("x.check", "\n").alias("checks"))
    rows = reports.join(body, "job_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    parts = [
        F.lit("# Procedure of job "), text("job_id"), F.lit("\n\n- readiness: "), text("readiness"), F.lit("\n- steps: "), text("steps"), F.lit("\n- events: "), text("n_events"), F.lit("\n- coverage: "), text("ratio"), F.lit("\n"),
        F.coalesce("body", F.lit("")), F.when(F.coalesce("checks", F.lit("")) != "", F.concat(F.lit("\n\n## To check\n\n"), "checks")).otherwise(""),
        F.lit("\n\n## Quality\n\n- score: "), text("score"), F.lit("\n- merged: "), text("merged"), F.lit("\n- out of order: "), text("violations"), F.lit("\n- blockers: "), F.when(F.col("blockers") == "", "none").otherwise(F.col("blockers")),
    ]
    return rows.select("job_id", F.concat(*parts).alias("document"))


def newest(jobs: DataFrame, n: int) -> DataFrame:
    """The report of the n jobs created last."""
    return jobs.orderBy(F.desc("created"), "id").limit(n)


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Adds batch: consecutive chunks of each job's rows."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("job_id").orderBy("ord")) - 1) / size).cast("int"))


def configured(values: DataFrame) -> DataFrame:
    """key, value, source of the first source that sets it: environment, dotenv, secrets. Blank values don't count."""
    rank = F.array_position(F.array(*map(F.lit, ["environment", "dotenv", "secrets"])), F.col("source"))
    set_ = values.where((F.trim("value") != "") & (rank > 0))
    return set_.groupBy("key").agg(F.min_by(F.struct("value", "source"), rank).alias("x")).select("key", "x.value", "x.source")


def report_totals(reports: DataFrame) -> DataFrame:
    """family, mode, readiness, level, jobs, steps, score of each combination, of each family and mode, of each family, and of all.

    ``level`` tells these apart: 0, 1, 3 and 7, the bits of what is summed up; null is a value of its own besides."""
    c = F.col
    sets = [[c("family"), c("mode"), c("readiness")], [c("family"), c("mode")], [c("family")], []]
    rows = reports.groupingSets(sets, "family", "mode", "readiness")
    return rows.agg(F.grouping_id("family", "mode", "readiness").alias("level"), F.count(F.lit(1)).alias("jobs"), F.sum("steps").alias("steps"), F.round(F.avg("score"), 6).alias("score"))


def phase_table(clean: DataFrame, phases: list[str]) -> DataFrame:
    """job_id and a column p<i> for each of ``phases`` in order: how many of its steps are in it, 0 for none."""
    rows = clean.groupBy("job_id").pivot("phase", phases).agg(F.count(F.lit(1)))
    return rows.select("job_id", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"p{i}") for i, p in enumerate(phases)])


def times() -> list[Column]:
    return [decimals(F.col(c), 1) for c in ("start_time", "end_time")]


def segment_report(spans: DataFrame) -> DataFrame:
    """job_id, report: a line for each segment, in order."""
    line = F.format_string("- %d: %s-%s s, %d frames, score %s", "segment", *times(), "frame_count", decimals(F.col("boundary_score"), 4))
    return spans.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("segment", line.alias("line")))).alias("x")).select("job_id", F.array_join(F.col("x.line"), "\n").alias("report"))


# The lines of a segmentation report.
SUMMARY = "# Segmentation Report\n\n- Frame metrics: %d\n- Boundary candidates: %d\n- Screen states: %d\n- Final event segments: %d\n- Threshold: %s\n- Median/MAD: %s / %s\n\n## Event Segments\n"
SEGMENT = "- #%d %ss-%ss system=%s state=%d score=%s hint=%s\n"


def segmentation_report(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, report: a summary and a line for each segment, in order; a job without segments has the summary only.

    ``jobs``: job_id, n_frames, n_candidates, threshold, median, mad; segments with system, screen_state_id and action_hint."""
    line = F.format_string(SEGMENT, "event_id", *times(), "system", "screen_state_id", decimals(F.col("boundary_score"), 4), "action_hint")
    by = segments.groupBy("job_id").agg(F.size(F.collect_set("screen_state_id")).alias("n_states"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    rows = jobs.join(by, "job_id", "left").fillna(0, ["n_states", "n"])
    summary = F.format_string(SUMMARY, "n_frames", "n_candidates", "n_states", "n", *[decimals(F.col(c), 4) for c in ("threshold", "median", "mad")])
    return rows.select("job_id", F.concat(summary, F.coalesce(F.array_join("x.line", ""), F.lit(""))).alias("report"))


def artifact_counts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """job_id, name, n: rows of each stage's table by job, as ``write_artifacts`` has written them; a stage that
    isn't there has one row without job_id and n, so a job that stopped early can be read as far as it came."""
    out = None
    for name in names:
        try:
            rows = spark.read.json(f"{root}/{name}").groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.count(F.lit(1)).alias("n"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([(None, None)], "job_id long, n long")
        rows = rows.select("job_id", F.lit(name).alias("name"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_artifacts(tables: dict[str, DataFrame], root: str) -> None:
    """One folder of JSON for each stage's table, by job."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("job_id").json(f"{root}/{name}")
