"""One query for each operator over the bound event tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import pixels, rules, score, text
from tracewright.operators import boundaries, cleanup, documents, evidence, jobs, procedure, review, screens, steps
from tracewright.operators.ordered import settled, work_dir
from tracewright.plans import job, report, segments
from tracewright.sources import grid
from tracewright.sources import recordings as R
from tracewright.streaming import folds, jobtable, live, replay

Query = Callable[[SparkSession, str], DataFrame]


def lit(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def duck_rows(rows: list) -> str:
    return ", ".join(f"({i}, {', '.join(lit(v) for v in (r if isinstance(r, tuple) else (r,)))})" for i, r in enumerate(rows))


# The bound relations in SQL.
EV = """ev AS (SELECT user_id AS job_id, row_number() OVER w - 1 AS ord, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9, 6) AS time_sec,
  event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
FRAMES = f"{EV}, frames AS (SELECT job_id, ord, time_sec, event_id, k, round(value / 500, 6) AS boundary_score, round(round(value / 500, 6) / 3, 6) AS visual_score, k % 7 / 10 AS diff_score FROM ev)"
SCREENS = f"{FRAMES}, texts(i, ocr_text) AS (VALUES {duck_rows(R.TEXTS)}), screens AS (SELECT frames.*, ocr_text FROM frames JOIN texts ON k % {len(R.TEXTS)} = i)"
STEPS = f"""{EV}, vocab(i, sys, action, expected_output, confidence) AS (VALUES {duck_rows(R.STEPS)}),
steps AS (SELECT job_id, ord + 1 AS step_number, round(CASE WHEN k % 17 = 0 THEN greatest(0.0, time_sec - 50) ELSE time_sec END, 6) AS time_sec, k,
  CASE WHEN k % 11 = 0 THEN 'Unknown' ELSE sys END AS system, sys AS rule_system, action, expected_output, confidence, k % 7 + 1 AS screen_state_id FROM ev JOIN vocab ON k % {len(R.STEPS)} = i)"""


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def sql_match(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {lit('|'.join(f'(?:{p})' for p in patterns))})"


def sql_has(x: str, terms: list[str]) -> str:
    return sql_match(x, [t.replace(".", r"\.") for t in terms])


def sql_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{3,}}'))"


def sql_content(x: str) -> str:
    stop = ", ".join(map(lit, rules.STOPWORDS))
    return f"list_distinct(list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> '' AND NOT list_contains([{stop}], w)))"


def sql_jaccard(a: str, b: str, both: float) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {both} WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def sql_class(x: str, classes: dict[str, list[str]], default: str) -> str:
    scores = {name: " + ".join(f"contains(lower({x}), {lit(t)})::INT" for t in terms) for name, terms in classes.items()}
    best = f"greatest({', '.join(f'({s})' for s in scores.values())})"
    cases = " ".join(f"WHEN ({s}) = {best} THEN {lit(name)}" for name, s in scores.items())
    return f"CASE WHEN {best} = 0 THEN {lit(default)} {cases} END"


def sql_root(w: str) -> str:
    less = lambda x, end, least: f"CASE WHEN {x} LIKE '%{end}' AND length({x}) > {least} THEN substr({x}, 1, length({x}) - {len(end)}) ELSE {x} END"
    root = w
    for end, least in (("ing", 5), ("ed", 4), ("s", 4)):
        root = f"({less(root, end, least)})"
    return f"CASE WHEN {root} = 'creat' THEN 'create' ELSE {root} END"


def sql_roots(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> ''), lambda w: {sql_root('w')}))"


VERBS = "[" + ", ".join(map(lit, rules.VERBS)) + "]"
A, E = sql_norm("action"), sql_norm("expected_output")
BOTH = f"trim({A} || ' ' || {E})"
MEANINGFUL = f"(list_has_any({sql_roots('action')}, {VERBS}) OR regexp_matches({A}, '\\bstart\\s+creat'))"
CHECKPOINT = f"({sql_match(A, [rf'\b{v}\b' for v in rules.CHECK_VERBS])} AND (regexp_matches({A}, '\\bthat\\b') OR {sql_match(E, [rf'\b{v}\b' for v in rules.CHECK_OUTPUTS])}))"
NOISE = f"({sql_match(BOTH, rules.NOISE)} AND ({sql_match(BOTH, ['presenter', 'outro', 'social', 'youtube', 'subscribe'])} OR NOT {MEANINGFUL}))"
PASSIVE = f"(({sql_match(A, rules.PASSIVE)} OR regexp_matches({E}, '\\bscreen is visible\\b|\\bscreen remains visible\\b')) AND NOT {CHECKPOINT} AND NOT {MEANINGFUL})"
REVIEW = f"regexp_matches({A}, '^(review|validate|verify|confirm that) ')"
GENERIC = f"regexp_matches(trim(regexp_replace(lower(action), '[^a-z0-9 ]+', ' ', 'g')), {lit('^(' + '|'.join(rules.GENERIC_REVIEWS) + ')')})"
FLAGS = f"{STEPS}, flags AS (SELECT *, {MEANINGFUL} AS meaningful, {CHECKPOINT} AS checkpoint, {NOISE} AS noise, {PASSIVE} AS passive, {REVIEW} AS review, {GENERIC} AS generic FROM steps)"
BOTH_TEXT = "(coalesce(action, '') || ' ' || coalesce(expected_output, ''))"
RISKY = f"(coalesce(confidence, '') <> 'high' OR {sql_match(BOTH_TEXT, [rules.SPECIFIC_ACTION])} OR {sql_match(BOTH_TEXT, [rules.EXACT_VALUE])} OR (rule_system <> 'Other' AND system <> rule_system))"
REDACT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\b\d{{4,}}|\$?\d+\.\d{{2}}\b', 'the visible value', 'g'), '\b[Cc]lick\b', 'Select', 'g'), '\b[Tt]ype\b', 'Enter', 'g'), '\s+', ' ', 'g'))"
THRESHOLD = f"""{FRAMES}, rest AS (SELECT job_id, boundary_score AS x FROM frames WHERE ord > 0),
one AS (SELECT job_id, median(x) AS m, quantile_cont(x, 0.88) AS p88, quantile_cont(x, 0.94) AS p94, max(x) - min(x) AS r FROM rest GROUP BY 1),
dev AS (SELECT job_id, median(abs(x - m)) AS d FROM rest JOIN one USING (job_id) GROUP BY 1),
th AS (SELECT job_id, coalesce(m, 0) AS median, coalesce(CASE WHEN d = 0 THEN 1e-6 ELSE d END, 0) AS mad, coalesce(p88, 1) AS percentile,
  coalesce(CASE WHEN r < 0.03 THEN p94 ELSE greatest(m + 2.5 * CASE WHEN d = 0 THEN 1e-6 ELSE d END, p88) END, 1) AS threshold FROM (SELECT DISTINCT job_id FROM frames) LEFT JOIN one USING (job_id) LEFT JOIN dev USING (job_id))"""
MAX_SEGMENTS = 20
QUALIFIED = f"""{THRESHOLD}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY boundary_score DESC, ord) AS rank, count(*) OVER (PARTITION BY job_id) AS n FROM frames JOIN (SELECT job_id, CASE WHEN max(time_sec) - min(time_sec) < 20 THEN 1.0 ELSE 3.0 END AS calm FROM frames GROUP BY 1) USING (job_id) WHERE ord > 0),
q AS (SELECT row_number() OVER (PARTITION BY job_id ORDER BY ord) AS i, r.*, boundary_score >= threshold AS by_score FROM ranked r JOIN th USING (job_id)
  WHERE boundary_score >= threshold OR (rank <= least(greatest(2, {MAX_SEGMENTS // 3}), greatest(2, n // 4)) AND boundary_score >= greatest(0.01, percentile * 0.75))),
f AS (SELECT job_id, 0 AS i, []::STRUCT(ord BIGINT, time_sec DOUBLE, score DOUBLE, reason VARCHAR)[] AS kept FROM (SELECT DISTINCT job_id FROM q)
  UNION ALL SELECT f.job_id, q.i, CASE WHEN len(kept) >= {MAX_SEGMENTS - 1} AND len(kept) > 0 THEN kept
    WHEN len(kept) > 0 AND q.time_sec - kept[-1].time_sec < calm THEN CASE WHEN q.boundary_score > kept[-1].score THEN list_append(kept[:-2], {{'ord': q.ord, 'time_sec': q.time_sec, 'score': q.boundary_score, 'reason': 'hysteresis-replace'}}) ELSE kept END
    ELSE list_append(kept, {{'ord': q.ord, 'time_sec': q.time_sec, 'score': q.boundary_score, 'reason': CASE WHEN q.by_score THEN 'adaptive-threshold' ELSE 'top-percentile' END}}) END
  FROM f JOIN q ON q.job_id = f.job_id AND q.i = f.i + 1),
cand AS (SELECT job_id, x.ord AS ord, x.time_sec AS time_sec, x.score AS boundary_score, x.reason AS reason FROM (SELECT job_id, unnest(arg_max(kept, i)) AS x FROM f GROUP BY job_id))"""
SPANS = f"""{QUALIFIED}, marked AS (SELECT frames.*, 1 + sum((cand.ord IS NOT NULL)::INT) OVER (PARTITION BY frames.job_id ORDER BY frames.ord) AS segment FROM frames LEFT JOIN cand ON cand.job_id = frames.job_id AND cand.ord = frames.ord),
grouped AS (SELECT job_id, segment, min(ord) AS start_ord, max(ord) + 1 AS end_ord, min(time_sec) AS start_time, max(time_sec) AS end_time, count(*) AS frame_count, arg_min(boundary_score, ord) AS own FROM marked GROUP BY 1, 2),
spans AS (SELECT job_id, segment, start_ord, end_ord, start_time, end_time, frame_count, coalesce(lead(own) OVER (PARTITION BY job_id ORDER BY segment), 0.0) AS boundary_score FROM grouped)"""
LONGEST = 30.0
PARTS = f"""{SPANS}, targets AS (SELECT *, unnest(range(1, k::INT)) AS i FROM (SELECT *, greatest(2, ceil((end_time - start_time) / {LONGEST})) AS k FROM spans WHERE end_time - start_time > {LONGEST})),
picked AS (SELECT t.job_id, t.segment, t.start_ord, t.end_ord, t.i, t.k, (SELECT o FROM (SELECT f.ord AS o, abs(f.time_sec - (t.start_time + (t.end_time - t.start_time) * t.i / t.k)) AS a, -f.boundary_score AS s FROM frames f
  WHERE f.job_id = t.job_id AND f.boundary_score >= 0.01 AND f.ord > t.start_ord AND f.ord < t.end_ord - 1) ORDER BY a, s, o LIMIT 1) AS o FROM targets t),
edges AS (SELECT job_id, segment, start_ord AS cut, end_ord FROM spans UNION SELECT job_id, segment, cut, end_ord FROM
  (SELECT *, coalesce(o, least(end_ord - 1, greatest(start_ord + 1, round_even(start_ord + (end_ord - start_ord) * i / k, 0)::BIGINT))) AS cut FROM picked) WHERE cut > start_ord AND cut < end_ord),
parts AS (SELECT job_id, segment, row_number() OVER w AS part, cut AS start_ord, coalesce(lead(cut) OVER w, end_ord) AS end_ord, count(*) OVER (PARTITION BY job_id, segment) > 1 AS forced FROM edges WINDOW w AS (PARTITION BY job_id, segment ORDER BY cut))"""


def spans_of(spark: SparkSession, sf_dir: str):
    frames = R.frames(spark, sf_dir)
    return frames, boundaries.spans(frames, boundaries.boundary_candidates(frames, MAX_SEGMENTS))


def parts_of(spark: SparkSession, sf_dir: str):
    frames, spans = spans_of(spark, sf_dir)
    return frames, boundaries.split_long(spans, frames, LONGEST)


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", score.average_hash(F.col("embedding")).alias("hash"))


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled screens with a hash and a state number by key."""
    rows = screens.labelled(R.screens(spark, sf_dir))
    return rows.withColumn("hash", F.lpad(F.lower(F.hex(F.col("k") % 5 * 1023)), 16, "0")).withColumn("screen_state_id", (F.col("k") % 3).cast("int"))


def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the one before."""
    from pyspark.sql import Window

    rows = R.table(spark, sf_dir, "conversations")
    return rows.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", "text", F.coalesce("before", F.lit("")).alias("before"))


TURNS = "t AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)"


def q_jaccards(spark, sf_dir):
    a, b = F.col("text"), F.col("before")
    return turns(spark, sf_dir).select(
        "conv_id", "turn", F.round(text.jaccard(text.tokens(a), text.tokens(b), 1.0), 6).alias("token_jaccard"), F.round(text.jaccard(text.tokens(a), text.tokens(b), 0.0), 6).alias("similarity"),
        F.round(text.jaccard(text.content_tokens(a), text.content_tokens(b), 1.0), 6).alias("content_jaccard"))


def q_updates(spark, sf_dir):
    base = R.steps(spark, sf_dir)
    changes = base.where("k % 5 = 0").select("job_id", "step_number", F.concat("action", F.lit(" (checked)")).alias("action"), F.lit("medium").alias("confidence"), F.lit(1).alias("pos"))
    twice = base.where("k % 10 = 0").select("job_id", "step_number", F.concat("action", F.lit(" (checked twice)")).alias("action"), F.lit("high").alias("confidence"), F.lit(2).alias("pos"))
    return steps.updated(base, changes.unionByName(twice))


def q_config(spark, sf_dir):
    """Settings by customer: up to four sources set the same key, one of which doesn't count, and some values are blank."""
    c = F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, ["environment", "dotenv", "secrets", "other"])), ((c * 7) % 4 + 1).cast("int"))
    rows = R.table(spark, sf_dir, "customer").where(c % 5 > 0)
    return jobs.configured(rows.select(source.alias("source"), F.concat(F.lit("K"), F.floor(c / 4).cast("string")).alias("key"), F.when(c % 3 == 0, " ").otherwise(F.col("c_name")).alias("value")))


def planned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each customer: the profile of its market segment, with numbers and prices of its own."""
    c, names = F.col("c_custkey"), F.create_map(*(F.lit(x) for pair in PLANS.items() for x in pair))
    rows = jobs.with_profile(R.table(spark, sf_dir, "customer").select(c.alias("id"), F.try_element_at(names, "c_mktsegment").alias("profile")), jobs.profiles(spark))
    n = F.col("id")
    own = {"max_events": F.col("max_events") + n % 7, "batch": F.col("batch") + n % 3, "max_calls": n % 9 + 1, "risky": F.when(n % 3 == 0, 0).otherwise(F.col("risky")), "reviews": F.when(n % 4 == 0, 0).otherwise(F.col("reviews") + n % 2)}
    return rows.withColumns(own).withColumns({"input_price": F.when(n % 5 == 0, 2.5), "output_price": F.when(n % 10 == 0, 12.0)})


PHASE_COLUMNS = sorted({phase for table in rules.PHASES.values() for _, phase in table} | {name for name, _ in rules.PIVOT_PHASES + rules.PIVOT_OVERRIDES} | {rules.PIVOT_DEFAULT})
PLANS = {"BUILDING": "Balanced", "MACHINERY": "none such", "AUTOMOBILE": "Lowest cost", "FURNITURE": "Highest accuracy"}
PLANNED = f"""{{profiles}}, plan AS (SELECT c_custkey AS id, p.* REPLACE (max_events + c_custkey % 7 AS max_events, batch + c_custkey % 3 AS batch, c_custkey % 9 + 1 AS max_calls, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE risky END AS risky,
  CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE reviews + c_custkey % 2 END AS reviews), CASE WHEN c_custkey % 5 = 0 THEN 2.5 ELSE 5.0 END AS input_price, CASE WHEN c_custkey % 10 = 0 THEN 12.0 ELSE 30.0 END AS output_price
  FROM customer JOIN p ON profile = CASE c_mktsegment WHEN 'BUILDING' THEN 'Balanced' WHEN 'AUTOMOBILE' THEN 'Lowest cost' WHEN 'FURNITURE' THEN 'Highest accuracy' ELSE 'Showcase fast' END)"""


def said_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers about turns of conversations: fenced, with words around, broken, without an array, or with items that aren't objects."""
    n = F.col("conv_id") * 100 + F.col("turn")
    item = F.to_json(F.struct(n.alias("id"), F.col("text").alias("action")))
    shapes = [F.concat(F.lit("```json\n["), item, F.lit("]\n```")), F.concat(F.lit("Here it is: ["), item, F.lit(", "), item, F.lit("] as asked.")), F.concat(F.lit("["), item, F.lit(", {broken]")), item, F.lit(None).cast("string")]
    rows = R.table(spark, sf_dir, "conversations").select(n.alias("n"), F.element_at(F.array(*shapes), (n % 5 + 1).cast("int")).alias("said"))
    return rows.select("n", F.posexplode(text.parsed_items(F.col("said"), "struct<id:long,action:string>")).alias("at", "x")).select("n", "at", "x.id", F.md5("x.action").alias("action_md5"))


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the family and mode of their job."""
    rows, info, _, reports = report.tables(spark, sf_dir)
    return reports.join(cleanup.workflow_family(rows), "job_id").join(info.select("job_id", "mode"), "job_id")


def by_day(rows: DataFrame) -> DataFrame:
    """Frames or steps with the day of their recording."""
    return rows.withColumn("day", F.floor(F.col("time_sec") / 24))


def q_sketched(spark, sf_dir):
    """Sketched thresholds whose rank among all scores is within the error of the exact one's."""
    rows = R.frames(spark, sf_dir)
    found = boundaries.sketched_thresholds(by_day(rows), "day")
    ranks = rows.where("ord > 0").join(found.select("job_id", F.col("median").alias("m"), F.col("percentile").alias("p")), "job_id").groupBy("job_id").agg(
        *[F.count_if(F.col("boundary_score") < F.col(c)).alias(f"under_{c}") for c in "mp"], *[F.count_if(F.col("boundary_score") <= F.col(c)).alias(f"upto_{c}") for c in "mp"], F.count(F.lit(1)).alias("n"))
    near = lambda c, p: (F.col(f"under_{c}") <= (p + 0.02) * F.col("n") + 1) & (F.col(f"upto_{c}") >= (p - 0.02) * F.col("n") - 1)
    return ranks.select("job_id", "n", near("m", 0.5).alias("median_near"), near("p", 0.88).alias("percentile_near"))


def job_log(spark, sf_dir):
    orders = R.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated"), F.col("o_orderkey").alias("seq"))


def local_events(spark, sf_dir):
    rows = screens.labelled(R.screens(spark, sf_dir))
    state = F.when(F.col("k") % 4 > 0, F.col("k") % 4)
    return rows.select("job_id", (F.col("ord") + 1).alias("event_id"), F.col("ocr_text").alias("clean_text"), "system", text.hint_of(F.col("ocr_text")).alias("action_hint"), state.alias("screen_state_id"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's items for every third event: some fields blank, some twice, some with a confidence that doesn't exist."""
    k, n = F.col("k"), F.col("ord").cast("string")
    rows = R.frames(spark, sf_dir).where("k % 3 = 0").withColumn("pos", F.explode(F.when(k % 12 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        "job_id", (F.col("ord") + 1).alias("event_id"), "pos", F.when(k % 2 == 0, "SAP").alias("system"), F.when(k % 5 > 0, F.concat(F.lit(" Post document "), n, F.lit(" take "), F.col("pos").cast("string"))).otherwise(" ").alias("action"),
        F.when(k % 4 > 0, "It is posted.").alias("expected_output"), F.when(k % 9 == 0, "certain").otherwise("High").alias("confidence"),
    )


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local writer's steps with what is known of their segments."""
    events = local_events(spark, sf_dir)
    seen = R.screens(spark, sf_dir).select("job_id", (F.col("ord") + 1).alias("step_number"), "k", "ocr_text", "boundary_score", "time_sec")
    made = steps.local_steps(events).select("job_id", F.col("event_id").alias("step_number"), "action", "expected_output")
    known = events.select("job_id", F.col("event_id").alias("step_number"), "system", "action_hint", "screen_state_id")
    return made.join(known, ["job_id", "step_number"]).join(seen, ["job_id", "step_number"]).withColumns({"start_time": F.col("time_sec"), "end_time": F.when(F.col("k") % 13 > 0, F.col("time_sec") + F.col("k") % 50)})


def q_verified(spark, sf_dir):
    """Every second step that is sent is updated, some only in part."""
    rows = steps.risk_flags(R.steps(spark, sf_dir)).select("job_id", "step_number", "k", "system", "action", "expected_output", "confidence", "risky")
    k = F.col("k")
    updates = review.to_verify(rows, 8).where("k % 2 = 0").select(
        "job_id", "step_number", F.lit(1).alias("pos"), F.when(k % 6 == 0, "PDF").otherwise("").alias("system"), F.concat("action", F.lit(" Click 12345.")).alias("action"), F.lit(None).cast("string").alias("expected_output"), F.when(k % 4 == 0, "sure").otherwise("low").alias("confidence"))
    return review.verified(rows, updates).select("job_id", "step_number", "system", "action", "expected_output", "confidence", "verified")


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a system, a text and a change score."""
    return screens.labelled(R.screens(spark, sf_dir)).select("job_id", "ord", "time_sec", "system", F.col("ocr_text").alias("text"), F.col("visual_score").alias("diff_score"), "k")


def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the paths of three frames, some of which are the same or not there."""
    frame = lambda n: F.when(n % 10 != 3, F.concat(F.lit("f"), n.cast("string")))
    rows = stated(spark, sf_dir).select("job_id", F.col("ord").alias("segment"), frame(F.col("ord")).alias("stable_frame"), frame(F.col("ord") - F.col("k") % 2).alias("entry_frame"), frame(F.col("ord") + 1).alias("after_frame"), F.col("hash").alias("image_hash"), F.round(F.col("boundary_score") / 10, 6).alias("boundary_score"), (F.col("k") % 9 == 0).alias("forced"))
    return rows


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read for the roles of each segment."""
    role = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r).alias("role")) for i, r in enumerate(["stable_frame", "entry_frame", "after_frame"])]))
    rows = R.frames(spark, sf_dir).where("k % 8 <> 5").select("job_id", F.col("ord").alias("segment"), "k", role.alias("r")).select("job_id", "segment", "k", "r.*")
    return rows.withColumns({"text": R.pick(R.TEXTS, F.col("k") + 5 * F.col("pos")), "structure": (F.col("k") * 7 + F.col("pos") * 13) % 10 / 10})


def job_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of partial updates of jobs: each order changes some fields of its customer's job; some meta is not JSON."""
    n = F.col("o_orderkey")
    rows = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated"), n.alias("seq"), F.when(n % 3 > 0, F.col("o_orderstatus")).alias("status"), (n % 100).alias("x"))
    meta = F.when(F.col("seq") % 7 == 0, F.lit("{broken")).when(F.col("seq") % 2 == 0, F.concat(F.lit('{"extraction": '), F.col("x").cast("string"), F.lit(', "cleanup": '), (F.lit(100) - F.col("x")).cast("string"), F.lit("}")))
    return rows.select("id", "updated", "seq", "status", F.when(F.col("seq") % 5 == 0, F.col("x") / 100).alias("progress"), meta.alias("meta"))


def q_ordering(spark, sf_dir):
    k = F.col("k")
    rows = R.steps(spark, sf_dir).select("job_id", "step_number", "k", "time_sec").withColumns({
        "start_time": F.when(k % 5 == 0, F.col("time_sec") + 1), "screenshot": F.when(k % 4 == 0, F.format_string("frame_%04d_%05ds.jpg", F.col("step_number"), k * 7)), "event_index": F.when(k % 9 > 0, F.col("step_number") * 2)})
    return cleanup.ordering_keys(rows.withColumn("time_sec", F.when(k % 3 == 0, F.col("time_sec")))).select("job_id", "step_number", "kind", "value", "place")


def timed(spark, sf_dir):
    """Steps of which some have no time, and of these some no event either."""
    k = F.col("k")
    rows = R.steps(spark, sf_dir).select("job_id", "step_number", "k", F.when(k % 7 > 0, F.col("time_sec")).alias("time_sec"))
    return rows.withColumn("source_event_index", F.when(k % 2 == 0, F.col("step_number")))


def q_recordings(spark, sf_dir):
    """The sampling grid of recordings by the source, from files made of the frames' jobs."""
    path = f"{work_dir(spark)}/recordings"
    R.frames(spark, sf_dir).groupBy("job_id").agg(F.max("time_sec").alias("duration")).write.parquet(path)
    spark.dataSource.register(grid.Recordings)
    return spark.read.format("recording").option("path", path).option("interval", "4.5").option("most", "40").load()


def at_events(rows: DataFrame, spark, sf_dir) -> DataFrame:
    """Rows by event_id with the job and time of their event, without what only a whole recording tells."""
    when = R.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.join(when, "event_id")


def q_stream_boundaries(spark, sf_dir):
    rows = at_events(R.frames(spark, sf_dir).select("job_id", "event_id", "boundary_score"), spark, sf_dir)
    return replay.replayed(rows, lambda s: folds.boundary_candidates(s, MAX_SEGMENTS))


def q_stream_scroll(spark, sf_dir):
    rows = stated(spark, sf_dir).select("job_id", "event_id", "ocr_text", "system", "screen_state_id", "visual_score", "boundary_score")
    return replay.replayed(at_events(rows, spark, sf_dir), folds.scroll_collapse)


def in_place(spark, sf_dir):
    """Steps at the times of their events."""
    events = R.frames(spark, sf_dir).select("job_id", (F.col("ord") + 1).alias("step_number"), "event_id", F.col("time_sec").alias("at"))
    return R.steps(spark, sf_dir).join(events, ["job_id", "step_number"]).withColumn("time_sec", F.col("at")).drop("at")


def q_stream_dedupe(spark, sf_dir):
    rows = in_place(spark, sf_dir).select("job_id", "event_id", "action", "expected_output", "system", "rule_system", "confidence", "screen_state_id")
    return replay.replayed(at_events(rows, spark, sf_dir), folds.validated)


def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the jobs of customers by their orders: some create, some set fields, one of which no job has, and some set a field to nothing."""
    n, text = F.col("o_orderkey"), lambda c: c.cast("string")
    rows = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("updated"), n.cast("long").alias("seq"), F.when(n % 4 == 0, "create").otherwise("update").alias("kind"), n.alias("n"), F.col("o_orderstatus").alias("s"))
    entry = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    n = F.col("n")
    fields = F.array_compact(F.array(entry(n % 3 > 0, "status", F.col("s")), entry(n % 5 == 0, "progress", n % 100 / 100), entry(n % 2 == 0, "color", F.lit("red")), entry(n % 7 == 0, "error", F.when(n % 2 == 0, text(n))), entry(n % 6 == 0, "meta_json", F.when(n % 12 == 0, "{broken").otherwise(F.concat(F.lit('{"k": '), text(n), F.lit("}"))))))
    return rows.select("id", "updated", "seq", "kind", F.map_from_entries(fields).alias("fields"))


def q_job_table(spark, sf_dir):
    """The changes sent as a stream of three batches, one of them twice, with a compaction between."""
    root = work_dir(spark)
    rows, sink = job_changes(spark, sf_dir), jobtable.upsert(f"{root}/jobs")
    jobtable.init(spark, f"{root}/jobs")
    for i in range(3):
        rows.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    for part in ("first", "again"):  # the second query knows nothing of the first one's progress, so it sends all batches anew
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/{part}").trigger(availableNow=True).start().awaitTermination()
        jobtable.compact(spark, f"{root}/jobs")
    got = jobtable.jobs(spark, f"{root}/jobs")
    return got.select("id", "status", "progress", "message", "error", "created", "updated", F.coalesce(F.try_element_at("meta", F.lit("k")), F.lit("")).alias("k"))


def q_slowest(spark, sf_dir):
    return jobs.slowest_stage(jobs.job_state(job_updates(spark, sf_dir), ["status", "progress", "meta"]), "meta")


def q_capabilities(spark, sf_dir):
    c = F.col("c_custkey")
    rows = R.table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 4 == 0, "replace_me").when(c % 4 == 1, "key").when(c % 4 == 2, " ").alias("key"), F.when(c % 3 == 0, "yes").when(c % 3 == 1, "0").alias("disabled"), (c % 2 == 0).alias("ocr_available"), (c % 5).alias("ocr_count"))
    return jobs.capabilities(rows)


def pixel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring embeddings as 8 by 8 images of 0 to 255."""
    rows = R.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(127.5 + 127.5 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double")))).cast("int")).alias("pixels"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("pixels").alias("after"))
    return rows.withColumnRenamed("pixels", "before").join(after, "vec_id")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 by 8 images; those of one label are a recording."""
    rows = pixel_pairs(spark, sf_dir).select("vec_id", F.col("before").alias("pixels"))
    labels = R.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("job_id"))
    return rows.join(labels, "vec_id").select("job_id", F.col("vec_id").alias("ord"), "pixels", score.average_hash(F.col("pixels")).alias("hash"))


def q_metrics(spark, sf_dir):
    rows = pixels.frame_metrics(images(spark, sf_dir), 8, 8)
    return rows.select("job_id", "ord", *[F.round(c, 5).alias(c) for c in ("absdiff", "ssim_delta", "edge_delta", "hash_delta", "visual_score")])


def q_small(spark, sf_dir):
    """Halved images, and their average hash."""
    rows = pixels.resize(images(spark, sf_dir), 8, 8, 4, 4)
    return rows.select("ord", F.array_join("pixels", " ").alias("small"))


def q_merges(spark, sf_dir):
    spans = spans_of(spark, sf_dir)[1]
    decisions = spans.select("job_id", "segment", F.when((F.col("start_ord") + F.col("segment")) % 3 == 0, "merge").otherwise("keep").alias("decision"))
    return evidence.apply_merges(spans, decisions)


def q_texts(spark, sf_dir):
    rows = evidence.texts_by_role(R.frames(spark, sf_dir).select("job_id", F.col("ord").alias("segment")), read_texts(spark, sf_dir))
    return rows.select("job_id", "segment", F.size("texts").alias("n"), F.coalesce(F.try_element_at("texts", F.lit("entry_frame")), F.lit("")).alias("entry_text"))


def q_paragraphs(spark, sf_dir):
    rows, info, clean, reports = report.tables(spark, sf_dir)
    return documents.blocks(clean, settled(reports), settled(procedure.removed_steps(rows, info)), info)


def queries() -> dict[str, Query]:
    """Name to query; each takes (spark, sf_dir)."""
    st, fr, sc = R.steps, R.frames, R.screens
    return {
        "threshold_by_job": lambda s, d: boundaries.thresholds(fr(s, d)).select("job_id", *[F.round(c, 6).alias(c) for c in ("median", "mad", "percentile", "threshold")]),
        "frame_deltas": lambda s, d: boundaries.frame_deltas(fr(s, d)),
        "recording_source": q_recordings,
        "sampling_grid": lambda s, d: R.sampling_grid(fr(s, d).groupBy("job_id").agg(F.max("time_sec").alias("duration")), 4.5, 40),
        "boundary_candidates": lambda s, d: boundaries.boundary_candidates(fr(s, d), MAX_SEGMENTS),
        "segment_spans": lambda s, d: spans_of(s, d)[1],
        "forced_split": lambda s, d: parts_of(s, d)[1],
        "segment_topk": lambda s, d: (lambda x: boundaries.top_spans(x[1], x[0], 12))(parts_of(s, d)),
        "stable_frame": lambda s, d: (lambda x: boundaries.stable_frames(x[1], x[0]))(parts_of(s, d)),
        "segment_report": lambda s, d: jobs.segment_report(spans_of(s, d)[1]),
        "average_hash": lambda s, d: hashed(s, d),
        "visual_scores": lambda s, d: R.frames(s, d).select("job_id", "ord", F.round(score.visual_score(F.col("boundary_score"), F.col("k") % 10 / 11, F.col("k") % 7 / 7, F.col("k") % 64 / 63), 6).alias("score")),
        "hash_distance": lambda s, d: (lambda h: h.alias("a").join(h.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), text.hash_distance(F.col("a.hash"), F.col("b.hash")).alias("distance")))(hashed(s, d)),
        "classify_system": lambda s, d: screens.labelled(sc(s, d)).select("job_id", "ord", "system", text.hint_of(F.col("ocr_text")).alias("hint")),
        "classify_pages": lambda s, d: R.table(s, d, "pages").select("page_id", text.system_of(F.col("url")).alias("system")),
        "smooth_systems": lambda s, d: screens.smooth_systems(screens.labelled(sc(s, d))).select("job_id", "ord", "system", "inherited"),
        "text_deltas": lambda s, d: screens.text_deltas(screens.labelled(sc(s, d))),
        "repeated_runs": lambda s, d: screens.repeated_runs(stated(s, d), "screen_state_id").select("job_id", "ord", "screen_state_id", "dense_repeated_run"),
        "screen_states": lambda s, d: screens.screen_states(stated(s, d)),
        "scroll_collapse": lambda s, d: screens.scroll_collapse(stated(s, d)),
        "jaccards": q_jaccards,
        "tokens": lambda s, d: turns(s, d).select("conv_id", "turn", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.size(text.content_tokens(F.col("text"))).alias("n_content"), F.round(text.text_strength(F.col("text")), 6).alias("strength")),
        "clean_lines": lambda s, d: sc(s, d).select("event_id", text.clean_lines(F.col("ocr_text")).alias("cleaned")),
        "redact_documents": lambda s, d: doc_text(s, d).select("doc_id", F.md5(text.redacted(F.col("text"))).alias("redacted_md5")),
        "verb_roots": lambda s, d: st(s, d).select("job_id", "step_number", F.array_join(F.array_sort(text.action_roots(F.col("action"))), " ").alias("roots")),
        "step_flags": lambda s, d: cleanup.step_flags(st(s, d)).select("job_id", "step_number", "meaningful", "checkpoint", "noise", "passive", "review", "generic"),
        "risk_flags": lambda s, d: steps.risk_flags(st(s, d)).select("job_id", "step_number", "risky"),
        "verify_offline": lambda s, d: steps.verified_offline(steps.risk_flags(st(s, d))).select("job_id", "step_number", "action", "expected_output", "confidence"),
        "repair_steps": lambda s, d: steps.repaired(st(s, d)).select("job_id", "step_number", "action", "system", "confidence"),
        "validate_dedupe": lambda s, d: steps.validated(st(s, d)),
        "fallback_steps": lambda s, d: steps.local_steps(local_events(s, d)),
        "audit_runs": lambda s, d: steps.audit_runs(st(s, d)),
        "update_join": q_updates,
        "generated_steps": lambda s, d: review.generated(local_events(s, d), answers(s, d)),
        "budgeted_steps": lambda s, d: review.generated(local_events(s, d), answers(s, d), 9, 3),
        "calls_made": lambda s, d: review.calls_made(local_events(s, d), answers(s, d), 2, 5),
        "audit_flags": lambda s, d: review.audited(audit_rows(s, d)).select("job_id", "step_number", "duration", "weak_candidate", "missing_operation", "long_segment", "coverage_review_required"),
        "verify_updates": q_verified,
        "run_stats": lambda s, d: review.run_stats(R.ordered_events(s, d).select("job_id", F.col("ord").alias("pos"), F.when(F.col("k") % 6 == 0, F.concat(F.lit("timeout "), F.col("k").cast("string"))).alias("error"))),
        "job_status": lambda s, d: jobs.job_state(job_updates(s, d), ["status", "progress", "meta"]).select("id", jobs.status_line(F.col("progress"), F.when(F.col("id") % 2 == 0, "Reading frames"), F.col("status")).alias("line")),
        "job_created": lambda s, d: jobs.created(R.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("updated"), F.lit(0).alias("seq"), F.col("c_name").alias("input_path"), F.when(F.col("c_custkey") % 3 == 0, "{}").alias("meta"))),
        "workflow_family": lambda s, d: cleanup.workflow_family(st(s, d)),
        "phase_sections": lambda s, d: procedure.phase_sections(st(s, d)),
        "chronology": lambda s, d: cleanup.chronology(timed(s, d)),
        "order_repair": lambda s, d: cleanup.in_time(timed(s, d)),
        "review_runs": lambda s, d: cleanup.review_runs(st(s, d)),
        "pair_merge": lambda s, d: cleanup.merged_pairs(st(s, d)),
        "anti_removed": lambda s, d: cleanup.removed(st(s, d), cleanup.step_flags(st(s, d)).where("noise").select("job_id", "step_number")).select("job_id", "step_number", "action"),
        "semantic_counts": lambda s, d: cleanup.semantic_counts(st(s, d)),
        "distinct_states": lambda s, d: cleanup.distinct_states(st(s, d)),
        "quality_report": report.job_reports,
        "clean_steps": lambda s, d: report.cleaned(s, d).select("job_id", "place", "step_number", "action", F.size("sources").alias("n_sources"), "category", "phase", "section"),
        "removal_guards": lambda s, d: procedure.judged(*report.verified(s, d)).select("job_id", "step_number", "removal", "guarded", "category"),
        "removed_steps": lambda s, d: procedure.removed_steps(*report.verified(s, d)),
        "completeness": lambda s, d: (lambda x: procedure.completeness(procedure.clean_steps(*x), x[1]))(report.verified(s, d)),
        "phase_labels": lambda s, d: procedure.phase_labels(R.procedures(s, d)).select("job_id", "step_number", "family", "phase", "corrected"),
        "phase_errors": lambda s, d: R.procedures(s, d).withColumns({"family": F.lit("excel_pivottable"), "phase": R.pick(["Configure PivotTable fields", "Add calculations and formatting", "Create PivotTable"], F.col("step_number"))}).select("job_id", "step_number", procedure.phase_error().alias("error")),
        "segments": segments.job_segments,
        "job_pipeline": job.job_pipeline,
        "segmentation_report": lambda s, d: (lambda f: job.segmentation(f, segments.segments_of(f)))(job.hashed_frames(s, d)),
        "job_state": lambda s, d: jobs.job_state(job_updates(s, d), ["status", "progress", "meta"]).select("id", "status", "progress", "updated", F.coalesce(F.element_at(jobs.meta_of(F.col("meta")), "extraction"), F.lit("")).alias("extraction")),
        "slowest_stage": q_slowest,
        "capabilities": q_capabilities,
        "job_evaluation": lambda s, d: jobs.evaluation(*report.tables(s, d)[2:]),
        "document_paragraphs": q_paragraphs,
        "job_document": lambda s, d: jobs.documents(*report.tables(s, d)[2:]).select("job_id", F.md5("document").alias("document_md5"), F.size(F.split("document", "\n")).alias("n_lines")),
        "pixel_diff": lambda s, d: pixel_pairs(s, d).select("vec_id", F.round(pixels.diff_score(F.col("before"), F.col("after")), 6).alias("diff")),
        "pixel_structure": lambda s, d: pixels.ssim(pixel_pairs(s, d), 8, 8).select("vec_id", F.round("ssim", 5).alias("ssim")),
        "ordering_keys": q_ordering,
        "evidence_pick": lambda s, d: evidence.pick_evidence(segment_frames(s, d), 30),
        "pixel_edges": lambda s, d: pixels.edge_delta(pixel_pairs(s, d), 8, 8).select("vec_id", F.round("edge_delta", 6).alias("edge_delta")),
        "visual_structure": lambda s, d: pixels.structure(images(s, d), 8, 8).select("ord", F.round("structure", 6).alias("structure")),
        "frame_metrics": q_metrics,
        "resized": q_small,
        "role_score": lambda s, d: evidence.role_scores(read_texts(s, d)),
        "ocr_join": q_texts,
        "ocr_stride": lambda s, d: evidence.strided(fr(s, d), 9).select("job_id", "ord"),
        "ambiguous_boundaries": lambda s, d: evidence.ambiguous(boundaries.boundary_candidates(fr(s, d), MAX_SEGMENTS), 4),
        "boundary_merges": q_merges,
        "cluster_events": lambda s, d: evidence.cluster_events(told(s, d), 40),
        "prune_events": lambda s, d: evidence.prune_events(told(s, d), 12),
        "representative_frames": lambda s, d: evidence.representative_frames(stated(s, d).select("job_id", "ord", "time_sec", F.col("visual_score").alias("diff_score"), F.conv(F.concat(F.lit("0"), (F.col("k") * 91193).cast("string")), 10, 16).alias("image_hash")), 20),
        "legacy_phases": lambda s, d: procedure.legacy_phases(R.procedures(s, d)),
        "batches": lambda s, d: jobs.batches(fr(s, d), 9).groupBy("job_id", "batch").agg(F.count(F.lit(1)).alias("n")),
        "cost_estimate": lambda s, d: jobs.cost_estimate(planned_jobs(s, d)),
        "call_budget": lambda s, d: jobs.call_budget(planned_jobs(s, d)),
        "report_totals": lambda s, d: jobs.report_totals(reported(s, d)),
        "phase_table": lambda s, d: jobs.phase_table(report.cleaned(s, d), PHASE_COLUMNS),
        "sketched_thresholds": q_sketched,
        "state_counts": lambda s, d: cleanup.state_counts(by_day(st(s, d)), "day"),
        "profile_default": lambda s, d: jobs.with_profile(R.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "Balanced").when(F.col("c_mktsegment") == "MACHINERY", "none such").alias("profile")), jobs.profiles(s)).select("id", "profile", "max_events", "density"),
        "job_latest": lambda s, d: jobs.latest(job_log(s, d)),
        "job_list": lambda s, d: jobs.newest(job_log(s, d).select(F.col("seq").alias("id"), F.col("updated").alias("created"), "status"), 25),
        "config_precedence": q_config,
        "process_names": lambda s, d: R.table(s, d, "part").select("p_partkey", text.process_name(F.concat(F.lit("/in/"), F.regexp_replace("p_name", " ", "_"), F.lit("_1080p_video.mp4"))).alias("name")),
        "review_categories": lambda s, d: cleanup.review_categories(st(s, d)),
        "state_signatures": lambda s, d: stated(s, d).select("event_id", text.state_signature(F.col("system"), F.col("hash"), F.col("ocr_text")).alias("state"), text.event_signature(F.col("system"), F.col("ocr_text")).alias("event"), F.array_join(text.key_terms(F.col("ocr_text")), ",").alias("terms")),
        "confidence_reasons": lambda s, d: steps.risk_flags(st(s, d)).select("job_id", "step_number", text.confidence_reason(F.col("confidence"), F.col("risky"), F.col("k") / 100, F.col("k") / 500).alias("reason")),
        "parsed_items": said_items,
        "job_table": q_job_table,
        "stream_boundaries": q_stream_boundaries,
        "stream_scroll_collapse": q_stream_scroll,
        "stream_dedupe": q_stream_dedupe,
        "live_activity": lambda s, d: live.activity(R.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_micros("start").alias("start_us"), "user_id", "n", "peak"),
        "live_sessions": lambda s, d: live.sessions(R.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "user_id", "n"),
    }


def profiles_sql() -> str:
    rows = ", ".join(f"({lit(n)}, {', '.join(str(x) for x in v)})" for n, v in rules.PROFILES.items())
    return f"p(profile, {', '.join(rules.PROFILE_FIELDS)}) AS (VALUES {rows})"


def phase_sql() -> str:
    both, out = f"({A} || ' ' || {E})", []
    for name, table in rules.PHASES.items():
        cases = " ".join(f"WHEN {sql_has(both, terms)} THEN {lit(phase)}" for terms, phase in table if terms)
        out.append(f"WHEN family = {lit(name)} THEN CASE {cases} ELSE {lit(table[-1][1])} END")
    return f"CASE {' '.join(out)} END"


FAMILY = f"""{STEPS}, fam AS (SELECT job_id, CASE WHEN bool_or({sql_has("lower(" + BOTH_TEXT + ")", ["pivottable", "pivot table", "pivotchart", "slicer"])}) THEN 'excel_pivottable' WHEN bool_or(system = 'Excel') THEN 'excel'
  WHEN bool_or(system = 'SAP') THEN 'sap' WHEN bool_or(system = 'Browser') THEN 'browser_crud' ELSE 'generic' END AS family FROM steps GROUP BY 1)"""


def states_sql() -> str:
    """Leader clustering, one row after another with the leaders found so far."""
    fit = """s.system = q.system AND NOT (s.blank AND q.blank AND q.system = 'Other' AND q.bs > 0.02) AND (bit_count(xor(s.hash, q.hash)) <= 8
      OR CASE WHEN len(s.tok) = 0 OR len(q.tok) = 0 THEN 0.0 ELSE len(list_intersect(s.tok, q.tok)) / len(list_distinct(list_concat(s.tok, q.tok))) END > 0.72)"""
    return f"""WITH RECURSIVE {SCREENS}, st AS (SELECT job_id, ord, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS system, (k % 5 * 1023)::BIGINT AS hash, {sql_tokens("ocr_text")} AS tok, trim(ocr_text) = '' AS blank, boundary_score AS bs FROM screens),
    f AS (SELECT job_id, 0::BIGINT AS i, 0 AS num, []::STRUCT(system VARCHAR, hash BIGINT, tok VARCHAR[], blank BOOLEAN)[] AS leaders FROM (SELECT DISTINCT job_id FROM st)
      UNION ALL SELECT job_id, i + 1, CASE WHEN pos > 0 THEN pos ELSE len(leaders) + 1 END::INT, CASE WHEN pos > 0 THEN leaders ELSE list_append(leaders, {{'system': system, 'hash': hash, 'tok': tok, 'blank': blank}}) END
      FROM (SELECT f.job_id, f.i, f.leaders, q.system, q.hash, q.tok, q.blank, coalesce(list_position(list_transform(f.leaders, lambda s: {fit}), true), 0) AS pos FROM f JOIN st q ON q.job_id = f.job_id AND q.ord = f.i))
    SELECT job_id, i - 1 AS ord, num AS screen_state_id FROM f WHERE i > 0"""


def scroll_sql() -> str:
    """Scroll collapse, one row after another with the rows kept so far."""
    seen = sql_tokens("l.text")
    still = f"{sql_jaccard('q.tok', seen, 1.0)} > 0.70 AND q.bs < 0.12 AND NOT {sql_has('lower(q.text || chr(32) || l.text)', rules.OPERATIONAL_TERMS)}"
    row = lambda o, b, t, n, c: f"{{'ord': {o}, 'start': {b}, 'fin': q.time_sec, 'system': q.system, 'state': q.state, 'text': {t}, 'n': {n}, 'score': {c}}}"
    longer = "CASE WHEN length(q.text) > length(l.text) THEN q.text ELSE l.text END"
    return f"""WITH RECURSIVE {SCREENS}, st AS (SELECT job_id, ord, time_sec, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS system, (k % 3)::INT AS state, ocr_text AS text, visual_score AS vs, boundary_score AS bs, {sql_tokens("ocr_text")} AS tok FROM screens),
    f AS (SELECT job_id, 0::BIGINT AS i, []::STRUCT(ord BIGINT, "start" DOUBLE, fin DOUBLE, system VARCHAR, state INT, text VARCHAR, n INT, score DOUBLE)[] AS kept FROM (SELECT DISTINCT job_id FROM st)
      UNION ALL SELECT q.job_id, q.i + 1, CASE WHEN coalesce(len(kept) > 0 AND l.system = q.system AND l.state = q.state AND q.vs < 0.01 AND CASE WHEN trim(q.text) <> '' AND trim(l.text) <> '' THEN {still} ELSE true END, false)
        THEN list_append(kept[:-2], {row("l.ord", "l.start", longer, "l.n + 1", "l.score")}) ELSE list_append(kept, {row("q.ord", "q.time_sec", "q.text", "1", "q.bs")}) END
      FROM (SELECT f.i, f.kept, f.kept[-1] AS l, q.* FROM f JOIN st q ON q.job_id = f.job_id AND q.ord = f.i) q),
    done AS (SELECT job_id, unnest(range(1, len(kept) + 1)) AS event_id, kept FROM (SELECT job_id, arg_max(kept, i) AS kept FROM f GROUP BY 1))
    SELECT job_id, event_id::INT AS event_id, x.ord AS ord, x.start AS start_time, x.fin AS end_time, x.n AS frame_count, x.text AS ocr_text, x.system AS system, x.state AS screen_state_id, x.score AS boundary_score FROM (SELECT job_id, event_id, kept[event_id] AS x FROM done)"""


def validate_sql(repair: str, in_place: bool = False) -> str:
    """With ``in_place``, by the times of events. Adjacent repeats dropped, one step after another with the last one kept; at most 40 stay."""
    norm = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\pL\\pN_]+', ' ', 'g'))"
    vague = ["review the visible process screen the relevant process information is available on screen", "review the visible process screen the expected screen is displayed"]
    steps = STEPS.replace("CASE WHEN k % 17 = 0 THEN greatest(0.0, time_sec - 50) ELSE time_sec END", "time_sec") if in_place else STEPS
    return f"""WITH RECURSIVE {steps}, fixed AS ({repair}), r AS (SELECT row_number() OVER (PARTITION BY job_id ORDER BY step_number) AS i, job_id, step_number, time_sec, screen_state_id AS state,
      f.system || '|' || {norm("f.action")} || '|' || {norm("trim(expected_output)")} AS key, {norm("f.action")} || ' ' || {norm("trim(expected_output)")} IN ({", ".join(map(lit, vague))}) AS vague
      FROM fixed f JOIN (SELECT job_id, step_number, time_sec, screen_state_id, expected_output FROM steps) USING (job_id, step_number)),
    f AS (SELECT job_id, 0::BIGINT AS i, 0 AS n, false AS kept, NULL::BIGINT AS number, NULL::DOUBLE AS tm, NULL::VARCHAR AS key, NULL::INT AS state FROM (SELECT DISTINCT job_id FROM r)
      UNION ALL SELECT job_id, i + 1, n + keep::INT, keep, CASE WHEN keep THEN q_number ELSE number END, CASE WHEN keep THEN q_at ELSE tm END, CASE WHEN keep THEN q_key ELSE key END, CASE WHEN keep THEN q_state ELSE state END
      FROM (SELECT f.*, q.step_number AS q_number, q.time_sec AS q_at, q.key AS q_key, q.state::INT AS q_state,
        n < 40 AND NOT coalesce(n > 0 AND q.key = f.key AND q.state = f.state AND (q.vague OR abs(q.step_number - f.number) <= 1 OR abs(q.time_sec - f.tm) <= 12), false) AS keep FROM f JOIN r q ON q.job_id = f.job_id AND q.i = f.i + 1))
    SELECT job_id, n AS step_number, number AS source_number FROM f WHERE kept"""


def audit_sql() -> str:
    """Flags of the local writer's steps, in the relations of ``fallback_sql``."""
    generic = GENERIC
    low, clean = "lower(coalesce(ocr_text, ''))", lambda x: f"trim(regexp_replace(lower({x}), '[^\\pL\\pN_]+', ' ', 'g'))"
    return f"""WITH own AS ({fallback_sql()}), seen AS (WITH {SCREENS} SELECT job_id, ord + 1 AS event_id, k, ocr_text, boundary_score, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS system, {sql_class("ocr_text", rules.HINTS, "review")} AS hint,
      CASE WHEN k % 4 > 0 THEN k % 4 END AS state FROM screens), b AS (SELECT *, {generic} AS generic, {clean("system || ' ' || action || ' ' || expected_output")} AS sig FROM own JOIN seen USING (job_id, event_id)),
    n AS (SELECT *, (sig IS DISTINCT FROM lag(sig) OVER w)::INT AS s, (state IS DISTINCT FROM lag(state) OVER w) OR (state IS DISTINCT FROM lead(state) OVER w) AS alone FROM b WINDOW w AS (PARTITION BY job_id ORDER BY event_id)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY job_id ORDER BY event_id) AS run FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY job_id, run ORDER BY event_id) AS nth FROM g),
    f AS (SELECT job_id, event_id AS step_number, CASE WHEN k % 13 > 0 THEN (k % 50)::DOUBLE ELSE 0.0 END AS duration, generic AND nth >= 2 AS weak_candidate, generic AND alone AS apart,
      generic AND system = 'Excel' AND (hint IN ({", ".join(map(lit, review.OPERATION_HINTS))}) OR boundary_score >= {review.OPERATION_SCORE} OR {sql_has(low, review.OPERATION_TERMS + review.PIVOT_TERMS)}) AS missing_operation FROM p)
    SELECT job_id, step_number, duration, weak_candidate, missing_operation, duration > {review.LONG_SECONDS} AS long_segment, weak_candidate OR apart OR missing_operation OR duration > {review.LONG_SECONDS} AS coverage_review_required FROM f"""


def fallback_sql() -> str:
    t, has = "lower(coalesce(clean_text, ''))", lambda *x: sql_has("lower(coalesce(clean_text, ''))", list(x))
    conds = [
        f"{has('validate exported')} OR ({has('exported file')} AND {has('ready', 'appears')})", f"action_hint = 'export' OR {has('export', 'download')}", f"{has('submit')} AND {has('confirmation', 'saved')}",
        f"{has('update')} AND {has('field', 'terms', 'priority', 'status', 'owner')}", f"action_hint = 'filter' OR {has('filter')}", "action_hint = 'data entry'", f"action_hint = 'post/save' OR {has('save', 'post')}",
        has("invoice", "supplier", "vendor"), f"system = 'Excel' AND {has('pivot', 'field', 'measure')}", "system = 'Excel'", "system = 'SAP'", "action_hint = 'navigation'",
    ]
    case = lambda i: " ".join(f"WHEN {c} THEN {lit(name if i is None else steps.FALLBACK[name][i])}" for c, name in zip(conds, steps.FALLBACK, strict=True))
    return f"""WITH {SCREENS}, e AS (SELECT job_id, ord + 1 AS event_id, ocr_text AS clean_text, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS system, {sql_class("ocr_text", rules.HINTS, "review")} AS action_hint, CASE WHEN k % 4 > 0 THEN k % 4 END AS screen_state_id FROM screens)
    SELECT job_id, event_id, CASE {case(None)} WHEN screen_state_id IS NOT NULL THEN 'state' ELSE 'default' END AS rule,
      CASE {case(0)} WHEN screen_state_id IS NOT NULL THEN 'Review the process state shown at event ' || event_id || '.' ELSE 'Review the visible process screen for event ' || event_id || '.' END AS action,
      CASE {case(1)} WHEN screen_state_id IS NOT NULL THEN 'Screen state ' || screen_state_id || ' is visible for the next workflow action.' ELSE 'The relevant process information is available for chronological review.' END AS expected_output,
      CASE WHEN clean_text = '' THEN 'low' ELSE 'medium' END AS confidence, CASE WHEN trim(clean_text) = '' THEN 'diagnostic_fallback' ELSE 'local_ocr' END AS generation_source FROM e"""


def sql_holds(conditions: list, columns: dict[str, str]) -> str:
    return " AND ".join(("" if op == "has" else "NOT ") + sql_has(columns[c], terms) for c, op, terms in conditions)


def sql_first(table: list, columns: dict[str, str], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {sql_holds(conditions, columns)} THEN {lit(name)}" for name, conditions in table) + f" ELSE {default} END"


def sql_dup(x: str, y: str) -> str:
    """Whether two described rows (structs x and y) are one step."""
    canned = lambda a, b: f"((contains({x}.body, {lit(a)}) AND contains({y}.body, {lit(b)})) OR (contains({x}.body, {lit(b)}) AND contains({y}.body, {lit(a)})))"
    both = lambda c: f"len({x}.{c}) > 0 AND len({y}.{c}) > 0"
    alike = lambda c: f"({sql_jaccard(f'{x}.{c}', f'{y}.{c}', 1.0)})"
    return f"""({x}.system = {y}.system AND NOT (({x}.pivot OR {y}.pivot) AND {both("fields")} AND {x}.fields <> {y}.fields) AND (abs({y}.step_number - {x}.step_number) <= 2 OR abs({y}.begins - {x}.ends) <= 45)
      AND NOT ({both("targets")} AND NOT list_has_any({x}.targets, {y}.targets)) AND NOT ({both("details")} AND {x}.details <> {y}.details)
      AND ({canned(*cleanup.SAME_INTENT[0])} OR NOT ({both("roots")} AND {x}.roots <> {y}.roots AND {alike("aw")} < 0.72))
      AND ({canned(*cleanup.SAME_INTENT[0])} OR {canned(*cleanup.SAME_INTENT[1])} OR {alike("w")} > 0.72 OR ({alike("ew")} > 0.45 AND {alike("w")} > 0.55)))"""


def sql_me(*more: str, ends: str = "time_sec") -> str:
    """A struct of what pairs are compared by, and further columns."""
    terms = lambda x, of: f"list_sort(list_distinct(list_filter({x}, lambda t: list_contains([{', '.join(map(lit, of))}], t))))"
    words = sql_content(BOTH_TEXT)
    details = f"list_sort(list_distinct(list_filter({words}, lambda t: list_contains([{', '.join(map(lit, rules.DETAIL_TERMS))}], t) OR regexp_matches(t, '^[0-9]+$'))))"
    fields = f"list_filter([{', '.join(map(lit, rules.FIELD_TERMS))}], lambda t: contains({A}, t))"
    parts = {"step_number": "step_number", "begins": "coalesce(time_sec, 0.0)", "ends": f"coalesce({ends}, 0.0)", "system": "system", "body": BOTH, "pivot": f"contains({A}, 'pivottable')", "fields": fields, "w": words, "aw": sql_content("action"), "ew": sql_content("expected_output"),
             "targets": terms(words, rules.DOMAIN_TERMS), "details": details, "roots": terms(sql_roots("action"), rules.VERBS)}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in (parts | {m: m for m in more}).items()) + "}"


SCORE = f"len({sql_content(BOTH_TEXT)}) + 8 * meaningful::INT - 5 * passive::INT + 4 * checkpoint::INT"
SETUP = " AND ".join(f"contains({r}.body, {lit(t)})" for r, t in zip(("me", "nxt"), cleanup.SAME_INTENT[0], strict=True))
PAIRS = f"""{FLAGS}, d AS (SELECT job_id, {sql_me("score")} AS me FROM (SELECT *, {SCORE} AS score FROM flags)), l AS (SELECT job_id, me, lead(me) OVER (PARTITION BY job_id ORDER BY me.step_number) AS nxt FROM d),
e AS (SELECT *, coalesce({sql_dup("me", "nxt")}, false) AS edge FROM l), r AS (SELECT *, sum((NOT edge)::INT) OVER (PARTITION BY job_id ORDER BY me.step_number) AS run FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY job_id, run, edge ORDER BY me.step_number) AS nth FROM r)"""

# Whole procedures in SQL.
RAW = f"""{EV}, vocab(i, rule_system, action, expected_output, confidence) AS (VALUES {duck_rows([*R.STEPS, *R.PIVOT_STEPS])}),
raw AS (SELECT *, time_sec + duration AS end_time FROM (SELECT job_id, ord + 1 AS step_number, CASE WHEN k % 13 > 0 THEN round(CASE WHEN k % 17 = 0 THEN greatest(0.0, time_sec - 50) ELSE time_sec END, 6) END AS time_sec, k, rule_system, rule_system AS system, action, expected_output, confidence, (k % 47)::DOUBLE AS duration,
  CASE WHEN k % 9 = 0 THEN 'Slicer settings' WHEN k % 10 = 0 THEN 'Percentage of total' WHEN k % 11 = 0 THEN 'PivotChart fields' END AS ocr_text, CASE WHEN k % 3 > 0 THEN ord + 1 END AS source_event_index,
  CASE WHEN k % 29 = 0 THEN 'diagnostic_fallback' WHEN job_id % 5 = 0 THEN 'local_ocr' ELSE 'openai_vision' END AS generation_source FROM ev JOIN vocab ON i = CASE WHEN job_id % 2 = 0 THEN k % {len(R.STEPS)} ELSE {len(R.STEPS)} + k % {len(R.PIVOT_STEPS)} END)),
info AS (SELECT job_id, CASE WHEN job_id % 4 = 0 THEN n * 2 WHEN job_id % 4 = 1 THEN 0 ELSE n END AS n_events, CASE WHEN job_id % 7 = 0 THEN 'short training clip' ELSE '' END AS justification,
  CASE WHEN job_id % 3 = 0 THEN 'production_vision' WHEN job_id % 3 = 1 THEN 'local_ocr_draft' ELSE 'diagnostic_only' END AS mode, job_id % 3 = 0 AS model_ready, CASE WHEN job_id % 3 = 0 THEN 3 ELSE 0 END AS calls,
  CASE WHEN job_id % 6 = 0 THEN 2 ELSE 0 END AS succeeded, CASE WHEN job_id % 2 = 0 THEN 5 ELSE 0 END AS ocr_count, duration AS length FROM (SELECT job_id, count(*) AS n, max(time_sec) AS duration FROM raw GROUP BY 1))"""
KEY = "{'kind': CASE WHEN time_sec IS NOT NULL THEN 0 WHEN source_event_index IS NOT NULL THEN 1 ELSE 2 END, 'value': coalesce(time_sec, source_event_index, step_number)::DOUBLE}"
TIMED = f"{STEPS}, t0 AS (SELECT job_id, step_number, CASE WHEN k % 7 > 0 THEN time_sec END AS time_sec, CASE WHEN k % 2 = 0 THEN step_number END AS source_event_index FROM steps), timed AS (SELECT *, {KEY} AS order_key FROM t0)"
LEAST = "CASE WHEN n_events >= 35 THEN 24 WHEN n_events >= 30 THEN 22 WHEN n_events >= 25 THEN 18 ELSE 0 END"
SAID = {"action": A, "expected": E, "text": BOTH, "phase": "phase"}


def family_sql() -> str:
    any_of = lambda cond: f"bool_or({cond}) OVER (PARTITION BY job_id)"
    pivot = sql_has(f"lower({BOTH_TEXT})", ["pivottable", "pivot table", "pivotchart", "slicer"])
    rest = " ".join(f"WHEN {any_of(f'system = {lit(s)}')} THEN {lit(f)}" for s, f in (("Excel", "excel"), ("SAP", "sap"), ("Browser", "browser_crud")))
    return f"CASE WHEN {any_of(pivot)} THEN 'excel_pivottable' {rest} ELSE 'generic' END"


def safe_sql() -> str:
    safe = lambda x: f"CASE WHEN risky THEN {REDACT.format(x=x)} ELSE {x} END AS {x}"
    return f"""{RAW}, fixed AS (SELECT * REPLACE (trim(action) AS action) FROM raw WHERE trim(action) <> '' AND NOT regexp_matches(lower(trim(action)), {lit(rules.TOOLBAR)})),
    safe AS (SELECT * REPLACE ({safe("action")[: -len(" AS action")]} AS action, {safe("expected_output")[: -len(" AS expected_output")]} AS expected_output, CASE WHEN risky AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence) FROM (SELECT *, {RISKY} AS risky FROM fixed))"""


def phases_sql(rows: str) -> str:
    """Rows with family, phase, corrected and phase_error as the relation ``phased``."""
    base = f"CASE WHEN family = 'excel_pivottable' THEN {sql_first(rules.PIVOT_PHASES, SAID, lit(rules.PIVOT_DEFAULT))} ELSE {phase_sql()} END"
    return f"""based AS (SELECT *, {base} AS base FROM (SELECT *, {family_sql()} AS family FROM {rows})),
    phased AS (SELECT *, phase <> base AS corrected, CASE WHEN family = 'excel_pivottable' THEN {sql_first(rules.PHASE_ERRORS, SAID)} END AS phase_error
      FROM (SELECT *, coalesce(CASE WHEN family = 'excel_pivottable' THEN {sql_first(rules.PIVOT_OVERRIDES, SAID)} END, base) AS phase FROM based))"""


def judged_sql() -> str:
    has = lambda terms: sql_has("body", terms)
    return f"""{safe_sql()}, flags AS (SELECT *, {BOTH} AS body, {MEANINGFUL} AS meaningful, {CHECKPOINT} AS checkpoint, {NOISE} AS noise, {PASSIVE} AS passive, {REVIEW} AS review, {family_sql()} AS family, {KEY} AS order_key FROM safe JOIN info USING (job_id)),
    near AS (SELECT *, coalesce(lag(meaningful) OVER w, false) AS before_it, coalesce(lead(meaningful) OVER w, false) AS after_it, family LIKE 'excel%' AS xl, {has(cleanup.REVIEW_OBJECTS)} AS about, {has(cleanup.OUTPUTS)} AS shows, {has(cleanup.FILLER)} AS filler
      FROM flags WINDOW w AS (PARTITION BY job_id ORDER BY order_key, step_number)),
    cat AS (SELECT *, CASE WHEN NOT (review OR passive OR checkpoint) THEN NULL WHEN checkpoint THEN 'operational_checkpoint' WHEN xl AND filler THEN 'passive_filler' WHEN (about OR (xl AND shows)) AND before_it THEN 'operational_checkpoint'
      WHEN (about OR (xl AND shows)) AND after_it THEN 'contextual_review' ELSE 'passive_filler' END AS c FROM near),
    going AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n_before, count_if(noise OR coalesce(c = 'passive_filler', false)) OVER (PARTITION BY job_id) AS out FROM cat),
    guard AS (SELECT *, (n_events > 0 AND n_before < {LEAST}) OR (n_events >= 25 AND (n_before - out) / n_events < 0.6) OR (out / n_before > 0.4 AND n_before >= 5) AS guarded FROM going),
    judged AS (SELECT *, CASE WHEN noise THEN 'noise' WHEN NOT guarded AND c = 'passive_filler' THEN 'filler' END AS removal,
      CASE WHEN NOT guarded OR c IS NULL THEN c WHEN checkpoint THEN 'operational_checkpoint' ELSE 'passive_filler' END AS category FROM guard)"""


def clean_sql() -> str:
    more = "score action expected_output confidence duration generation_source noise meaningful passive checkpoint review category n_events n_before order_key time_sec end_time ocr_text source_event_index".split()
    at = "(PARTITION BY job_id ORDER BY me.order_key, me.step_number)"
    return f"""{judged_sql()}, d AS (SELECT job_id, {sql_me(*more, ends="coalesce(end_time, time_sec)")} AS me FROM (SELECT *, {SCORE} AS score FROM judged WHERE removal IS NULL)), l AS (SELECT job_id, me, lead(me) OVER {at} AS nxt FROM d),
    e AS (SELECT *, coalesce({sql_dup("me", "nxt")}, false) AS edge FROM l), r AS (SELECT *, sum((NOT edge)::INT) OVER {at} AS run FROM e),
    p AS (SELECT *, edge AND row_number() OVER (PARTITION BY job_id, run, edge ORDER BY me.order_key, me.step_number) % 2 = 1 AS first FROM r),
    u AS (SELECT *, coalesce(lag(first) OVER {at}, false) AS second, count(*) OVER (PARTITION BY job_id) AS n, count_if(first) OVER (PARTITION BY job_id) AS pairs, {LEAST.replace("n_events", "me.n_events")} AS least_n FROM p),
    v AS (SELECT *, least_n > 0 AND n - pairs < least_n AND least_n <= n AS undo FROM u),
    m AS (SELECT job_id, CASE WHEN first AND NOT undo AND (({SETUP}) OR nxt.score > me.score) THEN nxt ELSE me END AS x, first AND NOT undo AS pair, CASE WHEN first AND NOT undo AND {SETUP} THEN {lit(procedure.SETUP_WORDING)} END AS said,
      CASE WHEN first AND NOT undo AND {SETUP} THEN coalesce(nullif(nxt.expected_output, ''), nullif(me.expected_output, ''), {lit(procedure.SETUP_RESULT)}) END AS shown FROM v WHERE undo OR NOT second),
    rows AS (SELECT job_id, pair, x.step_number AS step_number, x.system AS system, coalesce(said, x.action) AS action, coalesce(shown, x.expected_output) AS expected_output, {", ".join(f"x.{c} AS {c}" for c in more if c not in ("action", "expected_output"))} FROM m),
    placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY order_key, step_number) AS place FROM rows), {phases_sql("placed")}"""


def report_sql() -> str:
    """The relations ``counts`` (one row per job) and before them all that leads there."""
    missing = []
    for name, evidence, acted, asked, phrases in rules.EXPECTED_ACTIONS:
        any_of = lambda x, terms: sql_has(f"string_agg({x}, ' ' ORDER BY place)", terms if isinstance(terms, list) else [terms])
        done = any_of("a", phrases) if asked else f"({any_of('a', [acted])} AND {any_of('a', phrases)})"
        asks = f"({any_of('b', evidence)} AND {any_of('a', [acted]) if asked else 'true'})"
        missing.append(f"CASE WHEN any_value(family) = 'excel_pivottable' AND {asks} AND NOT {done} THEN {lit(name)} END")
    return f"""{clean_sql()}, w1 AS (SELECT *, {A} AS a, {sql_norm("coalesce(action, '') || ' ' || coalesce(expected_output, '') || ' ' || coalesce(ocr_text, '')")} AS b, {sql_me(ends="coalesce(end_time, time_sec)")} AS me, coalesce(category IN ('contextual_review', 'passive_filler'), false) OR (review AND NOT meaningful) AS in_review,
      CASE WHEN meaningful THEN source_event_index - last_value(CASE WHEN meaningful THEN source_event_index END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM phased),
    w2 AS (SELECT *, sum((NOT in_review)::INT) OVER (PARTITION BY job_id ORDER BY place) AS rv, lead(me) OVER (PARTITION BY job_id ORDER BY place) AS nxt FROM w1),
    w3 AS (SELECT *, coalesce({sql_dup("me", "nxt")}, false) AS twice, CASE WHEN in_review THEN count_if(in_review) OVER (PARTITION BY job_id, rv ORDER BY place) END AS run_at FROM w2),
    counts AS (SELECT job_id, count(*) AS steps, any_value(n_before) AS before, count_if(noise) AS noise, count_if(passive OR coalesce(category = 'contextual_review', false)) AS passive, count_if(twice) AS duplicates, count_if(pair) AS merged,
      count_if(confidence <> 'high') AS low, count_if(generation_source = 'diagnostic_fallback') AS diagnostic, count_if((review AND NOT meaningful) OR starts_with(a, 'review the process state shown')) AS generic, count_if(meaningful) AS operational,
      count_if(category = 'contextual_review') AS contextual, count_if(category = 'operational_checkpoint') AS checkpoints, count_if(coalesce(run_at = 2, false)) AS review_runs, coalesce(max(gap), 0) AS widest_gap, count_if(duration > 45) AS long,
      count_if(corrected) AS corrections, count(phase_error) AS phase_errors, count_if(phase IN ({", ".join(map(lit, rules.GENERIC_PHASES))})) AS generic_phases, count(DISTINCT phase) AS phases, concat_ws(',', {", ".join(missing)}) AS missing FROM w3 GROUP BY 1)"""


def canny_sql(px: str) -> str:
    """Edges of 8 by 8 images by pixel numbers, as the relations ``p`` (images) and ``edge``."""
    at = lambda i, j: f"x[greatest(0, least(7, i // 8 + {i})) * 8 + greatest(0, least(7, i % 8 + {j})) + 1]"
    beside = lambda i, j: f"CASE WHEN i // 8 + {i} BETWEEN 0 AND 7 AND i % 8 + {j} BETWEEN 0 AND 7 THEN s[(i // 8 + {i}) * 8 + i % 8 + {j} + 1] ELSE 0 END"
    gx = f"{at(-1, 1)} + 2 * {at(0, 1)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(0, -1)} - {at(1, -1)}"
    gy = f"{at(1, -1)} + 2 * {at(1, 0)} + {at(1, 1)} - {at(-1, -1)} - 2 * {at(-1, 0)} - {at(-1, 1)}"
    return f"""WITH RECURSIVE p AS (SELECT vec_id, {px} AS x FROM embeddings), g AS (SELECT vec_id, list_transform(range(0, 64), lambda i: {gx}) AS gx, list_transform(range(0, 64), lambda i: {gy}) AS gy FROM p),
    s AS (SELECT *, list_transform(range(1, 65), lambda i: abs(gx[i]) + abs(gy[i])) AS s FROM g), c AS (SELECT vec_id, i, gx[i + 1]::BIGINT AS dx, gy[i + 1]::BIGINT AS dy, s[i + 1] AS m, s FROM (SELECT *, unnest(range(0, 64)) AS i FROM s)),
    thin AS (SELECT vec_id, i, m FROM c WHERE m > {pixels.LOW} AND CASE WHEN abs(dy) * 32768 < abs(dx) * {pixels.TAN} THEN m > {beside(0, -1)} AND m >= {beside(0, 1)}
      WHEN abs(dy) * 32768 > abs(dx) * ({pixels.TAN} + 65536) THEN m > {beside(-1, 0)} AND m >= {beside(1, 0)} WHEN xor(dx, dy) < 0 THEN m > {beside(-1, 1)} AND m > {beside(1, -1)} ELSE m > {beside(-1, -1)} AND m > {beside(1, 1)} END),
    edge AS (SELECT vec_id, i FROM thin WHERE m > {pixels.HIGH} UNION SELECT t.vec_id, t.i FROM edge e JOIN thin t ON t.vec_id = e.vec_id AND abs(t.i // 8 - e.i // 8) <= 1 AND abs(t.i % 8 - e.i % 8) <= 1)"""


def fold_sql(rows: str, kind: str, step: str) -> str:
    """A fold over the rows of each job by ``i`` from 1; ``kept`` is the list so far. Gives ``got`` (job_id, x)."""
    return f"""f AS (SELECT job_id, 0 AS i, []::{kind}[] AS kept FROM (SELECT DISTINCT job_id FROM {rows}) UNION ALL SELECT f.job_id, q.i, {step} FROM f JOIN {rows} q ON q.job_id = f.job_id AND q.i = f.i + 1),
    got AS (SELECT job_id, unnest(arg_max(kept, i)) AS x FROM f GROUP BY job_id)"""


TOLD = f"{SCREENS}, told AS (SELECT job_id, ord, time_sec, {sql_class('ocr_text', rules.SYSTEMS, 'Other')} AS system, ocr_text AS text, visual_score AS diff_score, {sql_tokens('ocr_text')} AS tok, k FROM screens)"
READ = f"{FRAMES}, texts(i, t) AS (VALUES {duck_rows(R.TEXTS)}), read AS (SELECT job_id, ord AS segment, pos, role, t AS text, (k * 7 + pos * 13) % 10 / 10 AS structure FROM frames, (VALUES (0, 'stable_frame'), (1, 'entry_frame'), (2, 'after_frame')) r(pos, role), texts WHERE k % 8 <> 5 AND i = (k + 5 * pos) % {len(R.TEXTS)})"
FRAMED = "coalesce(lag(time_sec) OVER w, time_sec) AS start_time, coalesce(lead(time_sec) OVER w, time_sec) AS end_time, row_number() OVER w AS event_id"


def evidence_sql() -> dict[str, str]:
    jac = f"({sql_jaccard('q.tok', 'kept[-1].tok', 0.0)})"
    entry = "{'ord': q.ord, 'time_sec': q.time_sec, 'system': q.system, 'text': q.text, 'diff_score': q.diff_score, 'tok': q.tok}"
    like = f"len(kept) > 0 AND q.system = kept[-1].system AND ({jac} > 0.82 OR (q.diff_score < 0.025 AND q.text = ''))"
    cluster = f"CASE WHEN {like} THEN CASE WHEN length(q.text) > length(kept[-1].text) THEN list_append(kept[:-2], {entry}) ELSE kept END ELSE list_append(kept, {entry}) END"
    event = "STRUCT(ord BIGINT, time_sec DOUBLE, system VARCHAR, text VARCHAR, diff_score DOUBLE, tok VARCHAR[])"
    terms = " + ".join(f"contains(lower(text), {lit(t)})::INT" for t in rules.BUSINESS_TERMS)
    score = "round(q.terms + least(4.0, q.diff_score * 60) + (q.system <> 'Other')::INT + least(3.0, length(q.text) / 180) + CASE WHEN len(kept) > 0 AND q.system <> kept[-1].system THEN 2.0 ELSE 0.0 END + CASE WHEN q.hint IN ('filter', 'export', 'data entry', 'post/save') THEN 1.5 ELSE 0.0 END, 6)"
    scored = "{'ord': q.ord, 'time_sec': q.time_sec, 'system': q.system, 'text': q.text, 'tok': q.tok, 'ends': q.ends, 'n_ends': q.n_ends, 'score': " + score + "}"
    prune = f"CASE WHEN len(kept) > 0 AND q.diff_score < 0.018 AND {jac} > 0.7 AND q.system = kept[-1].system THEN kept ELSE list_append(kept, {scored}) END"
    frame = lambda n: f"CASE WHEN ({n}) % 10 <> 3 THEN 'f' || ({n}) END"
    pick = "CASE WHEN len(list_filter(kept, lambda e: e.path = q.path)) > 0 OR (q.score < 0.02 AND NOT q.forced AND len(list_filter(kept, lambda e: bit_count(xor(e.h, q.h)) <= 2)) > 0) OR len(kept) >= 30 THEN kept ELSE list_append(kept, {'segment': q.segment, 'role': q.role, 'path': q.path, 'h': q.h}) END"
    clash = "len(list_filter(kept, lambda e: e.ord = q.ord OR (NOT q.force AND (abs(e.time_sec - q.time_sec) < q.wide OR bit_count(xor(e.h, q.h)) <= 4)))) > 0"
    spread = f"CASE WHEN {clash} OR len(kept) >= 20 THEN kept ELSE list_append(kept, {{'ord': q.ord, 'time_sec': q.time_sec, 'h': q.h, 'reason': q.reason}}) END"
    hint = sql_class("text", rules.HINTS, "review")
    return {
        "evidence_pick": f"""WITH RECURSIVE {FRAMES}, s AS (SELECT job_id, ord AS segment, (k % 5 * 1023)::BIGINT AS h, round(boundary_score / 10, 6) AS score, k % 9 = 0 AS forced, unnest([{{'go': 1, 'at': 0, 'role': 'stable_frame', 'path': {frame("ord")}}},
            {{'go': 2, 'at': 1, 'role': 'entry_frame', 'path': {frame("ord - k % 2")}}}, {{'go': 2, 'at': 2, 'role': 'after_frame', 'path': {frame("ord + 1")}}}]) AS x FROM frames),
            o AS (SELECT job_id, segment, h, score, forced, x.role AS role, x.path AS path, row_number() OVER (PARTITION BY job_id ORDER BY x.go, segment, x.at) AS i FROM s WHERE x.path IS NOT NULL),
            {fold_sql("o", "STRUCT(segment BIGINT, role VARCHAR, path VARCHAR, h BIGINT)", pick)}, b AS (SELECT job_id, generate_subscripts(kept, 1) AS event_id, unnest(kept) AS x FROM (SELECT job_id, arg_max(kept, i) AS kept FROM f GROUP BY 1))
            SELECT job_id, event_id, x.segment AS segment, x.role AS role, x.path AS path FROM b""",
        "role_score": f"""WITH {READ}, m AS (SELECT *, CASE WHEN len({sql_tokens("text")}) = 0 THEN 0.0 ELSE least(1.0, 0.55 * least(1.0, len({sql_tokens("text")}) / 18) + 0.45 * least(1.0, length(trim(text)) / 180)) END AS s,
            CASE WHEN role = 'stable_frame' THEN 0.03 ELSE 0.08 END + CASE WHEN {sql_has("lower(text)", rules.DIALOG_TERMS)} THEN 0.12 ELSE 0.0 END AS bonus FROM read),
            n AS (SELECT *, round(CASE WHEN s = 0 THEN 0.7 * structure ELSE 0.6 * s + 0.3 * structure END + bonus, 9) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY job_id, segment ORDER BY score DESC, pos) AS nth FROM n)
            SELECT job_id, segment, role, round(score, 6) AS score, round(s, 3) AS strength, round(structure, 3) AS structure,
              role || ' ' || CASE WHEN s > 0 THEN {lit(evidence.REASONS[0])} WHEN {sql_has("lower(text)", rules.DIALOG_TERMS)} THEN {lit(evidence.REASONS[1])} ELSE {lit(evidence.REASONS[2])} END AS reason FROM r WHERE nth = 1""",
        "ocr_join": f"WITH {READ} SELECT frames.job_id, frames.ord AS segment, count(role)::INT AS n, coalesce(max(text) FILTER (WHERE role = 'entry_frame'), '') AS entry_text FROM frames LEFT JOIN read ON read.job_id = frames.job_id AND read.segment = frames.ord GROUP BY 1, 2",
        "ocr_stride": f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM frames) SELECT job_id, ord FROM n WHERE n <= 9 OR (ord % greatest(1, n // 9) = 0 AND ord < n // 9 * 8) OR ord = n - 1",
        "ambiguous_boundaries": f"WITH RECURSIVE {QUALIFIED}, r AS (SELECT job_id, ord, round(abs(boundary_score - 0.16), 6) AS distance FROM cand) SELECT job_id, ord, distance FROM r QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY distance, ord) <= 4",
        "boundary_merges": f"""WITH RECURSIVE {SPANS}, g AS (SELECT *, sum((segment = 1 OR (start_ord + segment) % 3 <> 0)::INT) OVER (PARTITION BY job_id ORDER BY segment) AS event_id FROM spans)
            SELECT job_id, event_id, min(start_ord) AS start_ord, max(end_ord) AS end_ord, min(start_time) AS start_time, max(end_time) AS end_time, sum(frame_count) AS frame_count, count(*) - 1 AS merged FROM g GROUP BY 1, 2""",
        "cluster_events": f"""WITH RECURSIVE {TOLD}, o AS (SELECT *, ord + 1 AS i FROM told), {fold_sql("o", event, cluster)},
            c AS (SELECT job_id, x.ord AS ord, x.time_sec AS time_sec, x.system AS system, x.text AS text, x.diff_score AS diff_score FROM got),
            k AS (SELECT * FROM c WINDOW p AS (PARTITION BY job_id) QUALIFY count(*) OVER p <= 40 OR ord = min(ord) OVER p OR ord = max(ord) OVER p OR row_number() OVER (PARTITION BY job_id ORDER BY diff_score DESC, ord) <= 38)
            SELECT *, {FRAMED}, {hint} AS action_hint FROM k WINDOW w AS (PARTITION BY job_id ORDER BY ord)""",
        "prune_events": f"""WITH RECURSIVE {TOLD}, a AS (SELECT *, ord = min(ord) OVER p OR ord = max(ord) OVER p AS ends, CASE WHEN min(ord) OVER p = max(ord) OVER p THEN 1 ELSE 2 END AS n_ends, {terms} AS terms, {hint} AS hint,
            row_number() OVER (PARTITION BY job_id, system, lower(text) ORDER BY ord) AS nth FROM told WINDOW p AS (PARTITION BY job_id)),
            o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS i FROM a WHERE nth = 1 AND (ends OR NOT (len(tok) <= 4 AND terms = 0 AND system = 'Other'))),
            {fold_sql("o", "STRUCT(ord BIGINT, time_sec DOUBLE, system VARCHAR, text VARCHAR, tok VARCHAR[], ends BOOLEAN, n_ends INT, score DOUBLE)", prune)},
            c AS (SELECT job_id, x.ord AS ord, x.time_sec AS time_sec, x.system AS system, x.text AS text, x.score AS score, x.ends AS ends, x.n_ends AS n_ends FROM got),
            k AS (SELECT job_id, ord, time_sec, system, text, score FROM c QUALIFY count(*) OVER (PARTITION BY job_id) <= 12 OR ends OR row_number() OVER (PARTITION BY job_id, ends ORDER BY score DESC, ord) <= 12 - n_ends)
            SELECT *, {FRAMED}, {hint} AS action_hint FROM k WINDOW w AS (PARTITION BY job_id ORDER BY ord)""",
        "representative_frames": f"""WITH RECURSIVE {FRAMES}, n AS (SELECT job_id, ord, time_sec, visual_score AS diff, (k * 91193)::BIGINT AS h, count(*) OVER (PARTITION BY job_id) AS n FROM frames), s AS (SELECT *, greatest(1, n // 8) AS stride FROM n WHERE n > 20),
            t AS (SELECT job_id, ord, time_sec, h, 0 AS turn, 0.0::DOUBLE AS key, 0.0 AS wide, 'first' AS reason, true AS force FROM s WHERE ord = 0 UNION ALL SELECT job_id, ord, time_sec, h, 1, 0.0, 0.0, 'last', true FROM s WHERE ord = n - 1
              UNION ALL SELECT job_id, ord, time_sec, h, 2, ord, 8.0, 'even', false FROM s WHERE ord % stride = 0 UNION ALL SELECT job_id, ord, time_sec, h, 3, -diff, 8.0, 'change', false FROM s WHERE diff >= 0.01 UNION ALL SELECT job_id, ord, time_sec, h, 4, ord, 4.0, 'fill', false FROM s),
            o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY turn, key, ord) AS i FROM t), {fold_sql("o", "STRUCT(ord BIGINT, time_sec DOUBLE, h BIGINT, reason VARCHAR)", spread)}
            SELECT job_id, ord, 'all' AS reason FROM n WHERE n <= 20 UNION ALL SELECT job_id, x.ord, x.reason FROM got""",
    }


def job_sql() -> dict[str, str]:
    px = "list_transform(embedding, lambda v: round(127.5 + 127.5 * greatest(-1.0, least(1.0, v::DOUBLE)))::INT)"
    log = """l AS (SELECT o_custkey AS id, epoch_us(o_orderdate) AS updated, o_orderkey AS seq, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 100 / 100 END AS progress,
        CASE WHEN o_orderkey % 7 = 0 THEN '{broken' WHEN o_orderkey % 2 = 0 THEN '{"extraction": ' || o_orderkey % 100 || ', "cleanup": ' || 100 - o_orderkey % 100 || '}' END AS meta FROM orders),
        j AS (SELECT id, arg_max(status, (updated, seq)) FILTER (WHERE status IS NOT NULL) AS status, arg_max(progress, (updated, seq)) FILTER (WHERE progress IS NOT NULL) AS progress, arg_max(meta, (updated, seq)) FILTER (WHERE meta IS NOT NULL) AS meta, max(updated) AS updated FROM l GROUP BY 1),
        p AS (SELECT *, CASE WHEN json_valid(meta) THEN json_extract_string(meta, '$.extraction') END AS a FROM j)"""
    return {
        "job_state": f"WITH {log} SELECT id, status, progress, updated, coalesce(a, '') AS extraction FROM p",
        "job_status": f"WITH {log} SELECT id, floor(coalesce(progress, 0) * 100)::INT || '% - ' || coalesce(CASE WHEN id % 2 = 0 THEN 'Reading frames' END, status, '') AS line FROM p",
        "slowest_stage": f"WITH {log} SELECT id, CASE WHEN a::INT > 50 THEN 'extraction' ELSE 'cleanup' END AS stage, greatest(a::DOUBLE, 100 - a::DOUBLE) AS seconds FROM p WHERE a IS NOT NULL",
        "capabilities": """SELECT c_custkey AS id, k AS model_ready, CASE WHEN k THEN 'production_vision' WHEN c_custkey % 2 = 0 THEN 'local_ocr_draft' ELSE 'diagnostic_only' END AS mode,
            CASE WHEN k THEN 'production_vision' WHEN c_custkey % 5 > 0 THEN 'local_ocr_draft' ELSE 'diagnostic_only' END AS mode_after_text FROM (SELECT c_custkey, c_custkey % 4 = 1 AND c_custkey % 3 <> 0 AS k FROM customer)""",
        "job_evaluation": f"WITH {quality_sql().replace('SELECT job_id, n_events', ', rep AS (SELECT job_id, n_events', 1)}) SELECT job_id, generation_source, count(*) AS steps, count_if(confidence <> 'high') AS low_confidence, any_value(readiness) = 'demo_ready' AND bool_or(generation_source = 'diagnostic_fallback') AS fault FROM phased JOIN rep USING (job_id) GROUP BY 1, 2",
        "resized": f"""WITH p AS (SELECT vec_id, {px} AS x FROM embeddings), q AS (SELECT vec_id, x FROM p WHERE vec_id + 1 IN (SELECT vec_id FROM p))
            SELECT vec_id AS ord, array_to_string(list_transform(range(0, 16), lambda i: round_even((x[i // 4 * 16 + i % 4 * 2 + 1] + x[i // 4 * 16 + i % 4 * 2 + 2] + x[i // 4 * 16 + i % 4 * 2 + 9] + x[i // 4 * 16 + i % 4 * 2 + 10]) / 4, 0)::INT), ' ') AS small FROM q""",
        "pixel_edges": f"""{canny_sql(px)}, once AS (SELECT vec_id, count(*) AS n FROM (SELECT vec_id, i FROM (SELECT vec_id, i FROM edge UNION ALL SELECT vec_id - 1, i FROM edge) GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1)
            SELECT a.vec_id, round(coalesce(n, 0) / 64, 6) AS edge_delta FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 LEFT JOIN once ON once.vec_id = a.vec_id""",
        "visual_structure": f"""{canny_sql(px)}, n AS (SELECT vec_id, count(*) AS n FROM edge GROUP BY 1), d AS (SELECT vec_id, stddev_pop(v) AS d FROM (SELECT vec_id, unnest(x) AS v FROM p) GROUP BY 1)
            SELECT d.vec_id AS ord, round(least(1.0, greatest(0.0, 0.65 * coalesce(n, 0) / 64 + 0.35 * least(1.0, d / 128))), 6) AS structure FROM d LEFT JOIN n USING (vec_id) WHERE d.vec_id + 1 IN (SELECT vec_id FROM p)""",
        "pixel_diff": f"WITH p AS (SELECT vec_id, {px} AS x FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i]))) / 64 / 255, 6) AS diff FROM p a JOIN p b ON b.vec_id = a.vec_id + 1",
    }


COUNTED = "before steps merged noise passive duplicates low diagnostic generic operational contextual checkpoints review_runs long corrections phase_errors generic_phases phases".split()


def quality_sql() -> str:
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTED)
    block = [
        ("noise", "noise > 0"), ("coverage", "short"), ("under-coverage", "uncovered"), ("passive reviews", "contextual > greatest(3, steps // 5)"), ("diagnostic mode", "mode = 'diagnostic_only'"), ("diagnostic steps", "diagnostic > steps / 2"),
        ("no evidence source", "NOT model_ready AND ocr_count = 0"), ("model failed", "model_ready AND calls > 0 AND succeeded = 0"), ("few operations", "vague"), ("generic reviews", "wordy"), ("missing actions", "n_missing > 0"),
        ("phase errors", "phase_errors > 0"), ("density", "sparse"), ("long segments", "long > 0"),
    ]
    costs = "10 * noise + 5 * duplicates + 3 * greatest(0, passive - 2) + 2 * low + least(60, 8 * diagnostic) + 8 * n_missing + 5 * review_runs + least(30, 10 * long)"
    for cond, points in (("raw_low", 30), ("final_low", 35), ("short", 15), ("vague", 35), ("wordy", 25), ("steps < 8", 10), ("low / greatest(1, steps) > 0.25", 10), ("violations > 0", 20), ("(phases = 1 AND generic_phases > 0)", 5), ("generic_phases = steps", 5), ("phase_errors > 0", 20), ("sparse", 25)):
        costs += f" + {points} * ({cond})::INT"
    return f"""{report_sql()}, late AS (SELECT job_id, count(*) AS violations FROM (SELECT job_id, order_key < lag(order_key) OVER (PARTITION BY job_id ORDER BY step_number) AS back FROM (SELECT *, {KEY} AS order_key FROM safe)) WHERE back GROUP BY 1),
    q1 AS (SELECT info.*, {zero}, coalesce(missing, '') AS missing, coalesce(violations, 0) AS violations FROM info LEFT JOIN counts USING (job_id) LEFT JOIN late USING (job_id)),
    q2 AS (SELECT *, CASE WHEN n_events > 0 THEN round(steps / n_events, 3) END AS ratio, round(operational / greatest(1, steps), 3) AS coverage, CASE WHEN length > 0 THEN round(steps / (length / 60), 3) END AS density,
      CASE WHEN missing = '' THEN 0 ELSE len(string_split(missing, ',')) END AS n_missing FROM q1),
    q3 AS (SELECT *, n_events > 0 AND before < {LEAST} AS raw_low, coalesce(ratio < 0.6, false) AS final_low, n_events >= 25 AND coalesce(ratio < 0.7, false) AS short, n_events >= 25 AND coverage < 0.55 AS vague, generic / greatest(1, steps) > 0.2 AS wordy,
      mode = 'production_vision' AND length > 300 AND coalesce(density < 3.0, false) AND justification = '' AS sparse FROM q2),
    q4 AS (SELECT *, (raw_low OR final_low) AND justification = '' AS uncovered FROM q3),
    q5 AS (SELECT *, greatest(0, least(CASE WHEN n_missing > 0 THEN 69 WHEN phase_errors > 0 OR sparse THEN 79 ELSE 100 END, CASE WHEN steps = 0 THEN 0 ELSE 100 - ({costs}) END))::INT AS score,
      concat_ws(',', {", ".join(f"CASE WHEN {cond} THEN {lit(name)} END" for name, cond in block)}) AS blockers FROM q4)
    SELECT job_id, n_events, {", ".join(c for c in COUNTED if c not in ("generic_phases", "phases"))}, violations, missing, ratio, coverage, density, score,
      CASE WHEN score >= 80 AND blockers = '' AND NOT raw_low AND diagnostic = 0 THEN 'demo_ready' WHEN score >= 60 THEN 'needs_review' ELSE 'not_ready' END AS readiness, blockers FROM q5"""


def oracle_sql() -> dict[str, str]:
    bits = "list_transform(embedding, lambda v: CASE WHEN v::DOUBLE > list_sum(list_transform(embedding, lambda u: u::DOUBLE)) / len(embedding) THEN '1' ELSE '0' END)"
    hash_sql = f"h AS (SELECT vec_id, array_to_string({bits}, '') AS b FROM embeddings)"
    nibbles = " || ".join(f"substr('0123456789abcdef', 1 + 8 * substr(b, {4 * i + 1}, 1)::INT + 4 * substr(b, {4 * i + 2}, 1)::INT + 2 * substr(b, {4 * i + 3}, 1)::INT + substr(b, {4 * i + 4}, 1)::INT, 1)" for i in range(16))
    ta, tb, ca, cb = "a", "b", "c", "d"
    jac = f"{TURNS}, x AS (SELECT conv_id, turn, {sql_tokens('text')} AS a, {sql_tokens('before')} AS b, {sql_content('text')} AS c, {sql_content('before')} AS d FROM t)"
    keep_line = f"(length(l) >= 7 OR {sql_has('lower(l)', rules.LINE_KEYWORDS)})"
    known = ", ".join(map(lit, [*rules.SYSTEMS, "Other"]))
    repair = f"""SELECT job_id, step_number, trim(action) AS action, CASE WHEN rule_system <> 'Other' AND f <> rule_system THEN rule_system ELSE f END AS system,
        CASE WHEN rule_system <> 'Other' AND f <> rule_system AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence
        FROM (SELECT *, CASE WHEN system IN ({known}) THEN system WHEN rule_system IN ({known}) THEN rule_system ELSE 'Other' END AS f FROM steps)
        WHERE trim(action) <> '' AND NOT regexp_matches(lower(trim(action)), {lit(rules.TOOLBAR)})"""
    session = "SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 10800000000 THEN 0 ELSE 1 END AS mark FROM events"
    calls = "least(max_calls, ceil(max_events / batch) + (risky > 0)::INT + (reviews > 0)::INT)"
    made = "least(max_events, batch * least(ceil(max_events / batch), greatest(0, max_calls - (risky > 0)::INT - (reviews > 0)::INT)))"
    return evidence_sql() | job_sql() | {
        "threshold_by_job": f"WITH {THRESHOLD} SELECT job_id, round(median, 6) AS median, round(mad, 6) AS mad, round(percentile, 6) AS percentile, round(threshold, 6) AS threshold FROM th",
        "frame_deltas": f"""WITH {FRAMES} SELECT job_id, ord, round(abs(coalesce(boundary_score - lag(boundary_score) OVER w, 0)), 6) AS score_delta, round(abs(coalesce(visual_score - lag(visual_score) OVER w, 0)), 6) AS visual_delta,
            round(abs(coalesce(time_sec - lag(time_sec) OVER w, 0)), 6) AS gap FROM frames WINDOW w AS (PARTITION BY job_id ORDER BY ord)""",
        "sampling_grid": f"""WITH {FRAMES}, r AS (SELECT job_id, max(time_sec) AS d FROM frames GROUP BY 1), g AS (SELECT job_id, d, unnest(range(0, greatest(1, least(40, ceil(d / 4.5)))::INT)) AS i FROM r),
            t AS (SELECT job_id, d, i, least(d, i * 4.5) AS time_sec FROM g), e AS (SELECT job_id, max(d) AS d, max(i) AS i, max(time_sec) AS m FROM t GROUP BY 1)
            SELECT job_id, i AS frame_id, time_sec FROM t UNION ALL SELECT job_id, i + 1, d FROM e WHERE m < d - 1""",
        "recording_source": f"""WITH {FRAMES}, r AS (SELECT job_id, max(time_sec) AS d FROM frames GROUP BY 1), g AS (SELECT job_id, d, unnest(range(0, greatest(1, least(40, ceil(d / 4.5)))::INT)) AS i FROM r),
            t AS (SELECT job_id, d, i, least(d, i * 4.5) AS time_sec FROM g), e AS (SELECT job_id, max(d) AS d, max(i) AS i, max(time_sec) AS m FROM t GROUP BY 1)
            SELECT job_id, i AS frame_id, time_sec FROM t UNION ALL SELECT job_id, i + 1, d FROM e WHERE m < d - 1""",
        "boundary_candidates": f"WITH RECURSIVE {QUALIFIED} SELECT * FROM cand",
        "segment_spans": f"WITH RECURSIVE {SPANS} SELECT * FROM spans",
        "forced_split": f"WITH RECURSIVE {PARTS} SELECT * FROM parts",
        "segment_topk": f"""WITH RECURSIVE {PARTS}, s AS (SELECT parts.job_id, start_ord, end_ord, boundary_score AS start_score, forced, row_number() OVER (PARTITION BY parts.job_id ORDER BY (start_ord <> 0)::INT, boundary_score DESC, start_ord) AS r
            FROM parts JOIN frames ON frames.job_id = parts.job_id AND frames.ord = start_ord) SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ord) AS event_id, start_ord, end_ord, start_score, forced FROM s WHERE r <= 12""",
        "stable_frame": f"WITH RECURSIVE {PARTS} SELECT parts.job_id, start_ord, arg_min(ord, (visual_score, -diff_score, ord)) AS stable_ord FROM parts JOIN frames ON frames.job_id = parts.job_id AND ord >= start_ord AND ord < end_ord GROUP BY 1, 2",
        "average_hash": f"WITH {hash_sql} SELECT vec_id, {nibbles} AS hash FROM h",
        "hash_distance": f"WITH {hash_sql} SELECT a.vec_id, (SELECT count(*) FROM range(1, 65) r(i) WHERE substr(a.b, i::INT, 1) <> substr(b.b, i::INT, 1))::INT AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1",
        "classify_system": f"WITH {SCREENS} SELECT job_id, ord, {sql_class('ocr_text', rules.SYSTEMS, 'Other')} AS system, {sql_class('ocr_text', rules.HINTS, 'review')} AS hint FROM screens",
        "classify_pages": f"SELECT page_id, {sql_class('url', rules.SYSTEMS, 'Other')} AS system FROM pages",
        "smooth_systems": f"""WITH {SCREENS}, l AS (SELECT *, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS s FROM screens), n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM l WINDOW w AS (PARTITION BY job_id ORDER BY ord))
            SELECT job_id, ord, CASE WHEN s = 'Other' AND trim(ocr_text) = '' AND a = b AND a <> 'Other' THEN a ELSE s END AS system, coalesce(s = 'Other' AND trim(ocr_text) = '' AND a = b AND a <> 'Other', false) AS inherited FROM n""",
        "text_deltas": f"""WITH {SCREENS}, l AS (SELECT *, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS s FROM screens), n AS (SELECT job_id, ord, s, lag(s) OVER w AS p, {sql_tokens("ocr_text")} AS a, {sql_tokens("lag(ocr_text) OVER w")} AS b FROM l WINDOW w AS (PARTITION BY job_id ORDER BY ord))
            SELECT job_id, ord, round(1 - {sql_jaccard("a", "b", 1.0)}, 6) AS text_delta, coalesce((p <> 'Other' AND p <> s)::INT, 0) AS system_delta FROM n""",
        "repeated_runs": f"WITH {SCREENS} SELECT job_id, ord, k % 3 AS screen_state_id, coalesce(k % 3 = lag(k % 3) OVER w, false) OR coalesce(k % 3 = lead(k % 3) OVER w, false) AS dense_repeated_run FROM screens WINDOW w AS (PARTITION BY job_id ORDER BY ord)",
        "jaccards": f"WITH {jac} SELECT conv_id, turn, round({sql_jaccard(ta, tb, 1.0)}, 6) AS token_jaccard, round({sql_jaccard(ta, tb, 0.0)}, 6) AS similarity, round({sql_jaccard(ca, cb, 1.0)}, 6) AS content_jaccard FROM x",
        "tokens": f"WITH {jac} SELECT conv_id, x.turn, len(a)::INT AS n_tokens, len(c)::INT AS n_content, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE least(1.0, 0.55 * least(1.0, len(a) / 18) + 0.45 * least(1.0, length(trim(text)) / 180)) END, 6) AS strength FROM x JOIN t USING (conv_id, turn)",
        "clean_lines": f"""WITH {SCREENS}, l AS (SELECT event_id, i, trim(regexp_replace(s, '\\s+', ' ', 'g')) AS l FROM (SELECT event_id, unnest(string_split(ocr_text, chr(10))) AS s, generate_subscripts(string_split(ocr_text, chr(10)), 1) AS i FROM screens)),
            f AS (SELECT *, row_number() OVER (PARTITION BY event_id, lower(l) ORDER BY i) AS r FROM l WHERE length(l) >= 3 AND NOT {sql_match("lower(l)", rules.LINE_NOISE)}),
            g AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) AS m FROM f WHERE r = 1 AND {keep_line})
            SELECT s.event_id, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS cleaned FROM screens s LEFT JOIN g ON g.event_id = s.event_id AND m <= 28 GROUP BY 1""",
        "redact_documents": f"SELECT doc_id, md5({REDACT.format(x='text')}) AS redacted_md5 FROM documents",
        "verb_roots": f"WITH {STEPS} SELECT job_id, step_number, array_to_string(list_sort({sql_roots('action')}), ' ') AS roots FROM steps",
        "step_flags": f"WITH {FLAGS} SELECT job_id, step_number, meaningful, checkpoint, noise, passive, review, generic FROM flags",
        "risk_flags": f"WITH {STEPS} SELECT job_id, step_number, {RISKY} AS risky FROM steps",
        "verify_offline": f"""WITH {STEPS}, r AS (SELECT *, {RISKY} AS risky FROM steps) SELECT job_id, step_number, CASE WHEN risky THEN {REDACT.format(x="action")} ELSE action END AS action,
            CASE WHEN risky THEN {REDACT.format(x="expected_output")} ELSE expected_output END AS expected_output, CASE WHEN risky AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence FROM r""",
        "repair_steps": f"WITH {STEPS} {repair}",
        "validate_dedupe": validate_sql(repair),
        "screen_states": states_sql(),
        "scroll_collapse": scroll_sql(),
        "segment_report": f"""WITH RECURSIVE {SPANS} SELECT job_id, string_agg('- ' || segment || ': ' || printf('%.1f', start_time) || '-' || printf('%.1f', end_time) || ' s, ' || frame_count || ' frames, score ' || printf('%.4f', boundary_score), chr(10) ORDER BY segment) AS report FROM spans GROUP BY 1""",
        "process_names": """WITH w AS (SELECT p_partkey, list_filter(string_split(lower(regexp_replace(replace(p_name, ' ', '_') || '_1080p_video', '[_-]+', ' ', 'g')), ' '), lambda w: NOT regexp_full_match(w, '|video|recording|screen|download|downloaded|\\d{3,4}p|\\d{2,}')
              AND NOT (regexp_matches(w, '[a-z]') AND regexp_matches(w, '\\d') AND length(w) >= 8)) AS w FROM part)
            SELECT p_partkey, CASE WHEN len(w) = 0 THEN 'Recorded Process' ELSE array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') END AS name FROM w""",
        "fallback_steps": fallback_sql(),
        "visual_scores": f"WITH {FRAMES} SELECT job_id, ord, round(0.40 * boundary_score + 0.35 * (k % 10 / 11) + 0.15 * (k % 7 / 7) + 0.10 * (k % 64 / 63), 6) AS score FROM frames",
        "generated_steps": f"""WITH own AS ({fallback_sql()}), seen AS (WITH {SCREENS} SELECT job_id, ord + 1 AS event_id, k, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS seen FROM screens)
            SELECT job_id, event_id, CASE WHEN k % 6 = 0 THEN 'SAP' ELSE seen END AS system, CASE WHEN k % 3 = 0 AND k % 5 > 0 THEN 'Post document ' || (event_id - 1) || ' take ' || CASE WHEN k % 12 = 0 THEN 2 ELSE 1 END ELSE action END AS action,
              CASE WHEN k % 3 = 0 AND k % 4 > 0 THEN 'It is posted.' ELSE expected_output END AS expected_output, CASE WHEN k % 3 > 0 THEN confidence WHEN k % 9 = 0 THEN 'medium' ELSE 'high' END AS confidence,
              CASE WHEN k % 3 = 0 THEN 'openai_vision' ELSE generation_source END AS generation_source FROM own JOIN seen USING (job_id, event_id)""",
        "budgeted_steps": f"""WITH own AS ({fallback_sql()}), seen AS (WITH {SCREENS} SELECT job_id, ord + 1 AS event_id, k, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS seen FROM screens)
            SELECT job_id, event_id, CASE WHEN (k % 6 = 0 AND (event_id - 1) // 9 < 3) THEN 'SAP' ELSE seen END AS system, CASE WHEN (k % 3 = 0 AND (event_id - 1) // 9 < 3) AND k % 5 > 0 THEN 'Post document ' || (event_id - 1) || ' take ' || CASE WHEN k % 12 = 0 THEN 2 ELSE 1 END ELSE action END AS action,
              CASE WHEN (k % 3 = 0 AND (event_id - 1) // 9 < 3) AND k % 4 > 0 THEN 'It is posted.' ELSE expected_output END AS expected_output, CASE WHEN (k % 3 > 0 OR (event_id - 1) // 9 >= 3) THEN confidence WHEN k % 9 = 0 THEN 'medium' ELSE 'high' END AS confidence,
              CASE WHEN (k % 3 = 0 AND (event_id - 1) // 9 < 3) THEN 'openai_vision' ELSE generation_source END AS generation_source FROM own JOIN seen USING (job_id, event_id)""",
        "calls_made": f"WITH {FRAMES}, c AS (SELECT job_id, ord // 2 AS call, bool_or(k % 3 = 0) AS answered FROM frames WHERE ord // 2 < 5 GROUP BY 1, 2) SELECT job_id, count(*) AS attempted, count_if(answered) AS succeeded FROM c GROUP BY 1",
        "audit_flags": audit_sql(),
        "verify_updates": f"""WITH {STEPS}, r AS (SELECT *, {RISKY} AS risky FROM steps), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, risky ORDER BY step_number) AS nth FROM r), u AS (SELECT *, risky AND nth <= 8 AND k % 2 = 0 AS upd FROM n),
            v AS (SELECT job_id, step_number, risky, upd, k, confidence AS c, expected_output, system AS sy, CASE WHEN upd THEN action || ' Click 12345.' ELSE action END AS action FROM u)
            SELECT job_id, step_number, CASE WHEN upd AND k % 6 = 0 THEN 'PDF' ELSE sy END AS system, CASE WHEN risky THEN {REDACT.format(x="action")} ELSE action END AS action, CASE WHEN risky THEN {REDACT.format(x="expected_output")} ELSE expected_output END AS expected_output,
              CASE WHEN upd AND k % 4 > 0 THEN 'low' ELSE c END AS confidence, upd AS verified FROM v""",
        "run_stats": f"""WITH {EV} SELECT job_id, count(*) AS attempted, count_if(k % 6 <> 0) AS succeeded, coalesce(string_agg(CASE WHEN k % 6 = 0 THEN 'timeout ' || k END, '; ' ORDER BY ord), '') AS errors FROM ev GROUP BY 1""",
        "job_created": "SELECT c_custkey AS id, 1 AS updated, 0 AS seq, 'queued' AS status, 0.0::DOUBLE AS progress, 'Queued' AS message, c_name AS input_path, '{}' AS meta FROM customer",
        "audit_runs": f"""WITH {FLAGS}, m AS (SELECT *, CASE WHEN (system, action, expected_output) = lag((system, action, expected_output)) OVER w THEN 0 ELSE 1 END AS s FROM flags WINDOW w AS (PARTITION BY job_id ORDER BY step_number)),
            r AS (SELECT *, sum(s) OVER (PARTITION BY job_id ORDER BY step_number) AS run FROM m)
            SELECT job_id, step_number, count(*) OVER (PARTITION BY job_id, run) AS run_length, count(*) OVER (PARTITION BY job_id, run) >= 2 OR generic AS weak FROM r""",
        "update_join": f"WITH {STEPS} SELECT job_id, step_number, CASE WHEN k % 10 = 0 THEN action || ' (checked twice)' WHEN k % 5 = 0 THEN action || ' (checked)' ELSE action END AS action, CASE WHEN k % 10 = 0 THEN 'high' WHEN k % 5 = 0 THEN 'medium' ELSE confidence END AS confidence FROM steps",
        "workflow_family": f"WITH {FAMILY} SELECT * FROM fam",
        "phase_sections": f"""WITH {STEPS}, {phases_sql("steps")}, m AS (SELECT *, (phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY job_id ORDER BY step_number))::INT AS s FROM phased)
            SELECT job_id, step_number, family, phase, sum(s) OVER (PARTITION BY job_id ORDER BY step_number) AS section FROM m""",
        "chronology": f"WITH {TIMED}, p AS (SELECT *, lag(order_key) OVER (PARTITION BY job_id ORDER BY step_number) AS prior FROM timed) SELECT job_id, step_number, order_key.kind AS kind, order_key.value AS value, prior.kind AS prior_kind, prior.value AS prior_value FROM p WHERE order_key < prior",
        "order_repair": f"WITH {TIMED} SELECT job_id, step_number AS original, row_number() OVER (PARTITION BY job_id ORDER BY order_key, step_number) AS step_number FROM timed",
        "review_runs": f"WITH {FLAGS}, r AS (SELECT *, sum((NOT review)::INT) OVER (PARTITION BY job_id ORDER BY step_number) AS run FROM flags) SELECT job_id, min(step_number) AS first_number, max(step_number) AS last_number, count(*) AS n FROM r WHERE review GROUP BY job_id, run HAVING count(*) >= 2",
        "anti_removed": f"WITH {FLAGS} SELECT job_id, step_number, action FROM flags WHERE NOT noise",
        "semantic_counts": f"""WITH {FLAGS} SELECT job_id, count(*) AS steps, count_if(noise) AS noise, count_if(passive) AS passive, count_if(generic) AS generic, count_if(meaningful) AS operational, count_if(confidence <> 'high') AS low_confidence,
            round(count_if(meaningful) / count(*), 3) AS coverage FROM flags GROUP BY 1""",
        "pair_merge": f"WITH {PAIRS} SELECT job_id, me.step_number AS left_number, nxt.step_number AS right_number, CASE WHEN me.score >= nxt.score AND NOT ({SETUP}) THEN me.step_number ELSE nxt.step_number END AS kept FROM p WHERE edge AND nth % 2 = 1",
        "quality_report": f"WITH {quality_sql()}",
        "clean_steps": f"WITH {clean_sql()}, s AS (SELECT *, (phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY job_id ORDER BY place))::INT AS mark FROM phased) SELECT job_id, place, step_number, action, 1 + pair::INT AS n_sources, category, phase, sum(mark) OVER (PARTITION BY job_id ORDER BY place) AS section FROM s",
        "ordering_keys": f"""WITH {STEPS}, t AS (SELECT *, coalesce(CASE WHEN k % 5 = 0 THEN time_sec + 1 END, CASE WHEN k % 3 = 0 THEN time_sec END, CASE WHEN k % 4 = 0 THEN k * 7.0 END)::DOUBLE AS t, CASE WHEN k % 9 > 0 THEN step_number * 2.0 END AS e FROM steps),
            v AS (SELECT job_id, step_number, CASE WHEN t IS NOT NULL THEN 0 WHEN e IS NOT NULL THEN 1 ELSE 2 END AS kind, coalesce(t, e, step_number)::DOUBLE AS value FROM t) SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY kind, value, step_number) AS place FROM v""",
        "removal_guards": f"WITH {judged_sql()} SELECT job_id, step_number, removal, guarded, category FROM judged",
        "removed_steps": f"WITH {judged_sql()} SELECT job_id, step_number, CASE WHEN removal = 'filler' AND row_number() OVER (PARTITION BY job_id, removal, body ORDER BY order_key, step_number) > 1 THEN 'repeated filler' ELSE removal END AS reason FROM judged WHERE removal IS NOT NULL",
        "completeness": f"WITH {report_sql()} SELECT job_id, review_runs, n_events >= 25 AND operational < greatest(12, floor(steps * 0.55)) AS thin, n_events >= 25 AND widest_gap >= 5 AS gappy, missing FROM counts JOIN info USING (job_id)",
        "phase_labels": f"WITH {RAW}, {phases_sql('raw')} SELECT job_id, step_number, family, phase, corrected FROM phased",
        "phase_errors": f"WITH {RAW}, p AS (SELECT *, ['Configure PivotTable fields', 'Add calculations and formatting', 'Create PivotTable'][step_number % 3 + 1] AS phase FROM raw) SELECT job_id, step_number, {sql_first(rules.PHASE_ERRORS, SAID)} AS error FROM p",
        "legacy_phases": f"""WITH {RAW}, p AS (SELECT *, CASE WHEN system = 'Excel' THEN 'Process in Excel' {" ".join(f"WHEN {sql_has(f'lower(system || chr(32) || {BOTH_TEXT})', t)} THEN {lit(n)}" for n, t in rules.LEGACY_PHASES)} END AS phase FROM raw)
            SELECT job_id, step_number, coalesce(phase, CASE WHEN count_if(phase IS NULL) OVER (PARTITION BY job_id ORDER BY step_number) <= {rules.LEGACY_FIRST} THEN 'Access system' ELSE 'Validate' END) AS phase FROM p""",
        "distinct_states": f"WITH {STEPS}, f AS (SELECT job_id, screen_state_id AS state, min(step_number) AS first_number FROM steps GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY first_number) AS place FROM f",
        "batches": f"WITH {FRAMES} SELECT job_id, (ord // 9)::INT AS batch, count(*) AS n FROM frames GROUP BY 1, 2",
        "report_totals": f"""WITH {safe_sql()}, q AS (WITH {quality_sql()}), r AS (SELECT q.*, mode, family FROM q JOIN info USING (job_id) JOIN (SELECT DISTINCT job_id, {family_sql()} AS family FROM safe) f USING (job_id))
            SELECT family, mode, readiness, (grouping(family, mode, readiness))::BIGINT AS level, count(*) AS jobs, sum(steps)::BIGINT AS steps, round(avg(score), 6) AS score FROM r GROUP BY GROUPING SETS ((family, mode, readiness), (family, mode), (family), ())""",
        "phase_table": f"WITH {clean_sql()} SELECT job_id, " + ", ".join(f"count_if(phase = {lit(p)}) AS p{i}" for i, p in enumerate(PHASE_COLUMNS)) + " FROM phased GROUP BY job_id",
        "sketched_thresholds": f"WITH {FRAMES} SELECT job_id, count(*) AS n, true AS median_near, true AS percentile_near FROM frames WHERE ord > 0 GROUP BY job_id",
        "state_counts": f"WITH {STEPS} SELECT job_id, count(DISTINCT screen_state_id) AS states FROM steps GROUP BY job_id",
        "cost_estimate": f"""WITH {PLANNED.format(profiles=profiles_sql())}, c AS (SELECT *, {calls} AS calls, {made} AS made FROM plan), i AS (SELECT *, made * CASE WHEN context THEN 3 ELSE 1 END + least(risky, max_events) + least(reviews * 2, max_events * 2) AS images FROM c)
            SELECT id, profile, calls::BIGINT AS calls, images::BIGINT AS images, (calls * 900 + made * 220 + images * 85)::BIGINT AS input_tokens, (least(max_steps, max_events) * 90)::BIGINT AS output_tokens,
            round(((calls * 900 + made * 220 + images * 85) / 1e6 * input_price + least(max_steps, max_events) * 90 / 1e6 * output_price)::VARCHAR::DECIMAL(28, 18), 4)::DOUBLE AS usd FROM i""",
        "call_budget": f"WITH {PLANNED.format(profiles=profiles_sql())} SELECT id, profile, greatest(1, max_calls - 1 - (reviews > 0)::INT)::BIGINT AS generation_calls FROM plan",
        "profile_default": f"WITH {profiles_sql()} SELECT c_custkey AS id, profile, max_events::BIGINT AS max_events, density::DOUBLE AS density FROM customer JOIN p ON profile = CASE WHEN c_mktsegment = 'BUILDING' THEN 'Balanced' ELSE 'Showcase fast' END",
        "job_latest": "SELECT o_custkey AS id, arg_max(o_orderstatus, (epoch_us(o_orderdate), o_orderkey)) AS status, max(epoch_us(o_orderdate)) AS updated, arg_max(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) AS seq FROM orders GROUP BY 1",
        "job_list": "SELECT o_orderkey AS id, epoch_us(o_orderdate) AS created, o_orderstatus AS status FROM orders ORDER BY created DESC, id LIMIT 25",
        "config_precedence": """WITH v AS (SELECT ['environment', 'dotenv', 'secrets', 'other'][(c_custkey * 7) % 4 + 1] AS source, (c_custkey * 7) % 4 AS rank, 'K' || c_custkey // 4 AS key, c_name AS value FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 3 > 0)
            SELECT key, arg_min(value, rank) AS value, arg_min(source, rank) AS source FROM v WHERE rank < 3 GROUP BY key""",
        "review_categories": f"""WITH {FLAGS.replace(STEPS, FAMILY, 1)}, n AS (SELECT flags.*, family, coalesce(lag(meaningful) OVER w, false) AS before, coalesce(lead(meaningful) OVER w, false) AS after, {A} || ' ' || {E} AS body
            FROM flags JOIN fam USING (job_id) WINDOW w AS (PARTITION BY flags.job_id ORDER BY step_number)), c AS (SELECT *, family LIKE 'excel%' AS xl, {sql_has("body", cleanup.REVIEW_OBJECTS)} AS about, {sql_has("body", cleanup.OUTPUTS)} AS shows, {sql_has("body", cleanup.FILLER)} AS filler FROM n)
            SELECT job_id, step_number, CASE WHEN checkpoint THEN 'operational_checkpoint' WHEN xl AND filler THEN 'passive_filler' WHEN (about OR (xl AND shows)) AND before THEN 'operational_checkpoint'
              WHEN (about OR (xl AND shows)) AND after THEN 'contextual_review' ELSE 'passive_filler' END AS category FROM c WHERE review OR passive OR checkpoint""",
        "state_signatures": f"""WITH {SCREENS}, l AS (SELECT *, {sql_class("ocr_text", rules.SYSTEMS, "Other")} AS system, lpad(printf('%x', k % 5 * 1023), 16, '0') AS hash FROM screens)
            SELECT event_id, system || ':' || substr(hash, 1, 8) || ':' || array_to_string(list_sort({sql_tokens("ocr_text")})[1:10], ' ') AS state, substr(sha1(system || ':' || lower(substr(ocr_text, 1, 500))), 1, 12) AS event,
              array_to_string(list_sort(list_distinct(regexp_extract_all(lower(ocr_text), {lit(text.KEY_TERMS)})))[1:18], ',') AS terms FROM l""",
        "confidence_reasons": f"""WITH {STEPS} SELECT job_id, step_number, concat_ws('; ', CASE WHEN confidence <> 'high' THEN 'confidence is not high' END, CASE WHEN {RISKY} THEN 'contains a specific action or value' END,
            CASE WHEN k / 100 > 0.6 THEN 'text changed strongly' END, CASE WHEN k / 500 < 0.04 THEN 'little visual change' END) AS reason FROM steps""",
        "parsed_items": "SELECT n, unnest(range(0, CASE n % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END))::INT AS at, n AS id, md5(text) AS action_md5 FROM (SELECT conv_id * 100 + turn AS n, text FROM conversations)",
        "job_table": """WITH c AS (SELECT o_custkey AS id, epoch_us(o_orderdate::TIMESTAMP) AS updated, o_orderkey AS seq, o_orderkey % 4 = 0 AS create_it, o_orderkey AS n, o_orderstatus AS s FROM orders),
            born AS (SELECT id, arg_min({'updated': updated, 'seq': seq, 'n': n, 's': s}, (updated, seq)) AS b FROM c WHERE create_it GROUP BY id),
            f AS (SELECT id, updated, seq, unnest([{'f': 'status', 'on': n % 3 > 0, 'v': s}, {'f': 'progress', 'on': n % 5 = 0, 'v': (n % 100 / 100)::VARCHAR}, {'f': 'error', 'on': n % 7 = 0, 'v': CASE WHEN n % 2 = 0 THEN n::VARCHAR END},
              {'f': 'meta', 'on': n % 6 = 0, 'v': CASE WHEN n % 12 = 0 THEN '{broken' ELSE n::VARCHAR END}], recursive := true) FROM c WHERE NOT create_it),
            later AS (SELECT f.*, row_number() OVER (PARTITION BY f.id, f ORDER BY f.updated DESC, f.seq DESC) AS nth FROM f JOIN born USING (id) WHERE "on" AND (f.updated, f.seq) > (b.updated, b.seq)),
            last AS (SELECT id, max(updated) AS u, count_if(f = 'status') AS ns, any_value(v) FILTER (WHERE f = 'status') AS vs, count_if(f = 'progress') AS np, any_value(v) FILTER (WHERE f = 'progress') AS vp, count_if(f = 'error') AS ne, max(v) FILTER (WHERE f = 'error') AS ve,
              count_if(f = 'meta') AS nm, any_value(v) FILTER (WHERE f = 'meta') AS vm FROM later WHERE nth = 1 GROUP BY id)
            SELECT id, CASE WHEN ns > 0 THEN vs WHEN b.n % 3 > 0 THEN b.s ELSE 'queued' END AS status, CASE WHEN np > 0 THEN vp::DOUBLE WHEN b.n % 5 = 0 THEN b.n % 100 / 100 ELSE 0.0 END AS progress, 'Queued' AS message,
              CASE WHEN ne > 0 THEN ve WHEN b.n % 7 = 0 AND b.n % 2 = 0 THEN b.n::VARCHAR END AS error, b.updated AS created, greatest(coalesce(u, b.updated), b.updated) AS updated,
              CASE WHEN nm > 0 THEN CASE WHEN vm = '{broken' THEN '' ELSE vm END WHEN b.n % 6 = 0 AND b.n % 12 <> 0 THEN b.n::VARCHAR ELSE '' END AS k FROM born LEFT JOIN last USING (id)""",
        "stream_boundaries": f"WITH RECURSIVE {QUALIFIED} SELECT * FROM cand",
        "stream_scroll_collapse": scroll_sql(),
        "stream_dedupe": validate_sql(repair, in_place=True),
        "live_activity": "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, user_id, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2",
        "live_sessions": f"WITH m AS ({session}), r AS (SELECT *, sum(mark) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT min(t) AS start_us, max(t) + 10800000000 AS end_us, user_id, count(*) AS n FROM r GROUP BY user_id, s",
    }
