"""The stages of the pipeline on real rows, each against brute force over its own input, and runs side by side."""

import hashlib
import os
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import components, lower, table

from tracewright.llm import common, decontaminate, exact, mixing, neardup, pipeline, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) rows of each stage."""
    docs, out, root = common.table(spark, SF, "documents"), {}, tmp_path_factory.mktemp("stages")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{root}/{name}")
        after = spark.read.parquet(f"file://{root}/{name}")
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns(spark, stages):
    for name, (before, after) in stages.items():
        if name != "mix":
            assert set(map(tuple, after)) <= set(map(tuple, before)) and after
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mix"]


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    judged = quality.judge(common.table(spark, SF, "documents"), common.table(spark, SF, "labels")).collect()
    assert ids(after) == sorted(r.doc_id for r in judged if r.kept) and len(judged) == len(before)
    good = {r.doc_id for r in common.table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(good & set(ids(after))) >= 0.9 * len(good & set(ids(before)))


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    last = {}
    for r in before:
        key = lower(r.text)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert ids(after) == sorted(last.values())


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    before = sorted(before, key=lambda r: r.doc_id)
    sets = []
    for r in before:
        w = lower(r.text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    at = components(len(sets), links)
    assert ids(after) == [r.doc_id for i, r in enumerate(before) if at[i] == i]


def test_clean_stage(spark, stages):
    before, after = stages["decontaminate"]
    items = [t for r in common.table(spark, SF, "benchmark").collect() if len(t := decontaminate.tokens_of((r.text or "").encode()))]
    found = set()
    for r in before:
        words = decontaminate.tokens_of((r.text or "").encode())
        known = set(words.tolist())
        for item in items:
            most = decontaminate.edits(len(item))
            if sum(x in known for x in item.tolist()) >= len(item) - most and decontaminate.nearest(item, words)[0] <= most:
                found.add(r.doc_id)
                break
    assert ids(after) == sorted(r.doc_id for r in before if r.doc_id not in found)


def test_mix_stage(stages):
    before, after = stages["mix"]
    n, own = {r.doc_id: len((r.text or "").split()) for r in before}, Counter()
    for r in before:
        own[r.source] += n[r.doc_id]
    drawn, tokens = defaultdict(Counter), Counter()
    for r in after:
        assert r.n_tokens == n[r.doc_id]
        drawn[r.source, r.epoch][r.doc_id] += 1
        tokens[r.source] += r.n_tokens
    assert all(c == 1 for x in drawn.values() for c in x.values())
    for s in own:
        assert set(drawn[s, 0]) == {r.doc_id for r in before if r.source == s} and own[s] <= tokens[s] <= 2 * own[s] + 1e-3


def test_mix_blocks(spark):
    """The blocks of the last epoch are those with the least turns, as many as fit, and of the next one the documents that fit."""
    rows = [(i, "w " * (1 + i % 9), "en", "hot" if i % 4 else f"s{i % 3}") for i in range(3_000)]
    docs = table(spark, rows)
    drawn = mixing.mix(docs, block_docs=16, repetition=1.7).collect()
    quota = {r.source: r for r in mixing.weights(docs.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("tokens")), repetition=1.7).collect()}
    blocks = defaultdict(Counter)
    for r in drawn:
        if r.epoch == 0:
            blocks[r.source][r.block] += r.n_tokens
    for s, q in quota.items():
        whole = int(round(q.quota / q.tokens, 9))
        rest = q.quota - whole * q.tokens
        turns = spark.createDataFrame([(s, b, t) for b, t in blocks[s].items()], "source string, block long, tokens long")
        order = [(r.block, r.tokens) for r in turns.orderBy(F.xxhash64(F.lit(7), F.lit(whole).cast("long"), "source", "block"), "block").collect()]
        taken, want = Counter(), {}
        for r in drawn:
            if r.source == s and r.epoch == whole:
                taken[r.block] += r.n_tokens
        for b, t in order:
            if t <= rest + 1e-6:
                want[b], rest = t, rest - t
                continue
            assert taken.get(b, 0) <= rest + 1e-6 and (rest - taken.get(b, 0) < 9)
            break
        assert {b: t for b, t in taken.items() if b in want} == want and set(taken) - set(want) <= {b}


def test_hub(spark):
    """One document with ten thousand partners, dealt into heaps: the links are those of plain sets."""
    n = 10_000
    sets = spark.range(n + 1).select("id", F.array_sort(F.when(F.col("id") == 0, F.sequence(F.lit(1), F.lit(20))).otherwise(F.array_append(F.sequence(F.lit(1), F.when(F.col("id") % 2 == 0, 19).otherwise(12)), (F.lit(100) + F.col("id")).cast("int")))).cast("array<long>").alias("whole"))
    pairs = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert sorted(r.b for r in neardup.confirmed(pairs, sets, 80).collect()) == list(range(2, n + 1, 2))
    swapped = sets.withColumn("id", n - F.col("id"))
    assert neardup.confirmed(pairs.select((n - F.col("b")).alias("a"), F.lit(n).cast("long").alias("b")), swapped, 80).count() == n // 2


def test_runs_side_by_side(spark, tmp_path):
    """A run that ends deletes its own tables, not those of a run in another thread; the last stage's table stays, the others go."""
    ready, go, left = threading.Event(), threading.Event(), []

    def other():
        with common.scratch(spark):
            left.append(common.written(spark.range(5), "theirs"))
            ready.set()
            go.wait(60)
            left.append(left[0].count())

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with common.scratch(spark):
        mine = common.written(spark.range(3), "mine")
        path = mine.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    go.set()
    thread.join()
    assert left[1] == 5


def test_run_leaves_one_table(spark, monkeypatch):
    kept = []
    inner = pipeline.work_dir
    monkeypatch.setattr(pipeline, "work_dir", lambda s: kept.append(inner(s)) or kept[-1])
    docs = pipeline.run(spark, SF)
    assert docs.count() > 0 and [x for x in os.listdir(kept[0].removeprefix("file://")) if not x.startswith(".")] == [f"{len(pipeline.STAGES) - 1}-mix.parquet"]


def test_exact_light_groups(spark):
    """Many copies of texts that the summary doesn't track."""
    rows = [(i, f"text {i % 50}") for i in range(1_000)]
    got = exact.exact_dedup(table(spark, rows), tracked=8, top=2, least=10_000).collect()
    assert {r.group_size for r in got} == {20} and {r.doc_id for r in got if r.kept} == set(range(950, 1_000))
    assert {r.text_sha256 for r in got} == {hashlib.sha256(f"text {i}".encode()).hexdigest() for i in range(50)}
