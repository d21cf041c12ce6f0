"""Near-duplicates where each shuffle has many partitions that AQE doesn't put together."""

from __future__ import annotations

import random

import pytest

from tallyspark.llm import op9_neardup

PARTITIONS = 60
CONF = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def dealt_out(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _texts():
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = f"new{rng.random()}"
            texts.append(" ".join(t))
    return list(enumerate(texts))


def _found(spark):
    docs = spark.createDataFrame(_texts(), "doc_id bigint, text string")
    return sorted((r.doc_id, r.class_id, r.class_size, r.links) for r in op9_neardup.near_duplicates(docs).collect())


def test_tasks_do_not_come_by_the_table(dealt_out):
    """Small tables aren't written by as many tasks as a shuffle has, and most aren't shuffled."""
    context = dealt_out.sparkContext
    context.setJobGroup("near-duplicates", "")
    _found(dealt_out)
    context.setJobGroup("other", "")
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near-duplicates") for s in tracker.getJobInfo(j).stageIds}
    full = [s for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks >= PARTITIONS]
    assert 0 < len(full) <= 40, len(full)


def test_shuffled_and_broadcast_alike(dealt_out, monkeypatch):
    """Whether small tables are broadcast, and in how many tasks pairs are aligned, changes no row."""
    small = _found(dealt_out)
    for name, value in {"FEW": 0, "FILE_ROWS": 1, "TASK_PAIRS": 1, "LED": 3}.items():
        monkeypatch.setattr(op9_neardup, name, value)
    large = _found(dealt_out)
    assert [r[:3] for r in large] == [r[:3] for r in small] and len({r[1] for r in small}) < len(small)
