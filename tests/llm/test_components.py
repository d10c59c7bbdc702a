"""Connected components, in one task and by rounds of joins."""

import random

import pytest

from gridloom.llm import common, components, neardup
from tests.llm.test_neardup import SCHEMA, brute, planted


def least(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((i, find(i)) for i in root)


def some_links():
    rng = random.Random(4)
    ids = [rng.randrange(-(2**62), 2**62) for _ in range(400)]
    links = list(zip(ids[:150], ids[1:150]))  # a path whose nodes are in no order
    links += [(ids[150], i) for i in ids[151:220]]  # a star
    links += [tuple(rng.sample(ids[220:390], 2)) for _ in range(110)]
    links += [(ids[391], ids[391]), (ids[392], None), (None, ids[393]), (None, None), links[0], links[0][::-1]]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("most", [0, components.MOST_LINKS])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_LINKS", most)
    links = some_links()
    for rows in (links, [(5, 5), (None, 1)], []):
        got = components.components(spark.createDataFrame(rows, "a long, b long")).collect()
        assert sorted((r.node, r.component) for r in got) == least(rows)


def test_beyond_what_is_gathered(spark, monkeypatch):
    """Neither ids are broadcast nor links joined in one task."""
    for module in (common, neardup):
        monkeypatch.setattr(module, "MOST_BROADCAST", 0)
    monkeypatch.setattr(components, "MOST_LINKS", 0)
    rows = planted(8, [2, 25, 60], 20)
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_tasks(spark):
    """With many partitions a small table takes few shuffles."""
    parts, tracker = 40, spark.sparkContext.statusTracker()
    rows = planted(5, [2, 3, 40, 60], 40)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("near-dedup-tasks", "")
        got = neardup.near_duplicates(docs).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("near-dedup-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert 0 < tasks < 36 * parts
