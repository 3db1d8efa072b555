"""Connected components of small graphs take few tasks; more edges are added to components that are known."""

import random
import uuid

from geoweft.operators.components import connected_components, with_edges


def tasks_of(spark, run):
    """What run returns, and how many tasks its jobs had."""
    tag, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(tag, tag)
    done = run()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(tag) for s in sc.statusTracker().getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    return done, sum(x.numCompletedTasks for s in stages if (x := sc.statusTracker().getStageInfo(s)))


def by_hand(edges):
    at = {n: n for e in edges for n in e}
    while any(at[a] != at[b] for a, b in edges):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


def table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def found_in(components):
    return {x.node: x.component for x in components}


def test_rounds_of_a_small_graph_are_a_task_each(spark):
    edges = [(k, k + 1) for k in range(0, 2000) if k % 100]
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df = table(spark, edges).coalesce(1)
        rows, tasks = tasks_of(spark, lambda: connected_components(df).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found_in(rows) == by_hand(edges)
    assert tasks < 100  # a shuffle for the first distinct, and no other


def test_more_edges(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(150)]
    edges = [e for e in edges if e[0] != e[1]]
    more = [(r.randrange(500), r.randrange(500)) for _ in range(80)] + [(7, 7)]
    found = connected_components(table(spark, edges)).cache()
    rows = with_edges(found, table(spark, more)).collect()
    assert found_in(rows) == by_hand([*edges, *(e for e in more if e[0] != e[1])])
    assert len(rows) == len(found_in(rows))
    assert found_in(with_edges(found, table(spark, more[:0])).collect()) == by_hand(edges)
    none = connected_components(table(spark, edges[:0]))
    assert found_in(with_edges(none, table(spark, edges)).collect()) == by_hand(edges)
    found.unpersist()
