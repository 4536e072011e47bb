"""What the driver plans, builds and sends for small tables."""

import random

from pagequarry.llm import components, jaccard


def _broadcasts(spark, since: int) -> int:
    """Broadcast tables in the plans, as they ran, of all queries but the first ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ran, count = store.executionsList(), 0
    for i in range(ran.size()):
        if ran.apply(i).executionId() >= since:
            nodes = store.planGraph(ran.apply(i).executionId()).allNodes()
            count += sum(nodes.apply(k).name() == "BroadcastExchange" for k in range(nodes.size()))
    return count


def test_join_sends_few_tables(spark):
    """Small tables are not built in the driver for the joins by list, set and pair: only block counts may be."""
    rng = random.Random(5)
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(30)]
    docs = spark.createDataFrame([(i, own[i % 30] + (f" end{i}" if i >= 30 else "")) for i in range(60)], "doc_id long, text string")
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = max(ran.apply(i).executionId() for i in range(ran.size())) + 1
    rows = {r.doc_id: r.component_id for r in jaccard.join(docs, jaccard.Measure(3, 90, 100)).collect()}
    assert rows == {i: i % 30 for i in range(60)}
    assert _broadcasts(spark, since) <= 2


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars on their least nodes are components as they are, in either direction; others take rounds."""
    names = []
    real = components.written
    monkeypatch.setattr(components, "written", lambda df, name, *a: (names.append(name), real(df, name, *a))[1])

    def found(links):
        return {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}

    assert found([(1, 2), (3, 1), (1, 3), (9, 7), (5, 5)]) == {2: 1, 3: 1, 9: 7} and names == ["links"]
    names.clear()
    assert found([(3, 1), (3, 2)]) == {2: 1, 3: 1} and "stars" in names
    assert found([(i, i + 1) for i in range(20)] + [(40, 30), (40, 31)]) == {i: 0 for i in range(1, 21)} | {31: 30, 40: 30}
    assert found([]) == {}
