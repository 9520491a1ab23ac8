"""Every named query against its SQL twin, and the shape of its plan."""

import re

import pytest
from check_oracle import compare, oracle_connection
from conftest import SF_TINY

import __spark_entry__ as entry
from stepfall.plans import catalog, oracle


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_TINY)


def test_every_query_has_a_twin_or_a_reason():
    assert set(oracle.SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(oracle.SQL) == set()
    assert catalog.QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], oracle.SQL[name], SF_TINY) == []


@pytest.fixture()
def no_automatic_broadcast(spark):
    """Plans as they are when no table is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


SLOW = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
        "ExistingRDD")
STORED = "/stepfall/"        # what cut() wrote: folded rows


def children(node):
    kids = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "AdaptiveSparkPlan":
        kids = [node.executedPlan()]
    return kids


def walk(node):
    yield node
    for kid in children(node):
        yield from walk(kid)


def raw_tables(node):
    """Scans of given tables whose rows reach ``node`` without being aggregated on the way."""
    name = node.nodeName()
    if "Aggregate" in name:
        return []
    if name.startswith(("Scan", "BatchScan", "FileScan")) and STORED not in node.toString():
        return [node.toString().split("\n")[0]]
    return [x for kid in children(node) for x in raw_tables(kid)]


def by_case_alone(node):
    return node.nodeName() == "Exchange" and re.match(
        r"Exchange hashpartitioning\(instance_id#\d+, \d+\)", node.toString().split("\n")[0])


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan_has_no_slow_node_and_no_raw_shuffle_by_case(spark, no_automatic_broadcast, name):
    plan = catalog.QUERIES[name](spark, SF_TINY)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert not [node for node in SLOW if node in text]
    for node in walk(plan):
        if by_case_alone(node):                      # only folded rows move by case
            assert raw_tables(node) == []


def test_the_plan_check_sees_a_raw_shuffle(spark, no_automatic_broadcast):
    from stepfall.sources.retail import ClickWarehouse
    w = ClickWarehouse(spark, SF_TINY)
    raw = w.raw_events.repartition("instance_id").select("instance_id")
    by_user = w.raw_events.groupBy("instance_id", "user_id").count().repartition("instance_id")
    for df, found in ((raw, 1), (by_user, 0)):
        nodes = [n for n in walk(df._jdf.queryExecution().executedPlan()) if by_case_alone(n)]
        assert len(nodes) == 1 and len(raw_tables(nodes[0])) == found


def test_flagship_reads_only_what_it_needs(spark):
    plan = catalog.QUERIES["order_severity_scan"](spark, SF_TINY) \
        ._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    lines = [re.sub(r"#\d+L?", "", s) for s in scans if "l_orderkey" in s]
    assert lines == ["l_orderkey,l_linenumber,l_returnflag,l_linestatus"]


def test_entry(spark):
    df = entry.entry(spark)
    assert "delta_pp" in df.columns and df.count() > 0
