"""Compiled predicates against a plain evaluator of the same rules."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from entrywise.plans import compile as C
from entrywise.plans.ast import And, Bits, Cmp, Elem, Exists, In, Not, Or, Regex

ROWS = [
    (i, size, name, ost, acl)
    for i, (size, name, ost, acl) in enumerate(
        (s, n, o, a)
        for s in (None, 0, 5, 9)
        for n in (None, "ab", "b\n")
        for o in (None, [], [1, 5])
        for a in (None, [], [(1, 4), (2, 3)])
    )
]
OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
BITS = {"any_set": lambda a, m: a & m != 0, "all_set": lambda a, m: a & m == m, "any_clear": lambda a, m: a & m != m, "all_clear": lambda a, m: a & m == 0}
DUAL = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "any_set": "all_clear", "all_set": "any_clear", "any_clear": "all_set", "all_clear": "any_set"}
AT = {"statx.size": 1, "name": 2, "xattrs.ost": 3, "xattrs.acl_users": 4}


def holds(node, row, negate=False):
    if isinstance(node, Not):
        return holds(node.part, row, not negate)
    if isinstance(node, (And, Or)):
        each = [holds(p, row, negate) for p in node.parts]
        return all(each) if isinstance(node, And) != negate else any(each)
    value = row[AT[node.field]]
    values = value if isinstance(value, list) else [] if value is None else [value]
    if isinstance(node, Exists):
        return (value is not None) == (node.present != negate)
    if isinstance(node, Bits) or (isinstance(node, Cmp) and node.op != "="):
        op = DUAL[node.op] if negate else node.op
        return any((BITS[op](v, node.mask) if isinstance(node, Bits) else OPS[op](v, node.value)) for v in values)
    if isinstance(node, Cmp):
        found = node.value in values
    elif isinstance(node, In):
        found = any(v in node.values for v in values)
    elif isinstance(node, Regex):
        found = any(re.search(node.pattern, v, re.S | (re.I if node.insensitive else 0)) for v in values)
    else:
        found = any(all((BITS if op in BITS else OPS)[op](v["id p".split().index(m)], x) for op, m, x in node.parts) for v in values)
    return found != negate


numbers = st.sampled_from([0, 1, 4, 5, 6])
leaf = st.one_of(
    st.builds(Cmp, st.sampled_from(list(OPS)), st.sampled_from(["statx.size", "xattrs.ost"]), numbers),
    st.builds(Bits, st.sampled_from(list(BITS)), st.sampled_from(["statx.size", "xattrs.ost"]), numbers),
    st.builds(In, st.sampled_from(["statx.size", "xattrs.ost"]), st.lists(numbers, max_size=2).map(tuple)),
    st.builds(Exists, st.sampled_from(list(AT)), st.booleans()),
    st.builds(Regex, st.just("name"), st.sampled_from(["^a", "B", "b.", "^b.$"]), st.booleans()),
    st.builds(Elem, st.just("xattrs.acl_users"), st.lists(st.tuples(st.sampled_from(["=", ">=", "all_set"]), st.sampled_from(["id", "p"]), numbers), min_size=1, max_size=2).map(tuple)),
)
trees = st.recursive(leaf, lambda c: st.one_of(st.builds(Not, c), st.builds(And, st.lists(c, min_size=1, max_size=3).map(tuple)), st.builds(Or, st.lists(c, min_size=1, max_size=3).map(tuple))), max_leaves=6)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "i int, size long, name string, ost array<long>, acl_users array<struct<id:long,p:long>>").coalesce(1).cache()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(trees, min_size=4, max_size=4))
def test_same_rows_as_the_plain_evaluator(table, nodes):
    got = table.select("i", *[C.holds(n).alias(f"c{k}") for k, n in enumerate(nodes)]).collect()
    for r in got:
        for k, n in enumerate(nodes):
            assert r[f"c{k}"] == holds(n, ROWS[r["i"]]), (n, ROWS[r["i"]])


def test_filters_reach_the_scan(spark, sf):
    """A comparison of a stored column is pushed to parquet and so is a negated one."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("size"), "o_custkey")
    plan = df.where(C.compile_filter(Cmp(">", "statx.size", 10) & ~Cmp("=", "statx.size", 12)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,10)" in plan and "Or(IsNull(o_orderkey),Not(EqualTo(o_orderkey" in plan
