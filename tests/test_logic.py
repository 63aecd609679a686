import pytest
from pyspark.sql import functions as F

from rulespark.functions import logic as L
from rulespark.operators import evaluate as E
from rulespark.operators import graph as G
from rulespark.operators import relations as R

SIG = L.Signature({"a": "bool", "b": "bool", "n": "real", "s": "string"})


def truth(spark, f, a=None, b=None, n=None, s=None):
    return spark.createDataFrame([(a, b, n, s)], "a boolean, b boolean, n double, s string").select(SIG.compile(f).alias("v")).first()["v"]


@pytest.mark.parametrize("a,b,both,either", [(True, True, True, True), (True, False, False, True), (False, False, False, False), (None, True, None, True), (None, False, False, None), (None, None, None, None)])
def test_kleene(spark, a, b, both, either):
    x, y = L.eq("a", True, "bool"), L.eq("b", True, "bool")
    assert truth(spark, L.all_of(x, y), a, b) is both and truth(spark, L.any_of(x, y), a, b) is either
    assert truth(spark, L.negate(x), a) is (None if a is None else not a)


def test_ranges_and_unknowns(spark):
    f = {"op": "in_binned_range", "left": {"symbol": "n"}, "right": {"literal": "[1,2)", "type": "string"}}
    assert [truth(spark, f, n=v) for v in (1.0, 2.0, 0.5, None, float("nan"))] == [True, False, False, None, None]
    assert truth(spark, {**f, "right": {"literal": "odd", "type": "string"}}, n=1.0) is None
    assert truth(spark, L.gt("gone", 1, "real")) is None
    assert truth(spark, {"op": "is_null", "arg": {"symbol": "s"}}) is True


@pytest.mark.parametrize("f,code", [(L.gt("s", 1, "real"), "TYPE_MISMATCH"), ({"op": "and", "args": []}, "EMPTY_LOGIC"), (L.eq("n", "x", "real"), "TYPE_MISMATCH"), (L._cmp("like")("s", "x", "string"), "UNSUPPORTED_OPERATOR"), (L.eq("n", 1, "date"), "UNSUPPORTED_VALUE_TYPE")])
def test_refusals(f, code):
    with pytest.raises(L.Refused) as e:
        SIG.compile(f)
    assert e.value.code == code


def test_arithmetic(spark):
    df = spark.createDataFrame([(7.0, 0.0), (-7.0, 3.0), (7.0, -3.0), (None, 1.0)], "x double, y double")
    v = lambda t: [r[0] for r in df.select(L.arithmetic(t, {"x", "y"})).collect()]
    assert v("x / y")[0] is None and v("x % y")[1:3] == [2.0, -2.0]
    assert v("greater of(x, y) times 2") == [14.0, 6.0, 14.0, None]
    assert v("1,000 + abs(x)") == [1007.0, 1007.0, 1007.0, None]
    for bad in ("__import__('os')", "x if y else 1", "z + 1", "x +"):
        with pytest.raises(L.Refused):
            L.arithmetic(bad, {"x", "y"})


def test_aggregate_kleene(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, True), (3, None), (3, False)], "g int, v boolean")
    got = {r.g: (r.all, r.any) for r in df.groupBy("g").agg(L.kleene_all(F.col("v")).alias("all"), L.kleene_any(F.col("v")).alias("any")).collect()}
    assert got == {1: (None, True), 2: (True, True), 3: (False, None)}


def test_unsupported_policy(spark):
    with pytest.raises(L.Refused):
        E.decide(spark.range(1), [], SIG, "x", "COLLECT")


def test_scopes(spark):
    df = spark.createDataFrame([({"s": ["a"]}, {"s": ["b"]}), ({"s": ["a"]}, {"t": ["b"]}), ({"s": []}, {"s": ["b"]}), ({"s": ["a", "b"]}, {"s": ["b"]})], "a map<string,array<string>>, b map<string,array<string>>")
    assert [r[0] for r in df.select(R.scopes_overlap(F.col("a"), F.col("b"))).collect()] == [False, True, True, True]


def test_graph_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (6, 7), (7, 7)], "source long, target long")
    n = spark.range(1, 9).withColumnRenamed("id", "node")
    assert {r.node: r.component for r in G.components(e, n).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}
    assert {(r.node, r.cycle) for r in G.cycles(e).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {(r.node, r.level) for r in G.reach(e, n.where("node = 2")).collect()} == {(2, 0), (3, 1), (1, 2), (4, 2)}
