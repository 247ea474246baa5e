"""Properties, checked on generated data."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from supplyscope.operators.links import with_requisition, without_requisition
from supplyscope.operators.lookups import first_row, left_join_split, require_unique

keys = st.lists(st.one_of(st.none(), st.integers(0, 6)), max_size=25)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@SETTINGS
@given(left=keys, right=keys)
def test_left_join_split_equals_left_join(spark, left, right):
    l = spark.createDataFrame([(k, i) for i, k in enumerate(left)], "k long, a long")
    r = spark.createDataFrame([(k, 100 + i) for i, k in enumerate(right)], "k long, b long")
    want = _rows(l.join(r, "k", "left").select("k", "a", "b"))
    assert _rows(left_join_split(l, r, ["k"]).select("k", "a", "b")) == want
    assert _rows(left_join_split(l, r, ["k"], right_keys=r.select("k")).select("k", "a", "b")) == want


@SETTINGS
@given(ship=keys, req=keys)
def test_anti_union_semi_is_the_input(spark, ship, req):
    s = spark.createDataFrame([(k, i) for i, k in enumerate(ship)], "line_location_id long, i long")
    q = spark.createDataFrame([(k,) for k in req], "line_location_id long")
    both = _rows(without_requisition(s, q).unionByName(with_requisition(s, q)))
    assert both == _rows(s)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 4), st.text("ab", max_size=2)), max_size=20))
def test_unique_lookup_keeps_row_count(spark, rows):
    lk = spark.createDataFrame(rows, "k long, v string")
    probe = spark.createDataFrame([(i % 6,) for i in range(12)], "k long")
    dedup = first_row(lk, ["k"], ["v"])
    assert require_unique(dedup, ["k"]).count() == 0
    assert probe.join(dedup, "k", "left").count() == probe.count()


def test_branches_disjoint_and_ladders_total(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from supplyscope.plans.orders import po_without_requisition
    from supplyscope.plans.receiving import receiving_diagnosis
    from supplyscope.sources.roles import role_tables
    from tests.conftest import SF0001

    t = role_tables(spark, SF0001)
    std = po_without_requisition(t, "01/01/1990", "31/12/2030", dt.date(1996, 6, 1), "STANDARD")
    rel = po_without_requisition(t, "01/01/1990", "31/12/2030", dt.date(1996, 6, 1), "RELEASE")
    std_types = {r[0] for r in std.select("tipo_documento").distinct().collect()}
    rel_types = {r[0] for r in rel.select("tipo_documento").distinct().collect()}
    assert std_types and rel_types and not (std_types & rel_types)
    assert all(x.startswith("STANDARD") for x in std_types) and rel_types <= {"BLANKET", "PLANNED"}
    ri = receiving_diagnosis(t, sort=False)
    cols = ["status_analitico", "sugestao_acao", "flag_recebimento", "flag_oc", "flag_item_ativo",
            "flag_precisa_oc", "flag_hold"]
    nulls = ri.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first().asDict()
    assert all(v == 0 for v in nulls.values()), nulls


pairs = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 2))),
                 max_size=20)


@SETTINGS
@given(left=pairs, right=pairs)
def test_left_join_split_two_column_keys(spark, left, right):
    l = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(left)], "k1 long, k2 long, x long")
    r = spark.createDataFrame([(a, b, 100 + i) for i, (a, b) in enumerate(right)], "k1 long, k2 long, y long")
    want = _rows(l.join(r, ["k1", "k2"], "left").select("k1", "k2", "x", "y"))
    got = left_join_split(l, r, ["k1", "k2"], right_keys=r.select("k1", "k2")).select("k1", "k2", "x", "y")
    assert _rows(got) == want
