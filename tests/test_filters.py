import itertools

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accesslake.operators import predicates as p
from accesslake.operators import ranking as k


def test_conditions_compose():
    assert p.compose_conditions([("a", "icontains", "x")]) == {"a__icontains": "x"}
    assert p.compose_conditions([("a", "icontains", "x"), ("a", "icontains", "y")]) == {"a__icontains_all": ["x", "y"]}
    assert p.compose_conditions([("a", "exact", 1), ("a", "exact", 2)]) == {"a": 2}
    assert p.compose_conditions([("", "icontains_any", ["a", "b"]), ("search", "icontains_any", "c")]) == {"search": "a|b,c"}


def test_blank_parameters():
    assert p.clean_params({"a": "", "b": None, "c": 0, "d": False, "e": " x "}) == {"c": 0, "d": False, "e": "x"}


def test_quick_filters_merge():
    active = p.merge_filters([{"a": 1}, {"b": 2, "c": 3}], {"c": 4})
    assert active == [{"a": 1}, {"c": 4}] and p.combined(active) == {"a": 1, "c": 4}


def test_label_picks():
    assert p.parse_labels("k:a,k:b,k:*") == {"k": None}
    assert p.parse_labels("k:*,k:a,j:x") == {"k": ["a"], "j": ["x"]}
    assert p.parse_labels("k:a,k:a") == {}


def test_null_matches_no_positive_condition(spark):
    df = spark.createDataFrame([(None,), ("ab",)], ["s"])

    def kept(how, value):
        return [r.s for r in df.where(p.match(F.col("s"), how, value)).collect()]

    assert kept("exact", "ab") == kept("in", ["ab"]) == kept("contains", "a") == kept("regex", "^a") == ["ab"]
    assert kept("not", "ab") == kept("exclude", "a") == [None]


def test_m2m(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, [])], "id int, l array<string>")
    assert [r.id for r in df.where(p.match(F.col("l"), "m2m", ["a", "b"])).collect()] == [1, 2]
    assert [r.id for r in df.where(p.match(F.col("l"), "m2m_all", ["a", "b"])).collect()] == [1]


def test_rule_documents(spark):
    df = spark.range(5)
    assert p.match_rules(df, {"type": "all"}, "id").count() == 5
    assert p.match_rules(df, {"type": "ids", "ids": [1, 9]}, "id").count() == 1
    assert p.match_rules(df, {"type": "ids", "ids": []}, "id").count() == 0
    assert p.match_ids(df, spark.createDataFrame([(1,), (1,), (7,)], ["id"]), "id").count() == 1


def test_offered_operators():
    rule = {"type": "attrs", "attrs": [{"name": "ip", "match": "ip_in", "value": ["*"]}]}
    assert p.check_rule(rule, {"ip": "ip"}) is rule
    for kind in ("str", "bool", "select"):
        try:
            p.check_rule(rule, {"ip": kind})
            raise AssertionError
        except ValueError:
            pass


def test_permission_expression(spark):
    df = spark.createDataFrame([(["a|b", "c"], ["b", "c"]), (["a & b"], ["a"]), ([], [])], "r array<string>, g array<string>")
    assert [x[0] for x in df.select(p.has_perms(F.col("r"), F.col("g"))).collect()] == [True, False, True]


def test_keyword_is_case_sensitive(spark):
    df = spark.createDataFrame([("Abc", 1), ("abc", 12), (None, 3)], ["s", "n"])
    assert p.search_any(df, "A").count() == 1 and p.search_any(df, "1").count() == 2


WORDS = st.text(alphabet="ab%_.*", min_size=1, max_size=3)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(WORDS, min_size=1, max_size=2), min_size=1, max_size=2))
def test_search_batches_are_literal(spark, batches):
    rows = [("".join(x), "".join(y)) for x, y in itertools.product(["ab", "A.b", "a*", "%_", "bb"], ["x", "B%", "a_"])]
    df = spark.createDataFrame(rows, ["x", "y"])
    got = {tuple(r) for r in df.where(p.search_batches(",".join("|".join(b) for b in batches), ["x", "y"])).collect()}
    want = {r for r in rows if all(any(w.lower() in c.lower() for w in b for c in r) for b in batches)}
    assert got == want


def test_sort_parameter():
    assert k.sort_parameter("a", "descending") == "-a"
    assert k.sort_parameter("a", "ascending") == "a"
    assert k.sort_parameter("a", None) is None


def test_pages_cover_the_listing(spark, tables):
    rows = tables.part.select("p_partkey", "p_size")
    shown = [r.p_partkey for n in range(1, 5) for r in k.page(rows, n, 50, "-p_size", "p_partkey").collect()]
    assert shown == [r.p_partkey for r in rows.orderBy(F.desc("p_size"), "p_partkey").collect()]
    assert [r.p_partkey for r in k.page_after(rows, "p_partkey", 10, 3).collect()] == [11, 12, 13]
