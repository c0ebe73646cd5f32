import json

from pyspark.sql import functions as F

from accesslake.operators import nested

ROWS = [
    (1, '{"a": {"b": 1, "c": {"d": "x"}}, "e": [1, {"f": 2}], "g": {}, "h": null}'),
    (2, '{"a": "text", "z": {"y": {"x": {"w": true}}}}'),
    (3, "no json"), (4, None), (5, "17"), (6, "{}"), (7, "[]"), (8, "null"),
]


def flat(value, path=""):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flat(v, f"{path}.{k}" if path else k)]
    return [(path, json.dumps(value, separators=(",", ":")))]


def objects(spark, rows):
    return spark.createDataFrame(rows, "id int, text string").select("id", nested.from_json_text(F.col("text")).alias("value"), F.lit("kept").alias("path_"))


def test_leaves(spark):
    got = sorted((r.id, r.path, r.value) for r in nested.leaves(objects(spark, ROWS), "value").collect())
    assert got == sorted((i, *leaf) for i, t in ROWS if i not in (3, 4) for leaf in flat(json.loads(t)))
    texts = nested.leaves(objects(spark, ROWS), "value").where("text")
    assert sorted((r.id, r.path) for r in texts.collect()) == [(1, "a.c.d"), (2, "a")]


def test_differences(spark):
    base = [(1, '{"a": {"b": 1, "c": {"d": "y"}}, "e": [1, {"f": 2}], "g": {"k": 1}, "gone": 1}'), (2, '{"a": {"q": 1}, "z": {"y": {"x": {"w": true}}}}'), (6, "{}")]
    got = {(r.id, r.path, r.value) for r in nested.object_diff(objects(spark, ROWS), objects(spark, base), "id", "value").collect()}
    assert got == {(1, "a.c.d", '"x"'), (1, "g", "{}"), (1, "h", "null"), (2, "a", '"text"'), (5, "", "17"), (7, "", "[]"), (8, "", "null")}


def test_missing_keys_of_maps(spark):
    rows = [({"a": {"b": "x"}, "c": {"d": "y"}},), ({"a": {"e": "z", "n": None}},)]
    base = spark.createDataFrame(rows, "m map<string,map<string,string>>").select(nested.from_map(F.col("m")).alias("o"))
    target = spark.createDataFrame([({"c": {"d": "other"}},)], "m map<string,map<string,string>>").select(nested.from_map(F.col("m")).alias("o"))
    assert sorted(tuple(r) for r in nested.missing_keys(base, target, "o").collect()) == [("a.b", '"x"'), ("a.e", '"z"')]
    assert nested.missing_keys(base.limit(0), target, "o").collect() == []
