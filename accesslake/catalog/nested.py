"""Queries over objects whose keys are only known from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.catalog.registry import query
from accesslake.operators import nested

HALF = "2024-01-16"


def _profiles(events):
    """One object per user: the types of its events by name, each with its count, its last ``props`` and a list of fixed words."""
    per_type = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id", "props")).alias("last"))
    entry = F.concat(F.lit('"'), "event_type", F.lit('":{"n":'), F.col("n").cast("string"), F.lit(',"tags":["'), "event_type", F.lit('",null],"last":'), F.coalesce("last.props", F.lit("null")), F.lit("}"))
    whole = per_type.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("types"))  # a user's few types
    return whole.select("user_id", nested.from_json_text(F.concat(F.lit('{"types":{'), "types", F.lit('},"none":{}}'))).alias("profile"))


@query(
    "nested_diff_variant",
    f"""WITH e AS (SELECT user_id, event_type, ts >= TIMESTAMP '{HALF}' AS late, count(*) AS n, arg_max(json_extract(props, '$.k'), (ts, event_id)) AS k FROM events GROUP BY ALL),
            p AS (SELECT user_id, late, 'types.' || event_type || '.n' AS path, n::VARCHAR AS value FROM e
                  UNION ALL SELECT user_id, late, 'types.' || event_type || '.tags', '["' || event_type || '",null]' FROM e
                  UNION ALL SELECT user_id, late, 'types.' || event_type || '.last.k', k::VARCHAR FROM e
                  UNION ALL SELECT DISTINCT user_id, late, 'none', '{{}}' FROM e)
       SELECT user_id, path, value FROM p WHERE late AND (user_id, path, value) NOT IN (SELECT (user_id, path, value) FROM p WHERE NOT late)""",
)
def nested_diff_variant(t):
    early, late = t.events.where(F.col("ts") < F.lit(HALF)), t.events.where(F.col("ts") >= F.lit(HALF))
    return nested.object_diff(_profiles(late), _profiles(early), "user_id", "profile")


@query(
    "catalog_missing_keys_variant",
    """WITH b AS (SELECT p_type || '.' || p_brand || '.' || replace(p_name, ' ', '_') AS path, p_name AS value FROM part WHERE p_size > 20),
            g AS (SELECT p_type || '.' || p_brand || '.' || replace(p_name, ' ', '_') AS path FROM part WHERE p_size <= 30 AND p_size % 2 = 0)
       SELECT path, '"' || min(value) || '"' AS value FROM b WHERE path NOT IN (SELECT path FROM g) GROUP BY path""",
)
def catalog_missing_keys_variant(t):
    """Catalogues of nested maps: type, brand, name to a text in the base and to a number in the target; sizes are no texts."""

    def catalogue(rows, value):
        names = F.create_map(F.translate("p_name", " ", "_"), value)
        return rows.select(nested.from_map(F.create_map("p_type", F.create_map("p_brand", names))).alias("catalogue"))

    base = catalogue(t.part.where("p_size > 20"), F.col("p_name")).union(catalogue(t.part.where("p_size < 5"), F.col("p_size")))
    return nested.missing_keys(base, catalogue(t.part.where("p_size <= 30 and p_size % 2 = 0"), F.col("p_retailprice")), "catalogue")
