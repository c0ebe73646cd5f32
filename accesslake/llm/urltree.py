"""Address filter by a tree of path templates and labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslake.llm.common import written

ANY = "*"
SIMILAR = "~"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first ``://`` and the next ``/ ? #``, A-Z lower-cased, and then up to ``? #``; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (its text, verdict) that fits a host or a domain above it and the start of the path; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def templates(addresses: DataFrame, depth: int = 8, min_children: int = 8, min_labels: int = 4, z: float = 2.0) -> DataFrame:
    """``host, path, template`` for each distinct pair of ``addresses`` (``host, path, n, known, good``).

    Level by level, a node's children with fewer than ``min_labels`` labels, too few to tell them apart, become one
    wildcard if the node has ``min_children`` or more, and no branch of their own otherwise. All others are tested,
    however small their share of the node: those whose labelled share of good ones differs from that of all
    the node's children by less than ``z`` standard errors are merged into one branch. Segments after ``depth - 1``
    count as one. Each level groups all nodes of all hosts at once and is written as a table, so no host is one task's.
    """
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    last = F.array(F.array_join(F.slice("parts", depth, F.greatest(F.size("parts") - depth + 1, F.lit(1))), "/"))
    state = addresses.withColumn("parts", parts).withColumn("parts", F.when(F.size("parts") > depth, F.concat(F.slice("parts", 1, depth - 1), last)).otherwise(F.col("parts")))
    state = written(state.withColumn("template", F.lit("")), "templates")
    levels = state.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(levels):
        part = F.get("parts", F.lit(level))
        inner = state.where(part.isNotNull())
        child = inner.groupBy("host", "template", part.alias("part")).agg(*(F.sum(c).alias(c) for c in ("n", "known", "good")))
        node = child.groupBy("host", "template").agg(F.count("*").alias("children"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "known", "good")))
        few = F.col("known") < min_labels
        rare = (F.col("children") >= min_children) & few
        share = (F.col("all_good") + 1) / (F.col("all_known") + 2)
        off = F.abs(F.col("good") - F.col("known") * share) / F.sqrt(F.greatest(F.col("known"), F.lit(1)) * share * (1 - share))
        frequent = child.join(node, ["host", "template"]).where(~rare)
        frequent = frequent.select("host", "template", "part", F.when((F.col("children") > 1) & (few | (off < z)), SIMILAR).otherwise(F.col("part")).alias("branch"))
        step = state.withColumn("part", part).join(frequent, ["host", "template", "part"], "left")
        grown = F.when(F.col("part").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("branch", F.lit(ANY))))
        state = written(step.select("host", "path", "n", "known", "good", "parts", grown.alias("template")), "templates")
    return state


def judge(pages: DataFrame, labels: DataFrame | None, rules: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url", prior_weight: float = 4.0, min_purity: float = 0.5, **tree) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row.

    A rule's verdict holds if one fits, the longest first. Otherwise the path's template decides: its labelled share of
    good pages, drawn towards that of all labelled pages by ``prior_weight`` of them, must reach ``min_purity``.
    ``labels`` has the id and ``good`` (0 or 1); several labels of an id count as their smallest, null ones as none.

    A null url has an empty host and path, which form a template of their own; null ids have no label; repeated rows
    are judged alike and each counts; an empty table gives no rows; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if labels is None:
        known = rows.withColumn("good", F.lit(None).cast("int"))
    else:
        known = rows.join(labels.where("good is not null").groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min("good").alias("good")), F.col("page_id") == F.col("_id"), "left").drop("_id")
    addresses = known.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("good").alias("known"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree_rows = templates(addresses, **tree)
    total = tree_rows.agg(F.sum("known").alias("known"), F.sum("good").alias("good")).first()
    prior = (total["good"] + 1) / (total["known"] + 2) if total["known"] else 1.0
    purity = (F.sum("good") + prior_weight * prior) / (F.sum("known") + prior_weight)
    judged = tree_rows.groupBy("host", "template").agg(purity.alias("purity"))
    address = tree_rows.select("host", "path", "template").join(judged, ["host", "template"]).select(F.col("host").alias("_host"), F.col("path").alias("_path"), "template", "purity")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    found = rows.join(address, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").withColumn("_rule", rule)
    own = F.when(F.col("purity") >= min_purity, "allow").otherwise("block")
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "template", "purity")
