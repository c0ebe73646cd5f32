"""The registered query of each operator, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from accesslake.llm.bitpack import read_documents, write_ids
from accesslake.llm.common import ORACLES, QUERIES, query
from accesslake.llm.kdtree import shard
from accesslake.llm.merkle import fold, leaf_of, proof_digest, prove
from accesslake.llm.minhash import near_duplicates as circulant_classes
from accesslake.llm.mixing import labelled_rows, mix
from accesslake.llm.packing import pack
from accesslake.llm.simhash import near_duplicates
from accesslake.llm.suffix import cut_texts
from accesslake.llm.topk import top_k
from accesslake.llm.toxicity import score, train
from accesslake.llm.trie import prefix_trie
from accesslake.llm.urltree import Rule, judge
from accesslake.llm.winnow import neighbours

__all__ = ["ORACLES", "QUERIES"]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_winnowing")
def op1(t):
    return neighbours(t.documents)


@query("op2_token_bits")
def op2(t):
    return read_documents(write_ids(t.documents, tokenizer("byte_bpe_50k.json"), end_id=0))


@query("op3_simhash_near_dedup")
def op3(t):
    found = near_duplicates(t.documents, radius=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("words")[0]), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_suffix_array_dedup")
def op4(t):
    text = F.coalesce("text", F.lit(""))
    whole = t.documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    cut = cut_texts(t.documents, length=400).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
    both = whole.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.lit(0).cast("long")
    return both.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op5_branch_and_bound_top_k", OP5)
def op5(t):
    return top_k(t.embeddings, F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op6_pu_toxicity")
def op6(t):
    return score(t.documents, train(t.documents, t.labels))


LANGUAGES = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


@query("op7_soft_membership_mixing")
def op7(t):
    labelled = labelled_rows(t.documents, t.labels.where("quality = 1"), "lang")
    rates, _, _ = mix(t.documents, labelled, LANGUAGES)
    return rates.select("doc_id", "tokens", *(F.round(F.get("p", F.lit(i)), 9).alias(f"p_{n}") for i, n in enumerate(LANGUAGES)), F.round("rate", 6).alias("rate"))


@query("op8_sum_of_squares_packing")
def op8(t):
    return pack(t.documents, tokenizer("word_bpe_49k.json"), end_id=2)


@query("op9_kd_tree_shards")
def op9(t):
    placed = shard(t.documents, shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


@query("op10_path_template_tree")
def op10(t):
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    return judge(t.pages, t.labels.select(F.col("doc_id").alias("page_id"), good.alias("good")), RULES)


#: The unsigned CRC-32 of a whole number's decimal text, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: CAST((ascii(c) >> i) & 1 AS BIGINT))))),
    lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295)"""
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def merkle_sql() -> str:
    """Leaves, seven levels of each language's tree and three above, as text of every run; then each leaf's way up."""

    def leaf(text):
        framed = (f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
        return f"sha256({' || '.join(framed)})"

    tampered = f"CASE WHEN {CRC32.format('doc_id')} % 3 = 0 THEN translate(text, '{CAPITALS}', '{SMALL}') ELSE text END"
    parts = [f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(tampered)} AS now FROM documents)"]
    parts.append("a0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n, doc_id, now FROM d)")
    way = "SELECT lang, pos, doc_id, h AS leaf, '' AS proof, now AS up FROM a0"

    def climb(name, levels, at, way):
        for k in range(levels):
            one = f"SELECT lang, pos // 8 AS pos, string_agg(h, '' ORDER BY pos) AS run, (n + 7) // 8 AS n FROM {name}{k} WHERE n > 1 GROUP BY lang, pos // 8, n"
            parts.append(f"{name}r{k} AS ({one})")
            parts.append(f"{name}{k + 1} AS (SELECT lang, pos, sha256(run) AS h, n FROM {name}r{k} UNION ALL SELECT lang, pos, h, n FROM {name}{k} WHERE n = 1)")
            place, step = f"({at} // {8**k}) % 8", f"{at} // {8 ** (k + 1)}"
            before, after = f"substr(run, 1, 64 * CAST({place} AS INT))", f"substr(run, 64 * CAST({place} AS INT) + 65)"
            way = f"SELECT w.* REPLACE (proof || coalesce({before} || {after}, '') AS proof, coalesce(sha256({before} || up || {after}), up) AS up) FROM ({way}) AS w LEFT JOIN {name}r{k} AS r ON r.lang IS NOT DISTINCT FROM w.lang AND r.pos = {step}"
        return way

    way = climb("a", 7, "w.pos", way)
    parts.append("t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, h AS subroot, count(*) OVER () AS n FROM a7)")
    parts.append("b0 AS (SELECT 0 AS lang, pos, subroot AS h, n FROM t)")
    way = f"SELECT 0 AS lang, t.pos, doc_id, leaf, proof, up, subroot FROM ({way}) AS x JOIN t ON t.lang IS NOT DISTINCT FROM x.lang"
    way = climb("b", 3, "w.pos", way)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, up AS folded_root, up = h AS verified FROM ({way}) AS x, b3"


@query("op11_butterfly_merkle_manifest", merkle_sql())
def op11(t):
    def leaf(text):
        return leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = F.when(touched, leaf(F.translate("text", CAPITALS, SMALL)))
    proved = prove(t.documents, leaf(F.col("text")), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "now": now})
    folded = fold(F.coalesce("now", "leaf"), F.col("proof"))
    result = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM w),
     n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM s),
     e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
     l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
     r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
     c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id
"""


@query("op12_circulant_minhash_near_dedup", OP12)
def op12(t):
    return circulant_classes(t.documents).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Rows of rebuilt conversations, each with a text of all turns up to its own, then nodes with the sums over what lies below.
OP13 = f"""
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM m)),
     lent AS (SELECT c.conv_id, count(m.place) AS n FROM c LEFT JOIN m ON m.conv_id = base AND place <= h GROUP BY c.conv_id),
     t AS (SELECT c.conv_id, place AS depth, role, text FROM c JOIN m ON m.conv_id = base AND place <= h
           UNION ALL SELECT c.conv_id, place - h + lent.n, role, text FROM c JOIN lent ON lent.conv_id = c.conv_id JOIN m ON m.conv_id = c.conv_id AND place > h),
     p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM t
           UNION ALL SELECT conv_id, 0, 0, '' FROM c),
     q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
     n AS (SELECT node, depth, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM q GROUP BY node, depth),
     k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
     o AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CAST(n_children IS NULL AS BIGINT) AS leaf, (n_convs - 1) * words AS saved FROM n LEFT JOIN k ON k.node = n.node),
     s AS (SELECT q.node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM o JOIN q ON q.conv_id = o.conv_id AND q.depth <= o.depth GROUP BY q.node)
SELECT o.conv_id, o.depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256
FROM o JOIN s ON s.node = o.node LEFT JOIN o AS u ON u.node = o.parent
"""


@query("op13_centroid_prefix_trie", OP13)
def op13(t):
    conv = F.col("conv_id")
    found = prefix_trie(t.conversations, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)
    return found.drop("node", "parent")
