"""Queries that curate tables: de-duplication, similarity, splits, samples, joins, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import text
from qaloom.operators import agreement, audits, curation, metrics, ranking, similarity
from qaloom.plans import sql as Q
from qaloom.plans import tables as T
from qaloom.plans.registry import query
from qaloom.session import checkpoint

# The test vectors are spread out: this threshold leaves enough pairs to check.
SIMILAR = 0.3

_UNIT_VECTORS = """
vectors AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
unit AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM vectors)"""
_PAIRS = f"""{_UNIT_VECTORS},
pairs AS (SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, list_inner_product(a.v, b.v) AS cosine
  FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query("p1_exact_dedup", "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY text")
def p1(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return curation.dedup_exact(docs, "text", "doc_id").select("doc_id", "lang", "n_chars")


@query("j9_similar_pairs", f"WITH {_PAIRS} SELECT label, id_a, id_b, round(cosine, 6) AS cosine, 1::BIGINT AS n_pairs FROM pairs WHERE cosine > {SIMILAR}")
def j9(spark, sf):
    found = similarity.similar_pairs(T.table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"], SIMILAR)
    return found.withColumn("cosine", F.round("cosine", 6))


_LEVELS = [0.3, 0.4, 0.5]


@query(
    "g26_near_dup_counts",
    f"""WITH {_PAIRS} SELECT label, n_rows, count(*) AS n_pairs, round(max(cosine), 6) AS max_cosine,
    {", ".join(f"count(*) FILTER (WHERE cosine > {t}) AS above_{str(t).replace('.', '_')}" for t in _LEVELS)}
    FROM pairs JOIN (SELECT label, count(*) AS n_rows FROM unit GROUP BY label) USING (label) GROUP BY label, n_rows""",
)
def g26(spark, sf):
    out = similarity.near_duplicate_counts(
        T.table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"], _LEVELS
    )
    return out.withColumn("max_cosine", F.round("max_cosine", 6))


@query(
    "g28_centroids",
    """WITH dims AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
    c AS (SELECT label, dim, avg(x) AS m FROM dims GROUP BY label, dim)
    SELECT a.label AS category_a, b.label AS category_b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS cosine
    FROM c a JOIN c b USING (dim) GROUP BY a.label, b.label""",
)
def g28(spark, sf):
    out = similarity.centroid_cosines(T.table(spark, sf, "embeddings"), "label", "embedding")
    return out.withColumn("cosine", F.round("cosine", 6))


def _greedy(threshold: float) -> str:
    return f"""WITH RECURSIVE {_PAIRS},
    near AS (SELECT id_b, list(id_a) AS earlier FROM pairs WHERE cosine > {threshold} GROUP BY id_b),
    numbered AS (SELECT vec_id AS id, label, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r
      FROM embeddings LEFT JOIN near ON id_b = vec_id),
    walk AS (SELECT label, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT label FROM embeddings)
      UNION ALL SELECT w.label, n.r, CASE WHEN len(list_intersect(n.earlier, w.kept)) = 0 THEN list_append(w.kept, n.id) ELSE w.kept END
      FROM walk w JOIN numbered n ON n.label = w.label AND n.r = w.r + 1)
    SELECT label, unnest(arg_max(kept, r)) AS vec_id FROM walk GROUP BY label"""


@query("p2_greedy_dedup", _greedy(SIMILAR))
def p2(spark, sf):
    out = similarity.dedup_greedy(T.table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"], SIMILAR)
    return out.select("label", "vec_id")


_STRICTER = [0.25, 0.35]


@query(
    "p3_stricter_dedup",
    " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, (SELECT count(*) FROM embeddings) - count(*) AS n_dropped FROM ({_greedy(t)})"
        for t in _STRICTER
    ),
)
def p3(spark, sf):
    vectors = T.table(spark, sf, "embeddings")
    out = None
    for threshold in _STRICTER:
        kept = similarity.dedup_greedy(vectors, "vec_id", "embedding", ["label"], threshold)
        dropped = vectors.select("vec_id").join(kept.select("vec_id"), "vec_id", "left_anti")
        part = dropped.groupBy(F.lit(threshold).alias("threshold")).agg(F.count(F.lit(1)).alias("n_dropped"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p4_oneshot_dedup", f"WITH {_PAIRS} SELECT label, vec_id FROM embeddings WHERE vec_id NOT IN (SELECT id_b FROM pairs WHERE cosine > {SIMILAR})")
def p4(spark, sf):
    out = similarity.dedup_one_shot(T.table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"], SIMILAR)
    return out.select("label", "vec_id")


@query("p5_stratified_split", f"WITH {Q.SPLIT} SELECT doc_id, lang, split FROM split_docs")
def p5(spark, sf):
    return T.split_documents(spark, sf).select("doc_id", "lang", "split")


_BY_DRAW = "row_number() OVER (PARTITION BY {by} ORDER BY {draw}, {key})"


@query(
    "p6_stratified_sample",
    f"SELECT doc_id, source, r AS rank FROM (SELECT doc_id, source, {_BY_DRAW.format(by='source', draw=Q.draw('sample', 'doc_id'), key='doc_id')} AS r FROM documents) WHERE r <= 20",
)
def p6(spark, sf):
    out = curation.stratified_sample(T.table(spark, sf, "documents"), "source", "doc_id", 20)
    return out.select("doc_id", "source", F.col("rank").cast("bigint").alias("rank"))


@query(
    "p7_balanced_sample",
    f"""WITH r AS (SELECT doc_id, quality, {_BY_DRAW.format(by='quality', draw=Q.draw('balance', 'doc_id'), key='doc_id')} AS r FROM labels),
    n AS (SELECT least(40, count(*) FILTER (WHERE quality = 0)) AS n0 FROM labels)
    SELECT doc_id, quality FROM r, n WHERE r <= CASE WHEN quality = 0 THEN n0 ELSE 100 - n0 END""",
)
def p7(spark, sf):
    rows = T.table(spark, sf, "labels")
    return curation.balanced_sample(rows, "quality", "doc_id", 40, 100, first=0).select("doc_id", "quality")


@query("p8_capped_sample", f"SELECT o_orderkey FROM orders ORDER BY {Q.draw('cap', 'o_orderkey')}, o_orderkey LIMIT 100")
def p8(spark, sf):
    return curation.capped_sample(T.table(spark, sf, "orders"), "o_orderkey", 100).select("o_orderkey")


@query("p9_shuffle", f"SELECT o_orderkey, row_number() OVER (ORDER BY {Q.draw('shuffle', 'o_orderkey')}, o_orderkey) - 1 AS rank FROM orders")
def p9(spark, sf):
    """Ranks rather than a sort, so that the order itself is part of the result."""
    return ranking.ranked(T.table(spark, sf, "orders"), [], "o_orderkey", "shuffle").select("o_orderkey", "rank")


@query(
    "p11_blind_sheet",
    f"SELECT row_number() OVER (ORDER BY {Q.draw('sheet', 'doc_id')}, doc_id) AS id, doc_id, quality FROM labels",
)
def p11(spark, sf):
    docs = T.table(spark, sf, "labels")
    sheet, key = curation.blind_sheet(docs, "doc_id", [], ["quality"])
    return sheet.select("id").join(key, "id").select("id", "doc_id", "quality")


@query(
    "p12_p13_set_operations",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 300), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 200)
    SELECT user_id, 'both' AS side FROM a WHERE user_id IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'first' FROM a WHERE user_id NOT IN (SELECT user_id FROM b)
    UNION ALL SELECT user_id, 'second' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""",
)
def p12(spark, sf):
    events = T.table(spark, sf, "events")
    a = events.where(F.col("value") > 300).select("user_id")
    b = events.where((F.col("event_type") == "error") & (F.col("value") > 200)).select("user_id")
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    out = None
    for name, part in parts.items():
        part = part.withColumn("side", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("p14_top_k", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def p14(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@query(
    "b25_category_order",
    f"""WITH {Q.PROMPTS} SELECT id, CASE category WHEN 'SYMBOLIC_TIME' THEN 0 WHEN 'SYMBOLIC_COUNT' THEN 1 WHEN 'SYMBOLIC_METADATA' THEN 2
    WHEN 'SEMANTIC' THEN 3 WHEN 'HYBRID' THEN 4 WHEN 'UNSUPPORTED' THEN 5 ELSE 99 END AS rank FROM prompts""",
)
def b25(spark, sf):
    rank = text.category_rank(F.col("category"), list(curation.TARGETS))
    return T.prompt_table(spark, sf).select("id", rank.alias("rank"))


_SPLIT_PROMPTS = f"""{Q.PROMPTS}, tagged AS ({Q.tagged('prompts')}),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {Q.draw('split', 'id')}, id) - 1 AS r, count(*) OVER (PARTITION BY category) AS n FROM tagged),
s AS (SELECT *, CASE WHEN r < floor(n * 0.70::DOUBLE) THEN 'train' WHEN r < floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r)"""
_OP = "CASE WHEN polarity = 'over' THEN '>' WHEN category = 'SYMBOLIC_TIME' THEN '<=' ELSE '<' END"
_QUOTA = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in curation.TARGETS.items()) + " END"
_ASSEMBLE = f"""{_SPLIT_PROMPTS},
chosen AS (SELECT * EXCLUDE (r), rank FROM (
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rank FROM s WHERE split = 'test' AND starts_with(category, 'SYMBOLIC') AND params IS NOT NULL
    UNION ALL SELECT *, row_number() OVER (PARTITION BY category ORDER BY {Q.draw('bench', 'id')}, id) AS rank FROM s WHERE split = 'test' AND NOT starts_with(category, 'SYMBOLIC'))
  WHERE rank <= {_QUOTA}),
ruled AS (SELECT *, category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') AS ruled, coalesce(polarity IN ('under', 'over'), false) AS usable FROM chosen),
kept AS (SELECT id, category, prompt, params, polarity, rank, 'kept' AS origin FROM ruled WHERE NOT ruled OR usable),
gaps AS (SELECT category, rank, row_number() OVER (PARTITION BY category ORDER BY rank) AS gap FROM ruled WHERE ruled AND NOT usable),
pool AS (SELECT arg_min(category, id) AS category, prompt, min(id) AS id, arg_min(params, id) AS params, arg_min(polarity, id) AS polarity
  FROM tagged WHERE category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') AND polarity IN ('under', 'over') AND prompt NOT IN (SELECT prompt FROM kept) GROUP BY prompt),
spare AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {Q.draw('bench', 'id')}, id) AS gap FROM pool),
replaced AS (SELECT p.id, p.category, p.prompt, p.params, p.polarity, g.rank, 'replaced' AS origin FROM spare p JOIN gaps g USING (category, gap)),
bench AS (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'SYMBOLIC_TIME' THEN 0 WHEN 'SYMBOLIC_COUNT' THEN 1 WHEN 'SYMBOLIC_METADATA' THEN 2
    WHEN 'SEMANTIC' THEN 3 WHEN 'HYBRID' THEN 4 ELSE 5 END, rank) - 1 AS conversation_idx FROM (SELECT * FROM kept UNION ALL SELECT * FROM replaced))"""


@query(
    "p10_assemble",
    f"""WITH {_ASSEMBLE} SELECT id, category AS top_category, prompt, origin, conversation_idx,
    CASE WHEN category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') THEN substr(params, 1, length(params) - 1) || ', "operator": "' || {_OP} || '"}}' ELSE params END AS params,
    CASE WHEN category IN ('SYMBOLIC_TIME', 'SYMBOLIC_COUNT') THEN (['clear_yes', 'clear_no', 'boundary'])[((rank - 1) % 3)::INTEGER + 1]
      WHEN category = 'SYMBOLIC_METADATA' THEN CASE json_extract_string(params, '$.subtype') WHEN 'tag' THEN CASE WHEN conversation_idx % 2 = 0 THEN 'tag_present' ELSE 'tag_absent' END
        WHEN 'channel' THEN CASE WHEN conversation_idx % 2 = 0 THEN 'channel_match' ELSE 'channel_mismatch' END ELSE CASE WHEN conversation_idx % 2 = 0 THEN 'notes_present' ELSE 'notes_absent' END END
      WHEN category = 'UNSUPPORTED' THEN 'unanswerable' ELSE 'standard' END AS scenario FROM bench""",
)
def p10(spark, sf):
    # The prompt table is a stored table in practice; here it is written once and read as one.
    rows = checkpoint(T.prompt_table(spark, sf).withColumnRenamed("category", "top_category"))
    split = curation.stratified_split(rows, "top_category", "id")
    out = curation.assemble_benchmark(split.where(F.col("split") == "test"), rows, "id")
    out = out.withColumn("conversation_idx", F.col("conversation_idx").cast("bigint"))
    return out.select("id", "top_category", "prompt", "origin", "conversation_idx", "params", "scenario")


@query(
    "j1_j2_key_joins",
    """SELECT doc_id, a, b, source FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'YES' ELSE 'NO' END AS a, CASE toxic WHEN 1 THEN 'YES' ELSE 'NO' END AS b FROM labels) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""",
)
def j1(spark, sf):
    rows = T.table(spark, sf, "labels")

    def sheet(column: str):
        said = F.when(F.col(column) == 1, " yes ").otherwise("no")
        return rows.select("doc_id", said.alias("label"))

    both = agreement.paired_labels(sheet("quality"), sheet("toxic"), "doc_id", "label", ["YES", "NO"])
    return both.join(T.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")


@query("j3_fallback_key", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j3(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return agreement.join_answer_key(docs, T.table(spark, sf, "labels"), "source_idx", "doc_id").select("doc_id", "lang", "quality")


@query("j4_counted_alignment", "SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def j4(spark, sf):
    """Two files that were aligned by row position are joined on their key instead."""
    return metrics.aligned(
        T.table(spark, sf, "labels").select("doc_id", "quality"),
        T.table(spark, sf, "documents").select("doc_id", "n_chars").join(T.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"),
        "doc_id",
    )


@query(
    "j7_holdout_anti",
    f"""WITH {Q.SPLIT}, seen AS (SELECT trim(lower(text)) AS t FROM split_docs WHERE split <> 'test' UNION SELECT trim(lower(text)) FROM benchmark)
    SELECT doc_id FROM split_docs WHERE split = 'test' AND trim(lower(text)) NOT IN (SELECT t FROM seen)""",
)
def j7(spark, sf):
    docs = T.split_documents(spark, sf)
    seen, held = docs.where(F.col("split") != "test"), docs.where(F.col("split") == "test")
    return curation.remove_seen(held, "text", seen, T.table(spark, sf, "benchmark")).select("doc_id")


@query("j8_sampled_ids", f"SELECT event_id, value FROM events WHERE user_id IN (SELECT o_custkey FROM orders ORDER BY {Q.draw('cap', 'o_orderkey')}, o_orderkey LIMIT 500)")
def j8(spark, sf):
    sample = curation.capped_sample(T.table(spark, sf, "orders"), "o_orderkey", 500)
    chosen = sample.select(F.col("o_custkey").alias("user_id"))
    return T.table(spark, sf, "events").join(chosen, "user_id", "left_semi").select("event_id", "value")


@query("p13_exact_overlap", f"WITH {Q.SPLIT} SELECT DISTINCT md5(text) AS digest FROM split_docs WHERE split = 'train' AND text IN (SELECT text FROM split_docs WHERE split = 'test')")
def p13(spark, sf):
    docs = T.split_documents(spark, sf)
    both = audits.exact_overlap(docs.where(F.col("split") == "train"), docs.where(F.col("split") == "test"), "text")
    return both.select(F.md5("text").alias("digest"))
