"""The queries of the engine's own operators, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import convert as C
from quillwork.functions import text as T
from quillwork.functions import vectors as V
from quillwork.operators import contracts, fusion, knowledge, ledger, relational, summary, tagging, timeline
from quillwork.plans.views import CLIPS, DET, SCORED, TRANS, VEC, clips, cos_sql, detections, load, query_vector, spread, transcripts, vec_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def micros(x):
    """A number as whole millionths: sums come in any order, and this hides their last bit."""
    return F.floor(x * F.lit(1000000.0) + F.lit(0.5)).cast("long")


def _sql_micros(x: str) -> str:
    return f"CAST(floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


_WEIGHT = "CASE field WHEN 'fused' THEN 0.35::DOUBLE WHEN 'video' THEN 0.20::DOUBLE WHEN 'summary' THEN 0.20::DOUBLE WHEN 'speech' THEN 0.15::DOUBLE WHEN 'audio_caption' THEN 0.05::DOUBLE WHEN 'metadata' THEN 0.05::DOUBLE END"
_TOP = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k})"
_NORM = "n AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY field) > min(score) OVER (PARTITION BY field) THEN (score - min(score) OVER (PARTITION BY field)) / (max(score) OVER (PARTITION BY field) - min(score) OVER (PARTITION BY field)) ELSE 1 END AS norm FROM t)"

# --- vectors -----------------------------------------------------------------------------------------


@query(f"WITH {SCORED}, {_TOP.format(k=50)}, {_NORM} SELECT clip_id, {_sql_micros(f'sum(({_WEIGHT}) * norm)')} AS score_e6, count(*) AS n_hits, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM n GROUP BY clip_id")
def vec_late_fusion(spark, sf):
    """V6, V7, V8: the best 50 of each field, scores of a field onto [0, 1], weighted sum by clip."""
    hits = fusion.top_k_each(fusion.scored(vec_points(spark, sf), query_vector(spark, sf)), "field", 50, "vec_id")
    return fusion.late_fusion(hits).select("clip_id", micros(F.col("score")).alias("score_e6"), "n_hits", F.array_join("fields", ",").alias("fields"))


@query(f"WITH {SCORED} SELECT vec_id, clip_id, score FROM s WHERE field = 'video' AND label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 20")
def vec_knn_filtered(spark, sf):
    """V5: the filter goes to the scan, the cut to every task."""
    p = vec_points(spark, sf).where((F.col("field") == "video") & F.col("label").isin(1, 2, 3))
    return fusion.top_k(fusion.scored(p, query_vector(spark, sf)), 20, "vec_id").select("vec_id", "clip_id", "score")


@query(f"WITH {SCORED}, {_TOP.format(k=10)} SELECT field, vec_id, score, rank FROM t")
def vec_topk_per_field(spark, sf):
    """V6, T4."""
    return fusion.top_k_each(fusion.scored(vec_points(spark, sf), query_vector(spark, sf)), "field", 10, "vec_id").select("field", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SCORED}, {_TOP.format(k=30)}, {_NORM} SELECT field, vec_id, norm FROM n")
def vec_minmax(spark, sf):
    """V7."""
    hits = fusion.top_k_each(fusion.scored(vec_points(spark, sf), query_vector(spark, sf)), "field", 30, "vec_id")
    return fusion.min_max(hits, "field").select("field", "vec_id", "norm")


@query(f"WITH {VEC} SELECT vec_id, 80 AS long_size, e[1] AS first_value, 0.0::DOUBLE AS last_long, 32 AS short_size, e[32] AS last_short FROM v")
def vec_fit_dimension(spark, sf):
    """V1."""
    long_, short = V.fitted(F.col("embedding"), 80), V.fitted(F.col("embedding"), 32)
    return vec_points(spark, sf).select("vec_id", F.size(long_).alias("long_size"), F.get(long_, F.lit(0)).alias("first_value"), F.get(long_, F.lit(79)).alias("last_long"), F.size(short).alias("short_size"), F.get(short, F.lit(31)).alias("last_short"))


@query(f"WITH {VEC}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda q: q * q))) AS r FROM v) SELECT vec_id, e[1] / r AS first_value, e[64] / r AS last_value FROM n")
def vec_normalize(spark, sf):
    """V2."""
    n = V.normalized(F.col("embedding"))
    return vec_points(spark, sf).select("vec_id", F.get(n, F.lit(0)).alias("first_value"), F.get(n, F.lit(63)).alias("last_value"))


@query(f"WITH {VEC}, x AS (SELECT label, unnest(e) AS value, unnest(range(0, 64)) AS pos FROM v) SELECT label, CAST(pos AS INTEGER) AS pos, {_sql_micros('avg(value)')} AS mean_e6 FROM x GROUP BY label, pos")
def vec_mean_by_label(spark, sf):
    """A14."""
    return V.mean_vectors(vec_points(spark, sf), "label", "embedding").select("label", "pos", micros(F.col("value")).alias("mean_e6"))


@query(
    f"WITH {VEC}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0), p AS (SELECT vec_id, e[1:32] AS a, e[33:48] AS b, e[49:64] AS c, qe[1:32] AS qa, qe[33:48] AS qb, qe[49:64] AS qc FROM v, q) "
    f"SELECT vec_id, 0.58::DOUBLE * ({cos_sql('a', 'qa')}) + 0.22::DOUBLE * ({cos_sql('b', 'qb')}) + 0.15::DOUBLE * ({cos_sql('c', 'qc')}) + 0.05::DOUBLE AS score FROM p"
)
def vec_hybrid_score(spark, sf):
    """A weighted sum of three cosines and an aspect of 1."""
    q = query_vector(spark, sf)
    e = F.col("embedding")
    part = lambda a, n: V.cosine(F.slice(e, a, n), V.literal(q[a - 1 : a - 1 + n]))
    return vec_points(spark, sf).select("vec_id", (F.lit(0.58) * part(1, 32) + F.lit(0.22) * part(33, 16) + F.lit(0.15) * part(49, 16) + F.lit(0.05)).alias("score"))


@query(
    f"WITH {SCORED}, c AS (SELECT label, clip_id, max(score) AS score FROM s GROUP BY label, clip_id), r AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY label ORDER BY score DESC, clip_id)) "
    "SELECT label, clip_id, score, score - coalesce(nxt, 0) AS margin FROM r WHERE rn = 1"
)
def vec_margin(spark, sf):
    """A13, W13."""
    best = fusion.scored(vec_points(spark, sf), query_vector(spark, sf)).groupBy("label", "clip_id").agg(F.max("score").alias("score"))
    return fusion.margin(best, "label", "clip_id").select("label", "clip_id", "score", "margin")


@query(
    f"WITH {SCORED}, b AS (SELECT clip_id, CASE WHEN field IN ('video','summary') THEN 'av' ELSE 'transcript' END AS kind, max(score) AS best FROM s GROUP BY 1, 2) SELECT clip_id, {_sql_micros('sum(best)')} AS score_e6, count(*) > 1 AS hybrid FROM b GROUP BY clip_id"
)
def vec_combine_hits(spark, sf):
    """A7."""
    kind = F.when(F.col("field").isin("video", "summary"), "av").otherwise("transcript")
    s = fusion.scored(vec_points(spark, sf), query_vector(spark, sf)).withColumn("kind", kind)
    return fusion.combined(s, "clip_id", "kind").select("clip_id", micros(F.col("score")).alias("score_e6"), "hybrid")


def _hash_sql() -> str:
    word = lambda k: "|| ".join(f"substr(h, {8 * k + 2 * j + 1}, 2)" for j in (3, 2, 1, 0))
    xs = ", ".join(f"CAST(CAST('0x' || {word(k)} AS BIGINT) AS DOUBLE) / 2147483648.0::DOUBLE - 1" for k in range(8))
    return (
        "WITH d AS (SELECT doc_id, sha256(encode('document: ' || coalesce(text, '')) || '\\x00\\x00\\x00\\x00'::BLOB) AS h FROM documents), "
        f"x AS (SELECT doc_id, [{xs}] AS e FROM d), n AS (SELECT doc_id, e, sqrt(list_sum(list_transform(e, lambda q: q * q))) AS r FROM x) "
        "SELECT doc_id, e[1] / r AS x0, e[4] / r AS x3, e[8] / r AS x7 FROM n"
    )


@query(_hash_sql())
def vec_hash_embed(spark, sf):
    """V19."""
    e = load(spark, sf, "documents").select("doc_id", V.hash_embedding(F.col("text"), 8).alias("e"))
    return e.select("doc_id", *[F.get("e", F.lit(i)).alias(f"x{i}") for i in (0, 3, 7)])


@query(
    f"WITH {SCORED}, r AS (SELECT vec_id, label, score, CAST(vec_id % 7 AS DOUBLE) AS rr FROM s) SELECT vec_id, 0.35::DOUBLE * score / CASE WHEN max(abs(score)) OVER w > 0 THEN max(abs(score)) OVER w ELSE 1 END + 0.65::DOUBLE * CASE WHEN max(rr) OVER w > min(rr) OVER w THEN (rr - min(rr) OVER w) / (max(rr) OVER w - min(rr) OVER w) ELSE 0.5::DOUBLE END AS blend FROM r WINDOW w AS (PARTITION BY label)"
)
def rerank_blend(spark, sf):
    """V12."""
    s = fusion.scored(vec_points(spark, sf), query_vector(spark, sf)).withColumn("rerank", (F.col("vec_id") % 7).cast("double"))
    return fusion.rerank_blend(s, "label").select("vec_id", "blend")


@query(
    f"WITH {VEC}, q AS (SELECT e[1:48] AS qe FROM v WHERE vec_id = 0), u AS (SELECT vec_id, e[1:CAST(vec_id % 64 + 1 AS BIGINT)] AS e, qe FROM v, q), n AS (SELECT vec_id, e, qe, CAST(least(len(e), len(qe)) AS BIGINT) AS m FROM u) "
    "SELECT vec_id, list_sum(list_transform(list_zip(e[1:m], qe[1:m]), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(qe, lambda x: x * x)))) AS score, list_sum(list_transform(list_zip(e[1:m], qe[1:m]), lambda p: p[1] * p[2])) AS dot FROM n"
)
def vec_cosine_unequal(spark, sf):
    """V3, V4: vectors of 1 to 64 numbers against one of 48."""
    q = V.literal(query_vector(spark, sf)[:48])
    v = vec_points(spark, sf).select("vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("e"))
    return v.select("vec_id", V.cosine(F.col("e"), q).alias("score"), V.dot(F.col("e"), q).alias("dot"))


# --- relational --------------------------------------------------------------------------------------


@query(f"WITH {CLIPS} SELECT group_name, count(*) AS clips, count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, max(n_chars) AS latest FROM clips GROUP BY group_name")
def group_stats(spark, sf):
    """A1, A2."""
    return relational.group_stats(clips(spark, sf), "group_name", "status", "n_chars")


@query(f"WITH {CLIPS} SELECT clip_id, group_name, status FROM clips WHERE group_name = 'src3' AND status = 'indexed'")
def list_filter_sort(spark, sf):
    """F1."""
    return relational.filtered(clips(spark, sf), ["group_name", "clip_id"], group_name="src3", status="indexed").select("clip_id", "group_name", "status")


@query(f"WITH {DET} SELECT d.event_id, d.entity, c.c_mktsegment FROM det d JOIN customer c ON d.clip_id = c.c_custkey WHERE (contains(lower(d.entity), 'pur') OR contains(lower(d.entity), 'gn_')) AND c.c_mktsegment = 'BUILDING'")
def term_search_join(spark, sf):
    """The terms and the group reach the scans; the small side is Spark's choice by size."""
    d = detections(spark, sf).where(relational.holds_any_term([F.col("entity")], ["PUR", "gn_"]))
    c = load(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return d.join(c, d["clip_id"] == c["c_custkey"]).select("event_id", "entity", "c_mktsegment")


@query("WITH t AS (SELECT DISTINCT lang AS tag FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), ct AS (SELECT doc_id, lang AS tag FROM documents UNION SELECT doc_id, source FROM documents) SELECT ct.doc_id, string_agg(t.tag, ',' ORDER BY t.tag) AS tags FROM ct JOIN t USING (tag) GROUP BY ct.doc_id")
def tags_join(spark, sf):
    """Many-to-many tags, sorted by clip."""
    d = load(spark, sf, "documents")
    clip_tags = d.select("doc_id", F.col("lang").alias("tag")).union(d.select("doc_id", "source")).distinct()
    tags = clip_tags.select("tag").where("tag is not null").distinct()
    return clip_tags.join(tags, "tag").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


@query("WITH l AS (SELECT user_id AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT k, value FROM l WHERE rn = 1")
def kv_upsert(spark, sf):
    """K1: the last value of each key."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("k"), "value", "ts", "event_id")
    return relational.latest(e, ["k"], [F.desc("ts"), F.desc("event_id")]).select("k", "value")


@query("WITH t AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS k, c_name || '!' AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS bal FROM customer WHERE c_custkey % 5 <> 0) SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.name ELSE t.name END AS name, coalesce(s.bal, t.bal) AS bal FROM t FULL JOIN s ON s.k = t.k")
def coalesce_upsert(spark, sf):
    """K3: all fields of the new row, but an old balance where the new one is null."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    old = c.where("k % 3 <> 0")
    new = c.where("k % 5 <> 0").select("k", F.concat("name", F.lit("!")).alias("name"), F.when(F.col("k") % 2 == 0, F.col("bal") + 1).alias("bal"))
    return relational.upsert(old, new, ["k"], keep_old=("bal",))


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE conv_id % 4 = 0 AND turn < 2 UNION ALL SELECT conv_id, turn, text FROM conversations c WHERE conv_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn < 2)")
def replace_partition(spark, sf):
    """K6."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    new = c.where("conv_id % 4 = 0 and turn < 2").withColumn("text", F.lit("new"))
    return relational.replace_for_keys(c, new, ["conv_id"])


@query("WITH a AS (SELECT o_orderkey AS k, o_totalprice AS size FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderkey % 5 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'missing' WHEN a.size IS NOT DISTINCT FROM b.size THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k")
def scan_change_capture(spark, sf):
    """S8, R5."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("size"))
    state = o.where("k % 5 <> 0").withColumn("size", F.when(F.col("k") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return relational.change_capture(o.where("k % 7 <> 0"), state, ["k"], ["size"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0 AND o_custkey IS NOT NULL)")
def missing_antijoin(spark, sf):
    """Customers that a part of the orders doesn't name."""
    seen = load(spark, sf, "orders").where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return relational.missing(load(spark, sf, "customer"), seen, ["c_custkey"]).select("c_custkey", "c_name")


@query(f"WITH {CLIPS} SELECT clip_id FROM clips WHERE status IN ('pending', 'partial', 'failed') OR trim(coalesce(summary, '')) = '' OR clip_id IN (SELECT item_id FROM benchmark WHERE length(text) % 2 = 1)")
def exists_probe(spark, sf):
    """Clips to index again; items of another model are those of odd length here."""
    model = F.when(F.length("text") % 2 == 1, "old").otherwise("now")
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("clip_id"), model.alias("model"))
    return relational.needing_index(clips(spark, sf).withColumn("scan_status", F.lit("unchanged")), items, "now").select("clip_id")


@query("SELECT doc_id, count(*) OVER (PARTITION BY lower(source), n_chars) AS copies, CASE WHEN count(*) OVER (PARTITION BY lower(source), n_chars) > 1 THEN sha256(text) END AS file_hash FROM documents")
def dup_hash_policy(spark, sf):
    """S4, S5."""
    return relational.duplicates_hashed(load(spark, sf, "documents"), "source", "n_chars", F.col("text")).select("doc_id", "copies", "file_hash")


@query(
    "WITH f AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS stem, p_name AS path, p_size % 2 = 0 AS main FROM part), g AS (SELECT stem, arg_min(path, (lower(path), path)) FILTER (WHERE main) AS \"primary\", count(*) AS n FROM f GROUP BY stem) "
    'SELECT stem, "primary", (SELECT count(*) FROM f WHERE f.stem = g.stem AND f.path <> g."primary") AS n_related FROM g WHERE "primary" IS NOT NULL'
)
def sidecar_groups(spark, sf):
    """S6."""
    p = load(spark, sf, "part")
    g = relational.sidecar_groups(p.withColumn("path", F.col("p_name")), F.element_at(F.split("p_name", " "), 1), "path", F.col("p_size") % 2 == 0)
    return g.select("stem", "primary", F.size("related").cast("long").alias("n_related"))


@query(f"WITH {CLIPS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'failed') AS failed, count(DISTINCT group_name) AS groups FROM clips")
def counters(spark, sf):
    """A2, A3."""
    return clips(spark, sf).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.countDistinct("group_name").alias("groups"))


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def keyset_tail(spark, sf):
    """F5, R4."""
    return relational.tail(load(spark, sf, "events").select("event_id", "event_type"), "event_id", 500, 100)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn < 3 UNION ALL SELECT conv_id, 99, 'system', 'added' FROM (SELECT DISTINCT conv_id FROM conversations)")
def insert_or_ignore(spark, sf):
    """Rows of new keys are added, those of known keys are not."""
    c = load(spark, sf, "conversations")
    more = c.select("conv_id", F.lit(99).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit("added").alias("text")).distinct()
    return relational.insert_missing(c.where("turn < 3"), more.unionByName(c.where("turn < 2")), ["conv_id", "turn"])


# --- text --------------------------------------------------------------------------------------------

_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda x: length(x) > 1))"
_TOKB = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2))"
_Q = "the nothing of tion window auto5"


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS n_terms, list_aggregate(list_sort({_TOK.format('text')}), 'string_agg', ' ') AS terms FROM documents")
def tok_distinct(spark, sf):
    """X1."""
    t = T.tokens_underscore(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.when(F.size(t) > 0, F.array_join(F.array_sort(t), " ")).alias("terms"))


def _lex(q: str, d: str) -> str:
    return f"CASE WHEN len({q}) * len({d}) > 0 THEN len(list_intersect({q}, {d})) / sqrt(CAST(len({q}) * len({d}) AS DOUBLE)) ELSE 0 END"


@query(f"WITH d AS (SELECT doc_id, {_TOK.format('text')} AS t, {_TOK.format(repr(_Q))} AS q FROM documents) SELECT doc_id, CAST({_lex('q', 't')} AS DOUBLE) AS score FROM d")
def lexical_score(spark, sf):
    """X2, U1."""
    d = load(spark, sf, "documents").select("doc_id", T.tokens_underscore(F.col("text")).alias("t"))  # once a text
    return d.select("doc_id", T.lexical_score(T.tokens_underscore(F.lit(_Q)), F.col("t")).alias("score"))


@query(
    f"WITH d AS (SELECT doc_id, n_chars % 100 / 50.0::DOUBLE - 1 AS vec, {_TOK.format('text')} AS t, {_TOK.format(repr(_Q))} AS q, lang = 'en' AS m1, source = 'src0' AS m2 FROM documents), "
    f"x AS (SELECT doc_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN vec < 0 THEN (vec + 1) / 2 ELSE vec END)) AS v, CAST({_lex('q', 't')} AS DOUBLE) AS l, (CASE WHEN m1 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN m2 THEN 1.0::DOUBLE ELSE 0 END) / 2 AS m FROM d) "
    "SELECT doc_id, 0.72::DOUBLE * v + 0.20::DOUBLE * l + 0.08::DOUBLE * m AS score FROM x"
)
def hybrid_rank(spark, sf):
    """V10, V11, X3."""
    yes = F.lit(True)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    m = fusion.metadata_score([(yes, one(F.col("lang") == "en")), (yes, one(F.col("source") == "src0"))])
    lex = T.lexical_score(T.tokens_underscore(F.lit(_Q)), F.col("t"))
    vec = (F.col("n_chars") % 100).cast("double") / 50.0 - 1
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", T.tokens_underscore(F.col("text")).alias("t"))
    return d.select("doc_id", fusion.hybrid_score(vec, lex, m).alias("score"))


_RULES = {"the": ("the", "of the"), "en": ("en", "de la"), "le": ("le", "les", "la"), "die": ("der", "die", "das"), "toxic": ("idiot", "moron", "scum"), "license": ("license", "cc by"), "no-text": ("zz%", "q_q")}


def _tags_sql() -> str:
    parts = " UNION ALL ".join("SELECT doc_id, '" + tag + "' AS tag, " + " + ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '(^|[^\\pL\\pN_]){w}($|[^\\pL\\pN_])') THEN 1 ELSE 0 END" for w in words) + " AS n FROM documents" for tag, words in _RULES.items())
    return f"WITH x AS ({parts}), s AS (SELECT doc_id, tag, least(1.0::DOUBLE, 0.45::DOUBLE + n * 0.2::DOUBLE) AS score FROM x WHERE n > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS rank FROM s) SELECT doc_id, tag, score, rank FROM r WHERE rank <= 3"


@query(_tags_sql())
def rule_tags(spark, sf):
    """X9 with words that the tables hold; the engine's own rules are the default of the operator."""
    t = tagging.tags(load(spark, sf, "documents"), "doc_id", F.coalesce("text", F.lit("")), _RULES, 3)
    return t.select("doc_id", "tag", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slug(spark, sf):
    """X8."""
    return load(spark, sf, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query(
    "WITH t AS (SELECT p_partkey, p_brand || ' auto5 ' || p_type AS q FROM part), k AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda x: length(x) > 1) AS w FROM t), "
    "e AS (SELECT p_partkey, flatten(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[a-z]+[0-9]+$') THEN [x, regexp_extract(x, '^([a-z]+)', 1), regexp_extract(x, '^([a-z]+)', 1) || '-' || regexp_extract(x, '([0-9]+)$', 1), regexp_extract(x, '^([a-z]+)', 1) || ' ' || regexp_extract(x, '([0-9]+)$', 1)] ELSE [x] END)) AS f FROM k) "
    "SELECT p_partkey, list_aggregate(list_sort(list_distinct(f)), 'string_agg', '|') AS terms FROM e"
)
def term_expand(spark, sf):
    """X6; the terms are sorted here, which the two engines' orders of distinct lists make necessary."""
    q = F.concat_ws(" ", "p_brand", F.lit("auto5"), "p_type")
    return load(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(T.search_terms(q)), "|").alias("terms"))


@query("WITH w AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM w WHERE token NOT IN ('the', 'of', 'and') GROUP BY source, token), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS rank FROM c) SELECT source, token, n, rank FROM r WHERE rank <= 8")
def term_frequency_top8(spark, sf):
    """A11."""
    out = summary.frequent_terms(load(spark, sf, "documents"), "source", T.tokens(F.col("text")), ["the", "of", "and"])
    return out.select("source", "token", "n", F.col("rank").cast("long").alias("rank"))


@query(
    "WITH d AS (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS tight FROM documents) SELECT doc_id, (CASE WHEN contains(low, 'window') OR contains(tight, 'window') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'theof') OR contains(tight, 'theof') THEN 1 ELSE 0 END + CASE WHEN contains(low, 'tion') OR contains(tight, 'tion') THEN 1 ELSE 0 END) / 3.0::DOUBLE AS share FROM d"
)
def compact_search(spark, sf):
    """V23."""
    terms = F.array(F.lit("window"), F.lit("theof"), F.lit("tion"))
    return load(spark, sf, "documents").select("doc_id", T.contained_share(F.col("text"), terms).alias("share"))


@query("SELECT page_id, CASE WHEN contains(regexp_replace(url, '#.*$', ''), '?') THEN NULL ELSE regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') END AS page FROM pages")
def url_normalize(spark, sf):
    """X23, each page's own host being the allowed one."""
    base = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    bare = F.regexp_replace("url", "#.*$", "")
    page = F.when(F.startswith(bare, base) & ~F.contains(bare, F.lit("?")), F.regexp_replace(bare, "/+$", ""))
    return load(spark, sf, "pages").select("page_id", page.alias("page"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, regexp_extract(html, 'href=\"([^\"]*)\"', 1) AS first_link FROM pages")
def html_title_links(spark, sf):
    """X24, what column functions can do of it."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return load(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"))


@query()
def html_article(spark, sf):
    """The full parse, in Python."""
    a = knowledge.articles(load(spark, sf, "pages"), "page_id", "html")
    return a.select("page_id", "title", F.length("text").alias("n_text"), F.size("links").alias("n_links"), F.size("headings").alias("n_headings"))


@query(
    "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 220) / 185.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0) "
    "SELECT doc_id, i AS \"index\", md5(array_to_string(w[i * 185 + 1 : i * 185 + 220], ' ')) AS chunk FROM i"
)
def chunk_words(spark, sf):
    """W8."""
    words = F.filter(F.split("text", "[ \n\t]+"), lambda x: x != "")
    return timeline.word_chunks(load(spark, sf, "documents"), "doc_id", words).select("doc_id", "index", F.md5(F.col("chunk").cast("binary")).alias("chunk"))


@query("SELECT doc_id, substr(sha256(concat_ws(':', source, CAST(doc_id AS VARCHAR), printf('%.3f', n_chars / 8.0::DOUBLE))), 1, 16) AS cache_key, sha256(text) AS payload FROM documents")
def sha_payload(spark, sf):
    """V26, K14."""
    return load(spark, sf, "documents").select("doc_id", C.cache_key(F.col("source"), F.col("doc_id").cast("string"), F.format_string("%.3f", F.col("n_chars") / F.lit(8.0))).alias("cache_key"), F.sha2(F.col("text").cast("binary"), 256).alias("payload"))


@query(
    f"WITH d AS (SELECT doc_id, {_TOKB.format('text')} AS t, {_TOKB.format(repr('who killed me at the window of tion'))} AS q, lower(text) AS low, source = 'src1' AS died FROM documents) "
    f"SELECT doc_id, CAST({_lex('q', 't')} AS DOUBLE) + CASE WHEN died THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(low, 'window') THEN 0.8::DOUBLE ELSE 0 END AS score FROM d"
)
def rerank_local(spark, sf):
    """V13."""
    q = F.lit("who killed me at the window of tion")
    return load(spark, sf, "documents").select("doc_id", fusion.local_rerank(q, F.col("text"), F.col("source"), F.col("source") == "src1", F.lit("")).alias("score"))


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[1:8], ' ') || CASE WHEN len(w) > 8 THEN '...' ELSE '' END AS title FROM w")
def title_words(spark, sf):
    """X11, X13."""
    w = F.filter(F.split("text", "[ \n\t]+"), lambda x: x != "")
    return load(spark, sf, "documents").select("doc_id", F.concat(F.array_join(F.slice(w, 1, 8), " "), F.when(F.size(w) > 8, F.lit("...")).otherwise(F.lit(""))).alias("title"))


@query(
    r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+(\.[0-9]+)?[ \t\n\x0B\f\r]*(s|sec|seconds)([^\p{L}\p{N}_]|$)', '<time>\3', 'g'), "
    "'[^a-z0-9<>]+', ' ', 'g'), ' +', ' ', 'g'))) AS mark FROM documents"
)
def sentence_signature(spark, sf):
    """X15, of all texts."""
    return load(spark, sf, "documents").select("doc_id", F.md5(T.signature(F.col("text")).cast("binary")).alias("mark"))


@query("WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT source, md5(line) AS mark, count(*) AS n FROM l WHERE line <> '' GROUP BY source, line HAVING count(*) > 2")
def sentence_signature_dups(spark, sf):
    """Lines that a group holds more than twice."""
    lines = load(spark, sf, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return contracts.repeated(lines, "source", F.trim("line"), 2).select("source", F.md5(F.col("mark").cast("binary")).alias("mark"), "n")


@query()
def highlights(spark, sf):
    """Needs a look-behind, which the other engine lacks."""
    h = T.highlights([F.col("text")], F.array(F.lit("tion"), F.lit("window")))
    return load(spark, sf, "documents").select("doc_id", F.size(h).alias("n"), F.get(h, F.lit(0)).alias("first"))


@query()
def repetition_filter(spark, sf):
    """needs a back-reference, which the other engine lacks."""
    return load(spark, sf, "documents").select("doc_id", T.repetitive(F.col("text")).alias("repetitive"))


# --- intervals ---------------------------------------------------------------------------------------

_DUR = "d AS (SELECT conv_id AS clip_id, count(*) * 7.3::DOUBLE AS duration FROM conversations GROUP BY conv_id)"


def _durations(spark, sf):
    return load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg((F.count(F.lit(1)) * F.lit(7.3)).alias("duration"))


@query(f"WITH {_DUR}, i AS (SELECT clip_id, duration, unnest(range(0, CAST(greatest(0, ceil((duration - 2.0::DOUBLE) / 1.5::DOUBLE)) AS BIGINT) + 1)) AS i FROM d) SELECT clip_id, i AS \"index\", i * 1.5::DOUBLE AS start_sec, least(i * 1.5::DOUBLE + 2.0::DOUBLE, duration) AS end_sec FROM i")
def sliding_windows(spark, sf):
    """W3."""
    return timeline.windows(_durations(spark, sf), "duration", 2.0, 1.5).select("clip_id", "index", "start_sec", "end_sec")


@query(
    f"WITH {_DUR}, n AS (SELECT *, CAST(floor((duration - 5.0::DOUBLE) / 2.5::DOUBLE) AS BIGINT) AS n FROM d), w AS (SELECT clip_id, unnest(range(0, n + 1)) * 2.5::DOUBLE AS start_sec FROM n WHERE duration >= 5), "
    "t AS (SELECT clip_id, CASE WHEN duration < 5 THEN 0.0::DOUBLE ELSE (n + 1) * 2.5::DOUBLE END AS start_sec, duration AS end_sec FROM n) SELECT clip_id, start_sec, start_sec + 5.0::DOUBLE AS end_sec FROM w UNION ALL SELECT clip_id, start_sec, end_sec FROM t WHERE end_sec - start_sec >= 0.5::DOUBLE"
)
def caption_windows(spark, sf):
    """W4."""
    return timeline.caption_windows(_durations(spark, sf), "clip_id", "duration", 5.0, 2.5)


@query(f"WITH {_DUR}, i AS (SELECT clip_id, duration, unnest(range(0, 6)) AS i FROM d) SELECT clip_id, i AS pos, duration / 6 * (i + 0.5::DOUBLE) AS t FROM i")
def midpoint_samples(spark, sf):
    """W5."""
    return _durations(spark, sf).select("clip_id", F.posexplode(timeline.midpoints(F.lit(0.0), F.col("duration"), 6)).alias("pos", "t")).select("clip_id", F.col("pos").cast("long").alias("pos"), "t")


@query(
    f"WITH {DET}, a AS (SELECT *, CASE WHEN entity IS DISTINCT FROM lag(entity) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS f FROM det WHERE is_active WINDOW w AS (PARTITION BY clip_id ORDER BY ts, event_id)), b AS (SELECT *, sum(f) OVER (PARTITION BY clip_id ORDER BY ts, event_id) AS island FROM a) "
    "SELECT clip_id, CAST(island AS BIGINT) AS island, entity, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n, max(confidence) AS best FROM b GROUP BY clip_id, island, entity"
)
def run_length_timeline(spark, sf):
    """W1."""
    d = detections(spark, sf).where("is_active")
    return timeline.islands(d, "clip_id", ["ts", "event_id"], ["entity"], "ts", "confidence")


@query(f"WITH {DET}, r AS (SELECT clip_id, event_id, row_number() OVER (PARTITION BY clip_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY clip_id) AS cnt FROM det) SELECT clip_id, event_id, rn FROM r WHERE cnt <= 24 OR rn <= 12 OR rn > cnt - 12")
def timeline_head_tail(spark, sf):
    """W2."""
    return timeline.head_and_tail(detections(spark, sf), "clip_id", ["ts", "event_id"], 24).select("clip_id", "event_id", F.col("rn").cast("long").alias("rn"))


_POINTS = "p AS (SELECT conv_id AS clip_id, turn AS point_id, turn * 9.5::DOUBLE + 0.25::DOUBLE AS at FROM conversations)"


def _points(spark, sf):
    return load(spark, sf, "conversations").select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("point_id"), (F.col("turn") * F.lit(9.5) + F.lit(0.25)).alias("at"))


@query(
    f"WITH {TRANS}, {_POINTS}, m AS (SELECT p.clip_id, p.point_id, p.at, t.turn, t.start_sec, t.end_sec, CASE WHEN p.at < t.start_sec THEN t.start_sec - p.at WHEN p.at > t.end_sec THEN p.at - t.end_sec ELSE 0 END AS distance FROM p JOIN trs t USING (clip_id)), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, point_id ORDER BY distance, start_sec, turn) AS rn FROM m) SELECT clip_id, point_id, turn, start_sec, end_sec, distance FROM r WHERE rn = 1"
)
def nearest_interval(spark, sf):
    """J8."""
    return timeline.nearest_interval(_points(spark, sf), transcripts(spark, sf), "clip_id", "point_id", "at", "start_sec", "end_sec", "turn").select("clip_id", "point_id", "turn", "start_sec", "end_sec", "distance")


@query(
    f"WITH {TRANS}, {_POINTS}, c AS (SELECT clip_id, turn, (start_sec + end_sec) / 2 AS mid FROM trs), m AS (SELECT c.clip_id, c.turn, p.point_id, abs(c.mid - p.at) AS gap, row_number() OVER (PARTITION BY c.clip_id, c.turn ORDER BY abs(c.mid - p.at), p.at, p.point_id) AS rn FROM c JOIN p ON p.clip_id = c.clip_id AND abs(c.mid - p.at) <= 1.5::DOUBLE) "
    "SELECT c.clip_id, c.turn, m.point_id, m.gap FROM c LEFT JOIN m ON m.clip_id = c.clip_id AND m.turn = c.turn AND m.rn = 1"
)
def nearest_point_tolerance(spark, sf):
    """J9."""
    c = transcripts(spark, sf).select("clip_id", "turn", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid"))
    return timeline.nearest_point(c, _points(spark, sf), "clip_id", "turn", "mid", "point_id", "at", 1.5).select("clip_id", "turn", "point_id", "gap")


@query(
    f"WITH {TRANS}, {_POINTS}, m AS (SELECT p.clip_id, p.point_id, t.modality AS name, CASE WHEN p.at < t.start_sec THEN t.start_sec - p.at WHEN p.at > t.end_sec THEN p.at - t.end_sec ELSE 0 END AS gap, t.end_sec FROM p JOIN trs t USING (clip_id)), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, point_id ORDER BY gap, end_sec DESC, name) AS rn FROM m WHERE gap <= 2.5::DOUBLE) "
    "SELECT p.clip_id, p.point_id, r.name, r.gap FROM p LEFT JOIN r ON r.clip_id = p.clip_id AND r.point_id = p.point_id AND r.rn = 1"
)
def active_at(spark, sf):
    """J10."""
    ranges = transcripts(spark, sf).select("clip_id", "start_sec", "end_sec", F.col("modality").alias("name"))
    return timeline.active_at(_points(spark, sf), ranges, "clip_id", "point_id", "at", "start_sec", "end_sec", "name").select("clip_id", "point_id", "name", "gap")


@query(
    f"WITH {TRANS}, {_POINTS}, m AS (SELECT p.clip_id, p.point_id, t.modality AS name, CASE WHEN t.start_sec - p.at > 0.5 THEN NULL WHEN p.at >= t.start_sec - 0.5 AND p.at <= t.end_sec + 0.75 THEN 0 WHEN t.end_sec <= p.at AND p.at - t.end_sec <= 8 THEN 1 WHEN p.at - t.end_sec > 8 THEN NULL ELSE 2 END AS priority, abs(p.at - t.end_sec) AS gap FROM p JOIN trs t USING (clip_id)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, point_id ORDER BY priority, gap, name) AS rn FROM m WHERE priority IS NOT NULL) SELECT clip_id, point_id, priority, name FROM r WHERE rn = 1"
)
def asof_lookback(spark, sf):
    """J11."""
    ranges = transcripts(spark, sf).select("clip_id", "start_sec", "end_sec", F.col("modality").alias("name"))
    return timeline.as_of(_points(spark, sf), ranges, "clip_id", "point_id", "at", "start_sec", "end_sec", "name").select("clip_id", "point_id", "priority", "name")


@query(f"WITH {TRANS}, w AS (SELECT clip_id, turn, start_sec, end_sec FROM trs WHERE modality = 'assistant'), f AS (SELECT conv_id AS clip_id, 12.0::DOUBLE AS a, 24.0::DOUBLE AS b FROM conversations WHERE turn = 0) SELECT w.clip_id, w.turn FROM w WHERE EXISTS (SELECT 1 FROM f WHERE f.clip_id = w.clip_id AND w.start_sec < f.b AND w.end_sec > f.a)")
def overlap_semi(spark, sf):
    """J13, F12."""
    w = transcripts(spark, sf).where("modality = 'assistant'").select("clip_id", "turn", "start_sec", "end_sec")
    f = load(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").alias("clip_id"), F.lit(12.0).alias("a"), F.lit(24.0).alias("b"))
    return timeline.overlap_semi(w, f, "clip_id", "start_sec", "end_sec", "a", "b").select("clip_id", "turn")


@query(f"WITH {TRANS} SELECT clip_id, turn, start_sec, end_sec FROM trs")
def cumulative_timing(spark, sf):
    """W9."""
    return transcripts(spark, sf).select("clip_id", "turn", "start_sec", "end_sec")


@query("WITH c AS (SELECT conv_id AS clip_id, count(*) * 5 AS n FROM conversations GROUP BY conv_id), i AS (SELECT clip_id, n, unnest(range(0, 8)) AS i FROM c) SELECT DISTINCT clip_id, CAST(floor(i * ((n - 1) / 7.0::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS pos FROM i")
def even_indices(spark, sf):
    """W6."""
    n = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg((F.count(F.lit(1)) * 5).alias("n"))
    return n.select("clip_id", F.explode(timeline.even_indices(F.col("n"), 8)).alias("pos"))


@query(f"WITH {DET}, r AS (SELECT clip_id, event_id, row_number() OVER (PARTITION BY clip_id ORDER BY ts DESC, event_id DESC) AS rn FROM det) SELECT clip_id, event_id FROM r WHERE rn <= 10")
def history_ring(spark, sf):
    """W15, R2."""
    return timeline.last_rows(detections(spark, sf), "clip_id", [F.desc("ts"), F.desc("event_id")], 10).select("clip_id", "event_id")


@query(f"WITH {TRANS} SELECT clip_id, least(CAST(floor(start_sec) AS BIGINT), 29) AS bucket, count(*) AS n FROM trs GROUP BY 1, 2")
def fps_histogram(spark, sf):
    """A16 over the first 30 seconds, the last bucket taking the rest."""
    return timeline.second_histogram(transcripts(spark, sf).withColumn("d", F.lit(30.0)), "clip_id", "start_sec", "d")


@query(f"WITH {DET} SELECT clip_id, CAST(floor(t / 3600.0) AS BIGINT) AS bucket, max(abs(value)) AS peak FROM det GROUP BY 1, 2 HAVING max(abs(value)) >= 90")
def loud_buckets(spark, sf):
    """M4."""
    return timeline.loud_buckets(detections(spark, sf), "clip_id", "t", "value", 3600.0, 90.0)


# --- summaries ---------------------------------------------------------------------------------------


@query(f"WITH {DET}, f AS (SELECT clip_id, date_trunc('hour', ts) AS h, max(CAST(is_active AS INTEGER)) AS any_active, count(DISTINCT entity) AS names, floor(avg(confidence) * 1000000) AS mean FROM det GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY any_active DESC, names DESC, mean DESC, h DESC) AS rn FROM f) SELECT clip_id, h, any_active, names FROM r WHERE rn = 1")
def representative_frame(spark, sf):
    """A8."""
    d = detections(spark, sf).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return summary.representative_frame(d, "clip_id", "h", "is_active", "entity", "confidence").select("clip_id", "h", "any_active", "names")


@query(
    f"WITH {DET}, f AS (SELECT clip_id, entity, min((ts, event_id)) AS o FROM det GROUP BY 1, 2), n AS (SELECT clip_id, string_agg(entity, ',' ORDER BY o) AS names FROM f GROUP BY 1), a AS (SELECT clip_id, arg_min(entity, (ts, event_id)) FILTER (WHERE is_active) AS first_active, count(DISTINCT event_id % 4) >= 2 AS credible FROM det GROUP BY 1) "
    "SELECT n.clip_id, n.names, a.first_active, a.credible FROM n JOIN a USING (clip_id)"
)
def loadout_summary(spark, sf):
    """A9."""
    d = detections(spark, sf).withColumn("slot", F.col("event_id") % 4)
    out = summary.loadout(d, "clip_id", ["ts", "event_id"], "is_active", "entity", "slot")
    return out.select("clip_id", F.array_join("names", ",").alias("names"), "first_active", "credible")


@query(f"WITH {DET}, r AS (SELECT clip_id, event_id, row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN entity = 'error' THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rn FROM det) SELECT clip_id, event_id FROM r WHERE rn = 1")
def death_summary(spark, sf):
    """A10."""
    d = detections(spark, sf).withColumn("weapon", F.when(F.col("entity") == "error", F.col("entity")))
    return summary.death_row(d, "clip_id", "weapon", "ts", "event_id").select("clip_id", "event_id")


@query("WITH r AS (SELECT role, text, row_number() OVER (PARTITION BY role, lower(trim(text)) ORDER BY conv_id * 100 + turn) AS rn, conv_id * 100 + turn AS ord FROM conversations WHERE trim(text) <> '') SELECT role, ord FROM r WHERE rn = 1")
def ordered_distinct(spark, sf):
    """A18."""
    c = load(spark, sf, "conversations").withColumn("ord", F.col("conv_id") * 100 + F.col("turn"))
    return summary.ordered_distinct(c, "role", "text", "ord").select("role", "ord")


@query(
    f"WITH {DET}, l AS (SELECT clip_id, arg_max(entity, (ts, event_id)) AS latest FROM det GROUP BY 1), f AS (SELECT clip_id, entity, min((ts, event_id)) AS o FROM det GROUP BY 1, 2) SELECT l.clip_id, l.latest, coalesce(string_agg(f.entity, ',' ORDER BY f.o) FILTER (WHERE f.entity <> l.latest), '') AS previous FROM l JOIN f USING (clip_id) GROUP BY l.clip_id, l.latest"
)
def conflict_context(spark, sf):
    """W11."""
    out = summary.latest_and_before(detections(spark, sf), "clip_id", ["ts", "event_id"], "entity")
    return out.select("clip_id", "latest", F.array_join("previous", ",").alias("previous"))


@query("WITH n AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2), r AS (SELECT conv_id, role AS dominant, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS rn FROM n) SELECT n.conv_id, n.role, n.n, r.dominant FROM n JOIN r ON r.conv_id = n.conv_id AND r.rn = 1")
def modality_histogram(spark, sf):
    """A4."""
    return summary.histogram(load(spark, sf, "conversations"), "conv_id", "role")


@query(f"WITH {SCORED}, {DET}, h AS (SELECT clip_id, max(score) AS score FROM s GROUP BY 1), b AS (SELECT clip_id, sum(0.35::DOUBLE + CASE WHEN is_active THEN 0.15::DOUBLE ELSE 0 END + confidence * 0.1::DOUBLE) AS boost FROM det WHERE entity = 'purchase' GROUP BY 1) SELECT coalesce(h.clip_id, b.clip_id) AS clip_id, {_sql_micros('coalesce(score, 0) + coalesce(boost, 0)')} AS score_e6 FROM h FULL JOIN b ON h.clip_id = b.clip_id")
def boost_stack(spark, sf):
    """V16, V17."""
    h = fusion.scored(vec_points(spark, sf), query_vector(spark, sf)).groupBy("clip_id").agg(F.max("score").alias("score"))
    d = detections(spark, sf).where("entity = 'purchase'")
    return fusion.boosted(h, d, "clip_id", fusion.hud_boost(F.col("is_active"), F.col("confidence"))).select("clip_id", micros(F.col("score")).alias("score_e6"))


@query(f"WITH {DET}, c AS (SELECT clip_id, bool_or(entity = 'purchase') AS named, bool_or(is_active) AS windowed, bool_or(entity = 'error') AS died FROM det GROUP BY 1) SELECT clip_id, 4.5::DOUBLE + CASE WHEN named THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN windowed THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN died THEN 2.5::DOUBLE ELSE 0 END AS boost FROM c")
def intent_boost(spark, sf):
    """V18."""
    c = detections(spark, sf).groupBy("clip_id").agg(F.bool_or(F.col("entity") == "purchase").alias("named"), F.bool_or("is_active").alias("windowed"), F.bool_or(F.col("entity") == "error").alias("died"))
    return c.select("clip_id", fusion.intent_boost(F.col("named"), F.col("windowed"), F.col("died")).alias("boost"))


@query(f"WITH {TRANS}, r AS (SELECT clip_id, turn, start_sec, row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN contains(lower(text), 'tion') THEN 0 ELSE 1 END, turn) AS rn FROM trs) SELECT clip_id, turn, start_sec FROM r WHERE rn = 1")
def transcript_anchor(spark, sf):
    """V24."""
    return summary.transcript_anchor(transcripts(spark, sf), "clip_id", ["turn"], "text", F.lit("TION")).select("clip_id", "turn", "start_sec")


# --- quality -----------------------------------------------------------------------------------------


@query("SELECT doc_id, 'too_long' AS rule FROM documents WHERE n_chars > 3200 UNION ALL SELECT doc_id, 'blank' FROM documents WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT doc_id, 'forbidden' FROM documents WHERE contains(lower(text), 'idiot') UNION ALL SELECT doc_id, 'wrong_size' FROM documents WHERE n_chars <> length(text)")
def contract_violations(spark, sf):
    """C9, C12."""
    rules = {"too_long": F.col("n_chars") > 3200, "blank": F.trim(F.coalesce("text", F.lit(""))) == "", "forbidden": T.any_cue(F.col("text"), ["idiot"]), "wrong_size": F.col("n_chars") != F.char_length("text")}
    return contracts.violations(load(spark, sf, "documents"), "doc_id", rules)


@query(f"WITH {TRANS} SELECT clip_id * 100 + turn AS item, 'outside' AS rule FROM trs WHERE NOT (start_sec >= 5 AND end_sec <= 30 + 1e-6 AND start_sec <= end_sec)")
def bounds_violations(spark, sf):
    """C7, C8."""
    t = transcripts(spark, sf).withColumn("item", F.col("clip_id") * 100 + F.col("turn"))
    return contracts.violations(t, "item", {"outside": ~contracts.within(F.col("start_sec"), F.col("end_sec"), F.lit(5.0), F.lit(30.0))})


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS key, 'order_without_customer' AS rule FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT text, 'repeated_item' FROM (SELECT text FROM benchmark GROUP BY text HAVING count(*) > 1) UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'many_lines' FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def reference_audit(spark, sf):
    """J17, C13."""
    c = load(spark, sf, "customer").where("c_custkey % 10 <> 0")
    out = contracts.orphans(load(spark, sf, "orders"), c, "o_custkey", "c_custkey", "order_without_customer")
    out = out.unionByName(contracts.duplicates(load(spark, sf, "benchmark"), "text", "repeated_item"))
    return out.unionByName(contracts.duplicates(load(spark, sf, "lineitem"), "l_orderkey", "many_lines"))


@query(
    f"WITH {TRANS}, m AS (SELECT conv_id AS clip_id, turn AS point_id, turn * 9.5::DOUBLE + 0.25::DOUBLE AS at FROM conversations WHERE conv_id % 3 <> 0), c AS (SELECT clip_id, turn, (start_sec + end_sec) / 2 AS mid FROM trs), g AS (SELECT c.clip_id, c.turn, min(abs(c.mid - m.at)) AS gap FROM c JOIN m USING (clip_id) GROUP BY 1, 2) "
    "SELECT c.clip_id, c.turn, CASE WHEN gap <= 1.5 AND c.clip_id % 2 = 0 THEN 'player_kill_candidate' WHEN gap <= 1.5 THEN 'uncertain_death_audio' ELSE 'other_death_audio' END AS class FROM c LEFT JOIN g ON g.clip_id = c.clip_id AND g.turn = c.turn"
)
def death_vocal_classes(spark, sf):
    """C6."""
    m = _points(spark, sf).where("clip_id % 3 <> 0")
    return contracts.death_classes(transcripts(spark, sf), m, "clip_id", "turn", "start_sec", "end_sec", "point_id", "at", F.col("clip_id") % 2 == 0).select("clip_id", "turn", "class")


@query(f"WITH {DET}, c AS (SELECT DISTINCT clip_id FROM det) SELECT c.clip_id, (SELECT count(*) FROM det d WHERE d.clip_id = c.clip_id AND is_active) AS n_active, (SELECT count(*) FROM det d WHERE d.clip_id = c.clip_id AND entity = 'error') AS n_errors FROM c")
def ledger_nested(spark, sf):
    """C1."""
    d = detections(spark, sf)
    part = lambda cond: d.where(cond).select("clip_id", "ts", "event_id", "entity")
    out = contracts.ledger(d.select("clip_id").distinct(), "clip_id", active=part("is_active"), errors=part("entity = 'error'"))
    return out.select("clip_id", F.size("active").cast("long").alias("n_active"), F.size("errors").cast("long").alias("n_errors"))


# --- knowledge ---------------------------------------------------------------------------------------


@query(
    "WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://[^/]+/(.*)$', 1)) AS n FROM pages) SELECT page_id, CASE WHEN starts_with(n, 'weapons/') OR starts_with(n, 'en/') THEN 'weapon' WHEN starts_with(n, 'maps/') THEN 'map' WHEN contains(n, 'ammo') THEN 'ammo' ELSE 'article' END AS kind FROM p"
)
def entity_infer(spark, sf):
    """X25; English pages are in the category of weapons here."""
    name = F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1)
    categories = F.when(F.startswith(F.lower(name), F.lit("en/")), F.array(F.lit("Weapons"))).otherwise(F.array().cast("array<string>"))
    return load(spark, sf, "pages").select("page_id", knowledge.entity_type(name, categories).alias("kind"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '^(weapon 3d |weapon |tool |small |large )', ''), '[_-]+', ' ', 'g')) AS name FROM part")
def alias_clean(spark, sf):
    """X16 on names made from part types."""
    name = F.concat(F.lit("/images/"), F.regexp_replace(F.lower("p_type"), "^(small |large )", "Weapon_3D_"), F.lit(".PNG?width=3"))
    return load(spark, sf, "part").select("p_partkey", knowledge.clean_name(name).alias("name"))


@query(
    f"WITH {TRANS}, h AS (SELECT conv_id AS clip_id, turn, CASE WHEN turn % 3 = 0 THEN turn * 2.0::DOUBLE END AS start_time, turn % 2 = 0 AS by_text FROM conversations), "
    "a AS (SELECT clip_id, start_sec AS anchor FROM (SELECT clip_id, start_sec, row_number() OVER (PARTITION BY clip_id ORDER BY CASE WHEN contains(lower(text), 'tion') THEN 0 ELSE 1 END, turn) AS rn FROM trs) WHERE rn = 1), "
    "b AS (SELECT h.*, CASE WHEN start_time IS NOT NULL THEN start_time WHEN by_text THEN anchor END AS best FROM h JOIN a USING (clip_id)), "
    "m AS (SELECT b.clip_id, b.turn, b.start_time, b.best, t.start_sec, t.end_sec, row_number() OVER (PARTITION BY b.clip_id, b.turn ORDER BY CASE WHEN b.best < t.start_sec THEN t.start_sec - b.best WHEN b.best > t.end_sec THEN b.best - t.end_sec ELSE 0 END, t.start_sec, t.turn) AS rn FROM b JOIN trs t USING (clip_id)) "
    "SELECT clip_id, turn, best AS best_timestamp, CASE WHEN best IS NULL THEN NULL WHEN start_time IS NOT NULL THEN start_time ELSE start_sec END AS segment_start, CASE WHEN best IS NULL THEN NULL WHEN start_time IS NOT NULL THEN start_time ELSE end_sec END AS segment_end FROM m WHERE rn = 1"
)
def hit_timing(spark, sf):
    """Own times, else the transcript's anchor and the segment nearest to it, else none."""
    t = transcripts(spark, sf)
    hits = load(spark, sf, "conversations").select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("hit_id"), F.when(F.col("turn") % 3 == 0, F.col("turn") * F.lit(2.0)).alias("start_time"), F.lit(None).cast("double").alias("end_time"), F.when(F.col("turn") % 2 == 0, "transcript_text").otherwise("speech").alias("kind"))
    segments = t.select("clip_id", F.col("turn").alias("segment_id"), "start_sec", "end_sec")
    out = timeline.hit_timing(hits, segments, t, ["turn"], "tion")
    return out.select("clip_id", F.col("hit_id").alias("turn"), "best_timestamp", "segment_start", "segment_end")


@query(
    f"WITH {DET}, e AS (SELECT clip_id, event_id, entity, t / 3600.0 AS h, row_number() OVER (PARTITION BY clip_id, round(t / 3600.0, 0), lower(entity) ORDER BY t, event_id) AS rn FROM det WHERE is_active AND t >= 0) SELECT clip_id, event_id FROM e WHERE rn = 1"
)
def equipment_timeline(spark, sf):
    """One state of each name and (rounded) hour."""
    d = detections(spark, sf).where("is_active").withColumn("h", F.round(F.col("t") / 3600.0, 0))
    return ledger.equipment(d, "clip_id", "h", "entity", ["t", "event_id"]).select("clip_id", "event_id")


@query(
    f"WITH {DET}, r AS (SELECT clip_id, event_id, t, confidence, row_number() OVER (PARTITION BY clip_id ORDER BY confidence DESC, t, event_id) AS rn FROM det WHERE t <= 864000), b AS (SELECT clip_id, max(confidence) AS best, count(*) AS n_kept FROM r WHERE rn <= 3 GROUP BY 1) SELECT clip_id, best >= 0.55 AS detected, best, n_kept FROM b"
)
def hit_marker_query(spark, sf):
    """Frames of a time range, the three best, detected from 0.55 on."""
    return ledger.best_evidence(detections(spark, sf), "clip_id", "t", "confidence", "event_id", None, 864000.0, 3, 0.55).select("clip_id", "detected", "best", "n_kept")


_ALIAS = "list_aggregate(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 1), 'string_agg', ' ')"


@query(
    f"WITH a AS (SELECT DISTINCT array_to_string(string_split({_ALIAS.format('text')}, ' ')[1:2], ' ') AS alias FROM benchmark), t AS (SELECT doc_id, {_ALIAS.format('text')} AS t FROM documents), "
    "m AS (SELECT doc_id, alias, row_number() OVER (PARTITION BY doc_id ORDER BY length(alias) DESC, alias) AS rn FROM t JOIN a ON contains(' ' || t || ' ', ' ' || alias || ' ')) SELECT doc_id, alias FROM m WHERE rn = 1"
)
def alias_resolve(spark, sf):
    """The first two words of test items as aliases."""
    words = F.split(T.alias_key(F.col("text")), " ")
    a = load(spark, sf, "benchmark").select(F.array_join(F.slice(words, 1, 2), " ").alias("alias")).distinct()
    a = a.select("alias", F.col("alias").alias("entity"), F.lit(False).alias("is_variant"))
    texts = spread(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return knowledge.alias_matches(texts, a, "doc_id", "text").select("doc_id", "alias")


_TOKC = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 1))"


@query(
    f"WITH q AS (SELECT item_id, {_TOKC.format('text')} AS q FROM benchmark), i AS (SELECT DISTINCT doc_id, unnest({_TOKC.format('text')}) AS token FROM documents), x AS (SELECT item_id, len(q) AS n, unnest(q) AS token FROM q), "
    "h AS (SELECT x.item_id, i.doc_id, count(*) AS overlap, count(*) / CAST(any_value(x.n) AS DOUBLE) AS share FROM x JOIN i USING (token) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY share DESC, doc_id) AS rank FROM h) SELECT item_id, doc_id, overlap, share, rank FROM r WHERE rank <= 20"
)
def inverted_lookup(spark, sf):
    """The 20 documents that hold most of each query's tokens."""
    q = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("q"))
    out = knowledge.lookup(q, load(spark, sf, "documents").select("doc_id", "text"), "item_id", "q", "doc_id", "text", 20)
    return out.select("item_id", "doc_id", "overlap", "share", F.col("rank").cast("long").alias("rank"))


@query(f"WITH i AS (SELECT DISTINCT page_id, unnest({_TOKC.format('url')}) AS token FROM pages) SELECT token, count(*) AS n, min(page_id) AS first FROM i GROUP BY token")
def inverted_index(spark, sf):
    """The index from token to pages, told by its sizes."""
    i = knowledge.inverted(load(spark, sf, "pages"), "page_id", "url")
    return i.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


@query(
    f"WITH q AS (SELECT item_id, {_TOKC.format('text')} AS q, {_ALIAS.format('text')} AS s FROM benchmark), d AS (SELECT doc_id, {_TOKC.format('text')} AS t, {_ALIAS.format('text')} AS s FROM documents), "
    "h AS (SELECT item_id, doc_id, len(list_intersect(q, t)) / CAST(len(q) AS DOUBLE) + CASE WHEN contains(' ' || d.s || ' ', ' ' || q.s || ' ') THEN 0.25::DOUBLE ELSE 0 END AS score, len(list_intersect(q, t)) AS n FROM q, d), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h WHERE n > 0) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 5"
)
def knowledge_search(spark, sf):
    """V22."""
    q = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("q_text"))
    out = knowledge.search(q, load(spark, sf, "documents").select("doc_id", "text"), "item_id", "q_text", "doc_id", "text", 5)
    return out.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "WITH RECURSIVE links AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity > 30), f AS (SELECT 1::BIGINT AS url, 0 AS level UNION SELECT dst, level + 1 FROM f JOIN links ON url = src WHERE level < 3) SELECT url, min(level) AS level FROM f GROUP BY url"
)
def crawl_frontier(spark, sf):
    """The pages reached within three steps, each by its first."""
    links = load(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return knowledge.frontier(links, spark.range(1, 2).select(F.col("id").alias("url")), 3)


# --- JSON --------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none.deep') AS deep FROM events")
def json_payload_get(spark, sf):
    """N6."""
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none.deep").alias("deep"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, sf):
    """An object in a code fence, with a thought before it."""
    wrapped = F.concat(F.lit("<think>so {\"k\": 1}</think>```json\n"), "props", F.lit("\n```"))
    body = T.without_fence(T.without_thinking(wrapped))
    return load(spark, sf, "events").select("event_id", F.from_json(body, "k long")["k"].alias("k"))


@query("SELECT doc_id, md5(text) AS rest FROM documents")
def think_strip(spark, sf):
    """N2."""
    said = F.concat(F.lit("<think>a\nb</think>"), "text", F.lit("<THINK>open"))
    return load(spark, sf, "documents").select("doc_id", F.md5(T.without_thinking(said).cast("binary")).alias("rest"))


# --- extras ------------------------------------------------------------------------------------------


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def rollup_events(spark, sf):
    return load(spark, sf, "events").withColumn("part", F.col("user_id") % 3).rollup("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube_events(spark, sf):
    return load(spark, sf, "events").withColumn("part", F.col("user_id") % 3).cube("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY event_type")
def percentiles(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.9)).alias("p90"))


@query()
def approx_distinct(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))
