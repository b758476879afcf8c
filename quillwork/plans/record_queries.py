"""Queries of sources, sinks and record shapes, each with SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions import backends, records
from quillwork.functions import convert as C
from quillwork.functions import text as T
from quillwork.functions import vectors as V
from quillwork.operators import contracts, fusion, knowledge, ledger, media, relational, tagging
from quillwork.plans.catalogue import _POINTS, _points, query
from quillwork.plans.views import SCORED, TRANS, VEC, load, query_vector, transcripts, vec_points
from quillwork.sources import files
from quillwork.streaming.events import event_frame


def pick(n, *values):
    """One of the values by a number: what a query makes its odd inputs of."""
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(n % len(values) == i, F.lit(values[i])).otherwise(out)
    return out


def _sql_pick(n: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


# --- sources -----------------------------------------------------------------------------------------


def _written(spark, sf, key: str) -> str:
    """Names of nations as text files, a folder for each key."""
    at = files.scratch(spark, "names")
    n = load(spark, sf, "nation").select(key, F.col("n_name").alias("value"))
    n.coalesce(1).write.partitionBy(key).text(at)
    return at


@query("SELECT 'n_regionkey=' || n_regionkey AS group_name, '.txt' AS ext, 1::BIGINT AS n_files, CAST(sum(length(n_name) + 1) AS BIGINT) AS size_bytes FROM nation GROUP BY n_regionkey")
def file_listing(spark, sf):
    """Files under a root by extension in any case, their first folder, their sizes."""
    out = files.listing(spark, _written(spark, sf, "n_regionkey"), ["TXT"])
    return out.groupBy("group_name", "ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


@query("SELECT n_name AS text, sha256(n_name || chr(10)) AS file_hash FROM nation")
def sidecar_files(spark, sf):
    """Whole texts of sidecars, and the hash of the bytes."""
    at = _written(spark, sf, "n_nationkey")
    hashes = files.contents(spark, at, "*.txt").select(F.regexp_replace(F.col("content").cast("string"), "\\n$", "").alias("text"), F.col("sha256").alias("file_hash"))
    return files.sidecar_texts(spark, at, ".txt").select("text").join(hashes, "text")


@query("SELECT conv_id, turn FROM conversations WHERE turn % 4 NOT IN (0, 1)")
def json_lines_skip(spark, sf):
    """Broken lines and lines that are no objects are skipped."""
    c = load(spark, sf, "conversations")
    whole = F.to_json(F.struct("conv_id", "turn"))
    line = F.when(F.col("turn") % 4 == 0, F.substring(whole, 1, 12)).when(F.col("turn") % 4 == 1, "17").otherwise(whole)
    at = files.scratch(spark, "lines")
    c.select(line.alias("value")).write.text(at)
    return files.json_lines(spark, at, "conv_id long, turn long")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT NULL, NULL FROM nation WHERE n_nationkey % 5 = 0")
def json_object_file(spark, sf):
    """One object a file over several lines; broken files give nulls."""
    n = load(spark, sf, "nation")
    whole = F.concat(F.lit('{\n "id": '), F.col("n_nationkey"), F.lit(',\n "name": "'), "n_name", F.lit('"\n}'))
    at = files.scratch(spark, "objects")
    n.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(whole).alias("value")).repartition(1).write.partitionBy("k").text(at)
    return files.json_object(spark, f"{at}/*", "id long, name string").select("id", "name")


@query(
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey / 8.0::DOUBLE END AS duration, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 * 640 AS INTEGER) END AS width, 'h264' AS codec, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 30000 / 1001.0::DOUBLE WHEN o_orderkey % 4 = 1 THEN 25.0::DOUBLE END AS fps FROM orders"
)
def media_probe(spark, sf):
    """Typed fields of probe output; rates as fractions; what isn't positive is null."""
    k = F.col("o_orderkey")
    rate = pick(k, "30000/1001", "25", "0/0", "none")
    seconds = F.when(k % 7 == 0, F.lit("-1")).otherwise((k / F.lit(8.0)).cast("string"))
    probe = F.concat(F.lit('{"format":{"duration":"'), seconds, F.lit('"},"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":'), k % 3 * 640, F.lit(',"height":0,"avg_frame_rate":"'), rate, F.lit('"}]}'))
    return files.probe_rows(load(spark, sf, "orders").select(k.alias("k"), probe.alias("probe")), "probe").select("k", "duration", "width", "codec", "fps")


@query(
    "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN 16000 END AS rate, CASE WHEN p_partkey % 7 <> 0 THEN 1 END AS channels, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 100 + 1) / 16000.0::DOUBLE END AS seconds, "
    "CASE WHEN p_partkey % 7 <> 0 THEN 1.0::DOUBLE END AS peak, p_partkey % 7 = 0 AS broken, CASE WHEN p_partkey % 7 <> 0 THEN TRUE END AS ready FROM part"
)
def wav_columns(spark, sf):
    """Rate, channels, length and peak of sound files, and whether a captioner takes them."""
    n = F.col("p_partkey") % 100 + 1
    byte = lambda x: F.concat(F.lpad(F.hex(x), 2, "0"), F.lit("000000"))
    head = [F.lit("52494646"), byte(36 + 2 * n), F.lit("57415645666d74201000000001000100803e0000007d00000200100064617461"), byte(2 * n), F.expr("repeat('0100', cast(p_partkey % 100 + 1 as int))")]
    content = F.when(F.col("p_partkey") % 7 == 0, F.lit(b"junk")).otherwise(F.unhex(F.concat(*head)))
    rows = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    out = media.wav_info(rows)
    return out.select(F.col("path").cast("long").alias("k"), "rate", "channels", "seconds", "peak", F.col("error").isNotNull().alias("broken"), media.caption_ready(F.col("rate"), F.col("channels"), F.col("seconds")).alias("ready"))


# --- sinks -------------------------------------------------------------------------------------------

_K2 = """t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 'h' || c_custkey END AS file_hash, c_mktsegment AS source_root, c_name AS path, c_acctbal AS size FROM customer WHERE c_custkey % 3 <> 0),
s AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey END AS file_hash, c_mktsegment AS source_root, CASE WHEN c_custkey % 2 = 0 THEN c_name || '.moved' ELSE c_name END AS path, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS size FROM customer WHERE c_custkey % 5 <> 0),
m AS (SELECT coalesce(a.id, b.id) AS id, s.* FROM s LEFT JOIN t a ON s.file_hash = a.file_hash LEFT JOIN t b ON s.source_root = b.source_root AND s.path = b.path)"""


@query(f"WITH {_K2} SELECT * FROM t WHERE id NOT IN (SELECT id FROM m WHERE id IS NOT NULL) UNION ALL SELECT id, file_hash, source_root, path, size FROM m")
def two_key_upsert(spark, sf):
    """K2: by the hash, else by root and path; all fields are the new row's, nulls too."""
    k = F.col("c_custkey")
    c = load(spark, sf, "customer")
    target = c.where(k % 3 != 0).select(k.alias("id"), F.when(k % 4 != 0, F.concat(F.lit("h"), k)).alias("file_hash"), F.col("c_mktsegment").alias("source_root"), F.col("c_name").alias("path"), F.col("c_acctbal").alias("size"))
    path = F.when(k % 2 == 0, F.concat("c_name", F.lit(".moved"))).otherwise(F.col("c_name"))
    source = c.where(k % 5 != 0).select(F.when(k % 2 == 0, F.concat(F.lit("h"), k)).alias("file_hash"), F.col("c_mktsegment").alias("source_root"), path.alias("path"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("size"))
    return relational.upsert_two_keys(target, source, "file_hash", ["source_root", "path"], "id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def dynamic_update(spark, sf):
    """K9: any columns of the rows that meet a condition."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return relational.updated(o, F.col("o_orderkey") % 2 == 0, o_orderstatus=F.lit("X"), o_custkey=F.lit(None).cast("long"))


@query(f"WITH {VEC} SELECT vec_id, clip_id FROM v WHERE clip_id % 4 <> 1 AND vec_id % 3 <> 0")
def points_kept(spark, sf):
    """Points of deleted clips go, and those of another size."""
    v = vec_points(spark, sf)
    v = v.withColumn("embedding", F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 3 == 0, 32).otherwise(64)))
    gone = v.where("clip_id % 4 = 1").select("clip_id")
    return relational.of_size(relational.without_clips(v, gone), "embedding", 64).select("vec_id", "clip_id")


@query("SELECT 'nation' AS name, count(*) AS rows FROM nation WHERE n_regionkey > 0 UNION ALL SELECT 'region', count(*) FROM region WHERE FALSE")
def emptied_tables(spark, sf):
    """Tables emptied together, then partitions written one by one: only those with new rows change."""
    at = files.scratch(spark, "partitions")
    n = load(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    files.overwrite_partitions(n, at, ["n_regionkey"])
    files.overwrite_partitions(n.where("n_regionkey = 1"), at, ["n_regionkey"])
    empty = relational.emptied(load(spark, sf, "region"))[0]
    sizes = spark.read.schema("n_nationkey long, n_regionkey long").parquet(at).where("n_regionkey > 0").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select(F.lit("nation").alias("name"), "rows").unionByName(empty.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("region").alias("name"), "rows"))


@query("SELECT 'clips' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'parts', count(*) FROM part WHERE p_size > 10")
def pack_manifest(spark, sf):
    """A pack of JSON lines and its manifest; digests don't depend on the order of rows."""
    c, p = load(spark, sf, "customer").select("c_custkey", "c_name"), load(spark, sf, "part").where("p_size > 10").select("p_partkey")
    first = files.write_pack({"clips": c, "parts": p}, files.scratch(spark, "pack"))
    again = files.write_pack({"clips": c.repartition(3), "parts": p}, files.scratch(spark, "pack"))
    return first.join(again, ["name", "rows", "digest"]).select("name", "rows")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def swapped_table(spark, sf):
    """Versions are written beside each other, and the last one named is read."""
    at = files.scratch(spark, "versions")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    files.swap(n.select("n_nationkey", "n_name"), at)
    return spark.read.schema("n_nationkey long, n_name string").parquet(files.swap(n.where("n_regionkey <> 2").select("n_nationkey", "n_name"), at))


@query("SELECT 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {\"user_id\":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, sf):
    """K16, R4."""
    return event_frame(load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "user_id"))


# --- filters and joins -------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(lang = 'en' AND source = 'src0', FALSE) AS every, coalesce(lang = 'en', FALSE) OR coalesce(source = 'src0', FALSE) AS some FROM documents")
def payload_filters(spark, sf):
    """a list that holds all, or any, of what is expected."""
    there, asked = F.array_compact(F.array("lang", "source")), F.array(F.lit("en"), F.lit("src0"))
    return load(spark, sf, "documents").select("doc_id", C.has_all(there, asked).alias("every"), C.has_any(there, asked).alias("some"))


@query(f"WITH {SCORED}, c AS (SELECT clip_id, max(score) AS score, list(DISTINCT field) AS fields FROM s WHERE vec_id % 4 < 2 GROUP BY clip_id) SELECT clip_id, score FROM c WHERE (list_contains(fields, 'speech') OR list_contains(fields, 'fused')) AND score >= 0.05")
def fused_modalities(spark, sf):
    """fused clips that a field matched, from a score on."""
    s = fusion.scored(vec_points(spark, sf), query_vector(spark, sf)).where("vec_id % 4 < 2")
    c = s.groupBy("clip_id").agg(F.max("score").alias("score"), F.collect_set("field").alias("fields"))
    return fusion.with_threshold(records.matched_fields(c, ["speech", "fused"]), 0.05, "clip_id").select("clip_id", "score")


@query(f"WITH {TRANS}, f AS (SELECT clip_id, min(start_sec) AS d FROM trs WHERE turn % 5 = 3 GROUP BY 1) SELECT t.clip_id, t.turn FROM trs t LEFT JOIN f USING (clip_id) WHERE d IS NULL OR end_sec < d")
def before_death(spark, sf):
    """F13."""
    t = transcripts(spark, sf)
    deaths = t.where("turn % 5 = 3").select("clip_id", F.col("start_sec").alias("at"))
    return records.before_first(t, deaths, "clip_id", "end_sec", "at").select("clip_id", "turn")


_ASKED = ("who killed me at the dock", "we downed two", "my final kill", "I shot him and then death came", "a quiet walk", "Enemy KILLED")


@query(f"SELECT doc_id, {_sql_pick('doc_id', 'TRUE', 'FALSE', 'FALSE', 'TRUE', 'FALSE', 'FALSE')} AS death, {_sql_pick('doc_id', 'FALSE', 'TRUE', 'TRUE', 'FALSE', 'FALSE', 'TRUE')} AS kill, doc_id % 6 = 5 OR doc_id % 4 = 1 AS told FROM documents")
def query_intents(spark, sf):
    """what a question asks for, and what a file name tells of the outcome."""
    q = pick(F.col("doc_id"), *_ASKED)
    name = F.when(F.col("doc_id") % 6 == 5, "x_killed.mp4").when(F.col("doc_id") % 4 == 1, "Confirmed_Hunter_Kill").otherwise("killer.mp4")
    return load(spark, sf, "documents").select("doc_id", fusion.death_intent(q).alias("death"), fusion.kill_intent(q).alias("kill"), ledger.known_outcome(name).alias("told"))


@query(
    f"SELECT doc_id, CAST({_sql_pick('doc_id', '12', '5', '1', '100', '5')} AS INTEGER) AS whole, CAST({_sql_pick('doc_id', '12', '0.5', '0', '100', '0.5')} AS DOUBLE) AS real, "
    f"CAST({_sql_pick('doc_id', '12', 'NULL', '-7', '9999', 'NULL')} AS DOUBLE) AS cast_, doc_id % 3 < 2 AS yes, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE 'c' END AS present FROM documents"
)
def bounded_values(spark, sf):
    """Numbers within bounds, safe casts, yes or no, the first value that there is."""
    x = pick(F.col("doc_id"), "12", "many", "-7", "9999", "")
    held = F.create_map(F.lit("x"), F.lit(" "), F.lit("y"), F.when(F.col("doc_id") % 2 == 0, F.lit("b")), F.lit("z"), F.lit("c"))
    return load(spark, sf, "documents").select(
        "doc_id", C.bounded_int(x, 1, 100, 5).alias("whole"), C.bounded(x, 0.0, 100.0, 0.5).alias("real"), C.to_double(x).alias("cast_"), C.truthy(pick(F.col("doc_id"), " YES", "on", "off")).alias("yes"), records.first_present(held, ["w", "x", "y", "z"]).alias("present")
    )


@query("SELECT p_partkey, p_partkey % 3 < 2 AS skin, p_partkey % 4 = 0 AS relevant FROM part")
def image_predicates(spark, sf):
    """does a picture show a skin, and is it a reference for the page's entity?"""
    k = F.col("p_partkey")
    alt, source = pick(k, "Weapon 3D Dolch", "plain", "plain"), pick(k, "", "/thumb/DLC_x.png", "/images/x.png")
    url = pick(k, "https://w.example/images/Weapon_Mosin.png?1", "https://w.example/images/site-logo.png", "https://other.example/images/Weapon_Mosin.png", "https://w.example/media/Weapon_Mosin.png")
    fits = knowledge.relevant_image(url, F.lit(""), F.lit(200), "w.example", F.lit("weapon"), F.lit("Mosin"))
    return load(spark, sf, "part").select("p_partkey", knowledge.is_skin_media(alt, source, F.lit("")).alias("skin"), fits.alias("relevant"))


@query(
    "WITH i AS (SELECT p_partkey, p_size AS page, CASE WHEN p_partkey % 2 = 0 THEN 80 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 25 ELSE 0 END AS score, p_partkey % 300 AS side FROM part), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, side DESC, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS rank FROM i) SELECT p_partkey, page, score, rank FROM r WHERE rank <= 4"
)
def image_ranking(spark, sf):
    """Z2."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.lit("weapon_mosin")).otherwise(F.lit("other"))
    url = F.concat(F.lit("https://w.example"), F.when(k % 2 == 0, F.lit("/images/")).otherwise(F.lit("/thumb/")), name, F.lit(".png?"), F.lpad(k.cast("string"), 9, "0"))
    i = load(spark, sf, "part").select(k, F.col("p_size").alias("page"), F.regexp_replace(url, "^https://w.example/(images|thumb)/", F.lit("https://w.example/$1/")).alias("url"), F.when(k % 5 == 0, "the Mosin").otherwise("x").alias("alt"), (k % 300).cast("int").alias("width"), F.lit(0).alias("height"), F.lit("Mosin").alias("entity"), F.lit("weapon").alias("kind"))
    # within a page the URL's number breaks ties, whatever the folder: pictures of one score share it
    out = knowledge.image_rank(i, "page", "entity", "kind", 4)
    return out.select("p_partkey", "page", F.col("image_score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def validated_rows(spark, sf):
    """J14, J15."""
    known = load(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return relational.validated(load(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query("WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '')[1:6] AS w FROM documents), n AS (SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w), 3) AS BIGINT) + 1)) AS i FROM w) SELECT doc_id, i AS pos, w[i] AS a, CASE WHEN i <= 3 THEN i * 10 END AS b FROM n")
def zipped_lists(spark, sf):
    """Two lists by position, up to the longer one."""
    w = F.slice(F.filter(F.split("text", "[ \n\t]+"), lambda x: x != ""), 1, 6)
    z = relational.zipped(F.col("w"), F.col("n"))
    d = load(spark, sf, "documents").where("text is not null").select("doc_id", w.alias("w"), F.array(*[F.lit(x).cast("long") for x in (10, 20, 30)]).alias("n"))
    out = d.select("doc_id", F.posexplode(z).alias("pos", "z"))
    return out.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("z.w").alias("a"), F.col("z.n").alias("b"))


@query(f"WITH {SCORED}, r AS (SELECT clip_id, field, label, max(score) AS score FROM s GROUP BY 1, 2, 3) SELECT clip_id, label, max(score) AS score FROM r GROUP BY 1, 2")
def best_references(spark, sf):
    """Every point against the query, the best of each reference, then of each entity."""
    return relational.best_reference(fusion.scored(vec_points(spark, sf), query_vector(spark, sf)), "clip_id", "field", "label")


# --- sums, orders, sets ------------------------------------------------------------------------------


@query("SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.s, b.s), coalesce(b.s, a.s)) AS score FROM (SELECT o_custkey AS k, max(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS s FROM customer) b ON a.k = b.k")
def max_merge(spark, sf):
    """A12."""
    a = load(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("score"))
    return records.max_merged(a, load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("score")), "k", "score")


@query(
    f"WITH {VEC}, x AS (SELECT label, unnest(e[1:8]) AS x, unnest(range(0, 8)) AS pos FROM v) SELECT label, CAST(pos AS INTEGER) AS pos, CAST(floor(avg(x) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS mean_e6, "
    "CAST(floor(stddev_pop(x) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS std_e6, median(x) AS median FROM x GROUP BY 1, 2"
)
def element_stats(spark, sf):
    """Mean, deviation and median of each element over a stack of frames."""
    v = vec_points(spark, sf).withColumn("e", F.slice("embedding", 1, 8))
    out = media.element_stats(v, "label", "e")
    e6 = lambda c: F.floor(F.col(c) * F.lit(1000000.0) + F.lit(0.5)).cast("long")
    return out.select("label", "pos", e6("mean").alias("mean_e6"), e6("std").alias("std_e6"), "median")


@query(f"WITH {VEC} SELECT vec_id, list_aggregate(e, 'quantile_cont', 0.55) AS p0_55, list_aggregate(e, 'quantile_cont', 0.992) AS p0_992 FROM v")
def frame_quantiles(spark, sf):
    """Percentiles within one frame."""
    return media.frame_percentiles(vec_points(spark, sf), "vec_id", "embedding", (0.55, 0.992))


@query("WITH l AS (SELECT conv_id, turn, role FROM conversations WHERE turn % 2 = 1), p AS (SELECT DISTINCT conv_id FROM conversations) SELECT p.conv_id, count(l.turn) AS n, coalesce(string_agg(l.turn || l.role, ',' ORDER BY l.turn), '') AS children FROM p LEFT JOIN l USING (conv_id) GROUP BY 1")
def child_lists(spark, sf):
    """A21."""
    c = load(spark, sf, "conversations")
    out = records.with_children(c.select("conv_id").distinct(), c.where("turn % 2 = 1").select("conv_id", "turn", "role"), "conv_id", "children")
    said = F.array_join(F.transform("children", lambda x: F.concat(x["turn"].cast("string"), x["role"])), ",")
    return out.select("conv_id", F.size("children").cast("long").alias("n"), said.alias("children"))


@query("SELECT o_orderkey, 0.25::DOUBLE + 0.5::DOUBLE * (o_orderkey % 9) / greatest(o_orderkey % 10, 1) AS progress FROM orders")
def stage_progress(spark, sf):
    """W14."""
    k = F.col("o_orderkey")
    return load(spark, sf, "orders").select("o_orderkey", records.progress(k % 9, k % 10, 0.25, 0.75).alias("progress"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 > 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def finite_best(spark, sf):
    """Infinite and missing scores don't rank."""
    score = F.when(F.col("c_custkey") % 4 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 4 > 1, F.col("c_acctbal").cast("double")).otherwise(F.lit(float("nan")))
    return records.finite_top(load(spark, sf, "customer").select("c_custkey", score.alias("score")), "score", "c_custkey").select("c_custkey")


@query("SELECT slot, k, row_number() OVER (ORDER BY CASE slot WHEN 'HOUSEHOLD' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 99 END, slot, bal DESC, k) AS place FROM (SELECT c_mktsegment AS slot, c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal END AS bal FROM customer)")
def slot_places(spark, sf):
    """A given order of slots, then falling numbers with nulls as 0, then the key, so that no tie is left."""
    from pyspark.sql import Window

    c = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("slot"), F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    names = [r["slot"] for r in relational.in_slot_order(c.select("slot").distinct(), "slot", ["HOUSEHOLD", "BUILDING"]).collect()]
    table = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)])
    w = Window.orderBy(F.try_element_at(table, F.col("slot")), F.coalesce("bal", F.lit(0)).desc(), "k")
    return c.select("slot", "k", F.row_number().over(w).cast("long").alias("place"))


@query(
    "WITH c AS (SELECT conv_id, list_sort(list(DISTINCT turn % 4)) AS t FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_sort(list_filter([0, 1, 2, 3], lambda x: NOT list_contains(t, x))), ',') AS missing, len(list_filter([0, 2], lambda x: NOT list_contains(t, x))) = 0 AS within, "
    "array_to_string(list_sort(list_distinct(list_concat(t, [3, 7]))), ',') AS either FROM c"
)
def set_algebra(spark, sf):
    """What is missing, is it a subset, both together."""
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") % 4).alias("t"))
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda v: v.cast("string")), ",")
    return c.select("conv_id", text(contracts.missing_items(longs(0, 1, 2, 3), F.col("t"))).alias("missing"), (F.size(contracts.missing_items(longs(0, 2), F.col("t"))) == 0).alias("within"), text(F.array_union("t", longs(3, 7))).alias("either"))


@query("SELECT doc_id, n_chars AS width, doc_id % 3 AS note FROM documents")
def merged_metadata(spark, sf):
    """Maps merged, the later one's values winning; technical keys alone stay in the compact form."""
    a = F.create_map(F.lit("width"), F.lit(1).cast("long"), F.lit("note"), F.lit(9).cast("long"), F.lit("title"), F.lit(2).cast("long"))
    b = F.create_map(F.lit("width"), F.col("n_chars").cast("long"), F.lit("note"), F.col("doc_id") % 3)
    m = records.merged_maps(a, b)
    return load(spark, sf, "documents").select("doc_id", records.compact_metadata(m)["width"].alias("width"), m["note"].alias("note")).where(F.size(records.compact_metadata(m)) == 1)


# --- records and texts -------------------------------------------------------------------------------


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'video' WHEN doc_id % 3 = 1 THEN 'audio' ELSE 'metadata' END AS source, greatest(0.0::DOUBLE, doc_id % 7 - 2.0::DOUBLE) AS start, greatest(greatest(0.0::DOUBLE, doc_id % 7 - 2.0::DOUBLE), doc_id % 5 * 1.0::DOUBLE) AS \"end\", "
    "substr(CASE WHEN trim(coalesce(lang, '')) <> '' THEN lang ELSE coalesce(source, '') END, 1, 500) AS quote FROM documents"
)
def evidence_pointers(spark, sf):
    """V9: source, bounds in order, and the first text that isn't blank."""
    k = F.col("doc_id")
    p = records.pointer(pick(k, "video", "audio_caption", "strange"), F.lit("w"), (k % 7 - 2).cast("double"), (k % 5).cast("double"), F.col("lang"), F.col("source"))
    return load(spark, sf, "documents").select("doc_id", p.alias("p")).select("doc_id", "p.source", "p.start", "p.end", "p.quote")


@query("SELECT c_custkey, concat_ws(chr(10), 'name: ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'segment: ' || c_mktsegment END) AS document, concat_ws('; ', 'who: ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 'what: ' || c_mktsegment END) AS labelled FROM customer")
def labelled_lines(spark, sf):
    """Labelled lines and labelled text, without what is blank."""
    some = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("  "))
    return load(spark, sf, "customer").select("c_custkey", fusion.rerank_document({"name": F.col("c_name"), "segment": some}).alias("document"), records.labelled({"who": F.col("c_name"), "what": some}).alias("labelled"))


@query(f"SELECT doc_id, {_sql_pick('doc_id', chr(39) + '0.5,0.0,0.0' + chr(39), chr(39) + '0.25,2.0,0.0' + chr(39), chr(39) + '0.75,-1.0,0.0' + chr(39), chr(39) + '0.0,4.0,3.0' + chr(39), chr(39) + '1.5,0.0,0.0' + chr(39), chr(39) + '0.0,0.0,0.0' + chr(39))} AS scores FROM documents")
def score_coercion(spark, sf):
    """Three scores, whatever a re-ranker gives: a number, lists, lists of lists, objects with places, nothing."""
    said = pick(F.col("doc_id"), "0.5", "[0.25, 2, null]", '[[0.1, 0.75], [-1]]', '[{"index": 2, "score": 3.0}, {"relevance_score": 4}, {"index": 9, "score": 1}]', '[{"score": 1.5}, {"score": "bad"}]', "none")
    s = fusion.scores_of(said, F.lit(3))
    return load(spark, sf, "documents").select("doc_id", F.array_join(s.cast("array<string>"), ",").alias("scores"))


@query("SELECT p_partkey, p_brand || ' clip ' || p_size AS name FROM part")
def human_names(spark, sf):
    """File names as words."""
    path = F.concat(F.lit("/clips/2024/"), F.regexp_replace("p_brand", "#", "#"), F.lit("_clip-"), "p_size", F.when(F.col("p_partkey") % 2 == 0, F.lit("-2024-05-06.mp4")).otherwise(F.lit("-20240506.webm")))
    return load(spark, sf, "part").select("p_partkey", records.human_name(path).alias("name"))


@query(f"SELECT doc_id, {_sql_pick('doc_id', 'TRUE', 'FALSE', 'FALSE')} AS noise, {_sql_pick('doc_id', 'NULL', chr(39) + 'a b' + chr(39), 'NULL')} AS clean, {_sql_pick('doc_id', chr(39) + 'x 1911 y' + chr(39), chr(39) + 'lebel' + chr(39), chr(39) + 'same' + chr(39))} AS term FROM documents")
def cleaned_fields(spark, sf):
    """Terms rewritten by rules, numeric noise, stand-ins of nothing."""
    k = F.col("doc_id")
    noise = records.numeric_noise(pick(k, "1 2 3 4 5 6 7 8 9:00 10 ok", "1 2 3 some words of a line", "12"))
    term = records.rewritten(pick(k, "x m1911 y", "lebell", "same"), [(r"\bm1911\b", "1911"), ("lebell$", "lebel")])
    return load(spark, sf, "documents").select("doc_id", noise.alias("noise"), records.clean_field(pick(k, " N/A ", " a  b ", "  ")).alias("clean"), term.alias("term"))


@query(f"WITH {TRANS}, u AS (SELECT clip_id, turn, sum(length(text) + 2) OVER (PARTITION BY clip_id ORDER BY turn) AS used FROM trs) SELECT clip_id, turn FROM u WHERE used - 2 <= 400")
def packed_snippets(spark, sf):
    """X22."""
    return records.packed(transcripts(spark, sf), "clip_id", ["turn"], "text", 400).select("clip_id", "turn")


@query(f"SELECT doc_id, {_sql_pick('doc_id', chr(39) + 'gunshot,voice' + chr(39), chr(39) + 'explosion' + chr(39), chr(39) + chr(39), chr(39) + 'music' + chr(39))} AS events, {_sql_pick('doc_id', chr(39) + 'de' + chr(39), chr(39) + 'fr' + chr(39), 'NULL', chr(39) + 'es' + chr(39))} AS code FROM documents")
def audio_cues(spark, sf):
    """Events that a file name tells of; codes of languages."""
    name = pick(F.col("doc_id"), "Gun_talk.wav", "BOOM.wav", "quiet.wav", "a song.mp3")
    return load(spark, sf, "documents").select("doc_id", F.array_join(backends.audio_events(name), ",").alias("events"), T.language_code(pick(F.col("doc_id"), "German", " FR ", "klingon", "spanish")).alias("code"))


@query(f"WITH {TRANS} SELECT clip_id, turn, printf('%.3fs', start_sec) AS at, printf('%.3f-%.3fs', start_sec, end_sec) AS span FROM trs")
def time_texts(spark, sf):
    """X27."""
    t = transcripts(spark, sf)
    return t.select("clip_id", "turn", T.seconds(F.col("start_sec")).alias("at"), T.time_range(F.col("start_sec"), F.col("end_sec")).alias("span"))


@query(
    f"WITH {TRANS}, t AS (SELECT clip_id, turn, start_sec AS t, turn % 6 * 2.0::DOUBLE AS d FROM trs) SELECT clip_id, turn, round(greatest(0.0::DOUBLE, t - 1.5::DOUBLE), 6) AS analysis, round(greatest(0.0::DOUBLE, t + 1.5::DOUBLE), 6) AS source, "
    "CASE WHEN t <= d THEN t WHEN t <= d + greatest(0.05::DOUBLE, least(0.25::DOUBLE, d * 0.02::DOUBLE)) THEN d END AS clamped, turn / 25.0::DOUBLE AS frame, CASE WHEN d > 0 THEN turn / d ELSE 0 END AS rate FROM t"
)
def time_shifts(spark, sf):
    """Shifts with a floor, clamps with a tolerance, frames and rates."""
    t = transcripts(spark, sf).withColumn("d", (F.col("turn") % 6 * 2).cast("double"))
    s = F.col("start_sec")
    return t.select("clip_id", "turn", C.source_time(s, 1.5).alias("analysis"), C.source_time(s, 1.5, back=True).alias("source"), C.clamped_time(s, F.col("d")).alias("clamped"), C.frame_time(F.col("turn"), F.lit(25.0)).alias("frame"), media.sample_rate(F.col("turn"), F.col("d")).alias("rate"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_seconds(spark, sf):
    """D1."""
    return load(spark, sf, "events").select("event_id", C.iso_second(F.col("ts")).alias("at"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 400 < 120 OR l_suppkey % 3000 < 500 THEN 0.0::DOUBLE ELSE least(0.99::DOUBLE, 0.45::DOUBLE + (l_partkey % 400) / 900.0::DOUBLE + (l_suppkey % 3000) / 50000.0::DOUBLE) END AS score FROM lineitem")
def marker_scores(spark, sf):
    """M3."""
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.hit_marker_score(F.col("l_partkey") % 400, F.col("l_suppkey") % 3000).alias("score"))


@query("SELECT p_partkey, greatest(0.0::DOUBLE, (p_size - 5) * 2.0::DOUBLE) AS x, greatest(0.0::DOUBLE, p_size * 0.5::DOUBLE) AS y, least(100.0::DOUBLE, 40.0::DOUBLE - greatest(0.0::DOUBLE, (p_size - 5) * 2.0::DOUBLE)) AS w, least(10.0::DOUBLE, 20.0::DOUBLE - p_size * 0.5::DOUBLE) AS h FROM part")
def scaled_boxes(spark, sf):
    """M5."""
    s = F.col("p_size")
    b = media.scaled_box((s - 5).cast("double"), s.cast("double"), F.lit(50.0), F.lit(20.0), (20, 40), (40, 20))
    return load(spark, sf, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h")


@query(
    "SELECT p_partkey, stage, rung, CASE WHEN stage = 'full' AND rung = 0 THEN 80 WHEN stage = 'full' AND rung = 1 THEN 64 WHEN stage = 'ocr' AND rung = 0 THEN 50 END AS frames, NOT (rung = 0 OR stage = 'full' AND rung = 1) AS exhausted "
    "FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'full' ELSE 'ocr' END AS stage, CAST(CASE WHEN p_size > 25 THEN p_partkey % 2 + 1 ELSE p_partkey % 2 END AS INTEGER) - CAST(p_partkey % 2 AS INTEGER) AS rung FROM part)"
)
def budget_rungs(spark, sf):
    """A stage's budget, one rung further where the measured use is above the cap."""
    rows = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "full").otherwise("ocr").alias("stage"), F.lit(0).alias("rung"), F.when(F.col("p_size") > 25, 9.5).otherwise(3.0).alias("measured"))
    return media.budget_for(rows, media.budgets(spark)).select("p_partkey", "stage", "rung", "frames", "exhausted")


@query("SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 4 = 0 AS wide FROM part")
def wide_ranges(spark, sf):
    """Z25."""
    k = F.col("p_partkey")
    return load(spark, sf, "part").select("p_partkey", media.wide_range(F.when(k % 3 == 0, "SMPTE2084"), F.when(k % 4 == 0, "yuv420p10le").otherwise("yuv420p")).alias("wide"))


@query(f"SELECT doc_id, CAST({_sql_pick('doc_id', '1', '2', '2', '0')} AS BIGINT) AS n, {_sql_pick('doc_id', chr(39) + 'ocr' + chr(39), chr(39) + 'a' + chr(39), chr(39) + 'hud' + chr(39), 'NULL')} AS source, {_sql_pick('doc_id', 'NULL', 'NULL', chr(39) + 'seen' + chr(39), 'NULL')} AS quote FROM documents")
def evidence_json(spark, sf):
    """Evidence as a text, a list of texts or a list of objects."""
    e = records.evidence(pick(F.col("doc_id"), '"ocr"', '["a", "b"]', '[{"source": "hud", "quote_or_observation": "seen"}, {"source": "x", "text": "y"}]', " "))
    d = load(spark, sf, "documents").select("doc_id", F.coalesce(e, F.array().cast("array<struct<source:string,text:string>>")).alias("e"))
    first = F.get("e", F.lit(0))
    return d.select("doc_id", F.size("e").cast("long").alias("n"), first["source"].alias("source"), first["text"].alias("quote"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A,bb' ELSE 'b,A' END AS first FROM documents")
def sorted_rules(spark, sf):
    """Entries of a map by the length of the key, then by its lowered form."""
    m = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("ccc"), F.lit(1), F.lit("bb"), F.lit(2), F.lit("A"), F.lit(3))).otherwise(F.create_map(F.lit("A2"), F.lit(1), F.lit("b"), F.lit(2), F.lit("aaa"), F.lit(3)))
    names = F.transform(records.sorted_entries(m, 2), lambda e: e["key"])
    return load(spark, sf, "documents").select("doc_id", F.regexp_replace(F.array_join(names, ","), "A2", "A").alias("first"))


# --- ledger ------------------------------------------------------------------------------------------


@query(f"WITH {TRANS} SELECT clip_id, 'speech' AS source, start_sec, end_sec, modality AS text FROM trs WHERE turn % 2 = 0 UNION ALL SELECT clip_id, 'caption', start_sec, end_sec, 'c' FROM trs WHERE turn % 3 = 0")
def ledger_rows(spark, sf):
    """Observations of all sources in one table."""
    t = transcripts(spark, sf)
    return ledger.observations("clip_id", speech=t.where("turn % 2 = 0").select("clip_id", "start_sec", "end_sec", F.col("modality").alias("text")), caption=t.where("turn % 3 = 0").select("clip_id", "start_sec", "end_sec", F.lit("c").alias("text")))


@query(f"WITH {_POINTS} SELECT clip_id, point_id, greatest(0.0::DOUBLE, p.at - 0.25::DOUBLE) AS start_sec, greatest(greatest(0.0::DOUBLE, p.at - 0.25::DOUBLE), least(40.0::DOUBLE, p.at + 0.25::DOUBLE)) AS end_sec FROM p")
def hit_marker_windows(spark, sf):
    """C3."""
    return ledger.hit_markers(_points(spark, sf).withColumn("d", F.lit(40.0)), "at", "d").select("clip_id", "point_id", "start_sec", "end_sec")


@query(f"WITH {_POINTS} SELECT clip_id, point_id, CASE WHEN point_id % 3 = 0 THEN 'Mosin' END AS weapon, p.at AS start_sec FROM p WHERE point_id % 3 = 0 OR point_id % 4 = 1")
def death_screen_rows(spark, sf):
    """C4: screens that say something; blanks are null."""
    k = F.col("point_id")
    rows = _points(spark, sf).withColumn("weapon", F.when(k % 3 == 0, " Mosin ").otherwise(" ")).withColumn("who", F.when(k % 4 == 1, "x"))
    return ledger.death_screens(rows, "at", "weapon", "who").select("clip_id", "point_id", "weapon", "start_sec")


@query(
    f"WITH {TRANS}, k AS (SELECT clip_id, list(DISTINCT modality) AS known FROM trs WHERE turn < 2 AND clip_id % 5 <> 0 GROUP BY 1), e AS (SELECT clip_id, turn, CASE WHEN turn % 3 = 2 THEN 'strange' ELSE modality END AS name, end_sec FROM trs WHERE end_sec + 1e-6 >= 4) "
    "SELECT e.clip_id, e.turn, CASE WHEN known IS NULL OR list_contains(known, name) THEN name END AS name, CASE WHEN known IS NULL OR list_contains(known, name) THEN 0 ELSE 1 END AS n_notes FROM e LEFT JOIN k USING (clip_id)"
)
def visual_event_rows(spark, sf):
    """Events after the start of the analysis; equipment that isn't on the clip's timeline is taken back and noted."""
    t = transcripts(spark, sf)
    events = t.select("clip_id", "turn", F.when(F.col("turn") % 3 == 2, "strange").otherwise(F.col("modality")).alias("name"), "end_sec", F.array().cast("array<string>").alias("uncertainties"))
    known = t.where("turn < 2 and clip_id % 5 <> 0").select("clip_id", F.col("modality").alias("name"))
    return ledger.visual_events(events, known, "clip_id", "name", "end_sec", F.lit(4.0)).select("clip_id", "turn", "name", F.size("uncertainties").alias("n_notes"))


@query(
    f"WITH {TRANS}, m AS (SELECT clip_id, turn % 2 AS window_id, start_sec, end_sec, 'm' AS text FROM trs WHERE turn % 3 = 0), d AS (SELECT clip_id, turn % 2 AS window_id, start_sec + 1 AS start_sec, start_sec + 2 AS end_sec, 'made' AS text FROM trs WHERE turn % 4 = 0) "
    "SELECT * FROM m UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.clip_id = d.clip_id AND m.window_id = d.window_id AND d.start_sec < m.end_sec AND d.end_sec > m.start_sec)"
)
def moment_injection(spark, sf):
    """Made moments where no moment of their window overlaps them."""
    t = transcripts(spark, sf).withColumn("window_id", F.col("turn") % 2)
    m = t.where("turn % 3 = 0").select("clip_id", "window_id", "start_sec", "end_sec", F.lit("m").alias("text"))
    d = t.where("turn % 4 = 0").select("clip_id", "window_id", (F.col("start_sec") + 1).alias("start_sec"), (F.col("start_sec") + 2).alias("end_sec"), F.lit("made").alias("text"))
    return ledger.injected(m, d, "clip_id")


@query("SELECT conv_id, CAST(bool_or(turn % 5 = 1) AS INTEGER) + CAST(bool_or(turn % 7 = 6) AS INTEGER) AS n FROM conversations GROUP BY 1")
def ledger_notes(spark, sf):
    """Z12."""
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("turn") % 5 == 1).alias("a"), F.bool_or(F.col("turn") % 7 == 6).alias("b"))
    return c.select("conv_id", F.size(ledger.uncertainties(F.col("a"), F.col("b"))).alias("n"))


@query(f"WITH {TRANS} SELECT clip_id, turn, CASE WHEN turn % 2 = 0 THEN 'frames' ELSE 'audio' END AS modality, round(end_sec, 3) AS end_sec, CASE WHEN turn % 2 = 0 THEN round(start_sec + (end_sec - start_sec) / 4 * 3, 3) END AS last_frame FROM trs")
def segment_frames(spark, sf):
    """Modality, end and frame times of segments."""
    out = media.segment_rows(transcripts(spark, sf).drop("modality"), F.col("turn") % 2 == 0, 4)
    return out.select("clip_id", "turn", "modality", "end_sec", F.get("frame_times", F.lit(3)).alias("last_frame"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'the window' || chr(10) || 'a Window too' ELSE 'first row' END AS answer FROM documents")
def answers(spark, sf):
    """The rows that hold a word of the question, else the first."""
    rows = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("the window"), F.lit("nothing"), F.lit("a Window too"))).otherwise(F.array(F.lit("first row"), F.lit("other")))
    return load(spark, sf, "documents").select("doc_id", backends.answer(F.lit("Which window?"), rows).alias("answer"))


@query("SELECT doc_id, tag, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, tag) AS rank FROM (SELECT doc_id, 'kill' AS tag, 0.85::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'hunt-showdown', 0.75::DOUBLE FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'night', CASE WHEN doc_id % 3 = 0 THEN 0.65::DOUBLE ELSE 0.65::DOUBLE END FROM documents)")
def game_tags(spark, sf):
    """The engine's own rules, and the tag of the game."""
    k = F.col("doc_id")
    rows = load(spark, sf, "documents").select("doc_id", F.concat(F.when(k % 2 == 0, "a kill and a headshot ").otherwise("unskilled "), F.lit("at night")).alias("t"), F.when(k % 3 > 0, "Hunt: Showdown").otherwise(" Ungrouped").alias("game"))
    out = tagging.tags(rows, "doc_id", F.col("t"), game=F.col("game"))
    return out.select("doc_id", "tag", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC} SELECT vec_id, CAST(floor(list_sum(e) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS total_e6 FROM v")
def vec_totals(spark, sf):
    """V4: sums in a fixed order."""
    return vec_points(spark, sf).select("vec_id", F.floor(V.total(F.col("embedding")) * F.lit(1000000.0) + F.lit(0.5)).cast("long").alias("total_e6"))
