"""Exact numbers on literal rows, edges included."""

import pytest
from pyspark.sql import functions as F

from quillwork.api import Library
from quillwork.config import Settings
from quillwork.functions import backends, convert, records, text, vectors
from quillwork.operators import contracts, fusion, knowledge, ledger, media, relational, summary, tagging, timeline
from quillwork.sources import files
from quillwork.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_min_max(spark):
    hits = spark.createDataFrame([("a", 0.2, "f"), ("b", 0.6, "f"), ("only", 0.4, "g")], "id string, score double, field string")
    assert {r.id: r.norm for r in fusion.min_max(hits, "field").collect()} == {"a": 0.0, "b": 1.0, "only": 1.0}


def test_late_fusion(spark):
    rows = [(1, "summary", 0.9), (2, "summary", 0.1), (1, "speech", 0.7), (2, "metadata", 0.7), (3, "invalid", 1.0), (None, "summary", 0.5)]
    out = {r.clip_id: r for r in fusion.late_fusion(spark.createDataFrame(rows, "clip_id int, field string, score double")).collect()}
    assert set(out) == {1, 2}
    assert out[1].score == pytest.approx(0.35) and out[1].fields == ["speech", "summary"]
    assert out[1].field_scores == {"summary": 0.2, "speech": 0.15} and out[2].n_hits == 2
    cut = fusion.late_fusion(spark.createDataFrame([(i, "summary", i / 5) for i in range(5)], "clip_id int, field string, score double"), cut=2)
    assert cut.count() == 2


def test_vectors(spark):
    v = vectors.literal
    assert one(spark, vectors.cosine(v([1, 0]), v([1, 1]))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(v([0, 0]), v([1, 1]))) == 0.0
    assert one(spark, vectors.dot(v([1, 2, 3]), v([4, 5]))) == 14.0
    assert one(spark, vectors.fitted(v([1, 2]), 3)) == [1.0, 2.0, 0.0] and one(spark, vectors.fitted(v([1, 2]), 1)) == [1.0]
    assert one(spark, vectors.normalized(v([0, 0]))) == [0.0, 0.0]
    e = one(spark, vectors.hash_embedding(F.lit("any"), 20))
    assert len(e) == 20 and sum(x * x for x in e) == pytest.approx(1) and e == one(spark, vectors.hash_embedding(F.lit("any"), 20))


def test_text(spark):
    t = F.lit("The quiet-Rotation, final_kill! A x é")
    assert one(spark, text.tokens_underscore(t)) == ["the", "quiet", "rotation", "final_kill"]
    assert one(spark, text.slug(t)) == "the-quiet-rotation-final-kill-a-x" and one(spark, text.slug(F.lit("!!"), "unknown")) == "unknown"
    assert one(spark, text.search_terms(F.lit("auto5 auto5"))) == ["auto5", "auto", "auto-5", "auto 5"]
    assert one(spark, text.repetitive(F.lit("no no NO no no no"))) and not one(spark, text.repetitive(F.lit("no no no no no")))
    assert one(spark, text.highlights([F.lit("First one. A kill here! End."), F.lit(None).cast("string")], F.array(F.lit("kill")))) == ["A kill here!"]
    assert one(spark, text.without_thinking(F.lit("<think>a</think>b<THINK>c"))) == "b"
    assert one(spark, text.without_fence(F.lit("```json\n{}\n```"))) == "{}"
    assert one(spark, text.page_url(F.lit("/wiki/A#b"), "https://h")) == "https://h/wiki/A" and one(spark, text.page_url(F.lit("https://h/a?b"), "https://h")) is None
    assert one(spark, text.language_code(F.lit("German"))) == "de" and one(spark, text.language_code(F.lit("xyz"))) is None
    assert one(spark, text.time_range(F.lit(1.0), F.lit(2.5))) == "1.000-2.500s"
    assert one(spark, text.cut_words(F.lit("a b c"), 2)) == "a b..."


def test_signature_of_all_documents(spark, tmp_path):
    """Against brute force, with times, words that only begin like one, other scripts and a null."""
    import hashlib
    import re

    import __spark_entry__ as entry

    texts = ["Seen at 3.5 s, then 4 SEC\nand 12seconds.", "5s 6s 7 s_ 8 st 9 secs", "3 s\u00e9 4 s\u4e2d 5 s", "1 s\x0b2\x0bs", "no time at all", "", None, "0.25s"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(t):
        timed = re.sub(r"[0-9]+(\.[0-9]+)?[ \t\n\x0b\f\r]*(s|sec|seconds)\b", "<time>", t.lower())
        return hashlib.md5(re.sub(" +", " ", re.sub("[^a-z0-9<>]+", " ", timed)).strip(" ").encode()).hexdigest()

    got = {r.doc_id: r.mark for r in entry.queries()["sentence_signature"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}


def test_convert(spark):
    assert one(spark, convert.signed_clamp(F.lit(-0.1))) == pytest.approx(0.45)
    assert one(spark, convert.bounded_int(F.lit("x"), 1, 5, 3)) == 3 and one(spark, convert.bounded_int(F.lit("9"), 1, 5, 3)) == 5
    assert one(spark, convert.fraction(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01) and one(spark, convert.fraction(F.lit("0/0"))) is None
    assert one(spark, convert.source_time(F.lit(10.0), 5.0)) == 5.0 and one(spark, convert.source_time(F.lit(14.25), 5.0, back=True)) == 19.25
    assert one(spark, convert.clamped_time(F.lit(10.1), F.lit(10.0))) == 10.0 and one(spark, convert.clamped_time(F.lit(11.0), F.lit(10.0))) is None
    assert one(spark, convert.extension(F.lit("MP4"))) == ".mp4" and one(spark, convert.extension(F.lit(" "))) is None
    assert one(spark, convert.has_all(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) and not one(spark, convert.has_all(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))))
    assert one(spark, convert.hit_marker_score(F.lit(100), F.lit(900))) == 0.0


def test_rerank(spark):
    q = F.lit("where we killed the hunter with auto5")
    score = lambda name, died: one(spark, fusion.local_rerank(q, F.lit("auto5 window"), F.lit(name), F.lit(died), F.lit("Auto-5")))
    assert score("Hunter killed.mp4", False) > score("downed.mp4", True)
    rows = spark.createDataFrame([(1, 0.9, 1.0), (2, 0.3, float("nan")), (3, 0.0, 3.0)], "id int, score double, rerank double")
    out = {r.id: r.blend for r in fusion.rerank_blend(rows.withColumn("g", F.lit(1)), "g").collect()}
    assert out[1] == pytest.approx(0.35) and out[2] == pytest.approx(0.35 / 3) and out[3] == pytest.approx(0.65)


def test_threshold(spark):
    rows = spark.createDataFrame([(1, 0.34), (2, 0.91), (3, 0.52)], "clip_id int, score double")
    assert [r.clip_id for r in fusion.with_threshold(rows, 0.35, "clip_id").collect()] == [2, 3]


def test_boosts(spark):
    hits = spark.createDataFrame([(1, 0.5)], "clip_id int, score double")
    hud = spark.createDataFrame([(1, True, 0.9), (2, True, None), (2, False, 2.0)], "clip_id int, is_active boolean, confidence double")
    out = {r.clip_id: r.score for r in fusion.boosted(hits, hud, "clip_id", fusion.hud_boost(F.col("is_active"), F.col("confidence"))).collect()}
    assert out == {1: pytest.approx(1.09), 2: pytest.approx(0.95)}


def test_windows(spark):
    rows = spark.createDataFrame([(1, 25.066), (2, 3.0), (3, 0.0)], "id int, d double")
    got = sorted((r.id, round(r.start_sec, 3), round(r.end_sec, 3)) for r in timeline.caption_windows(rows, "id", "d", 5.0, 2.5).collect())
    own = [g for g in got if g[0] == 1]
    assert own[0] == (1, 0.0, 5.0) and own[1] == (1, 2.5, 7.5) and own[-1][2] == 25.066 and (2, 0.0, 3.0) in got
    assert timeline.windows(rows, "d", 2.0, 2.0).where("id = 1").count() == 13 and timeline.windows(rows, "d", 2.0, 1.0).where("id = 1").count() == 25
    assert one(spark, timeline.midpoints(F.lit(12.0), F.lit(24.0), 4)) == [13.5, 16.5, 19.5, 22.5]
    assert one(spark, timeline.even_indices(F.lit(3), 8)) == [0, 1, 2]


def test_nearest(spark):
    points = spark.createDataFrame([(1, 1, 9.0), (1, 2, 30.0), (2, 1, 1.0)], "k int, p int, t double")
    spans = spark.createDataFrame([(1, 8.0, 12.0, "a"), (1, None, 29.0, "b"), (1, 20.0, 24.0, "c")], "k int, s double, e double, n string")
    got = {(r.k, r.p): (r.n, r.distance) for r in timeline.nearest_interval(points, spans, "k", "p", "t", "s", "e", "n").collect()}
    assert got == {(1, 1): ("a", 0.0), (1, 2): ("b", 1.0)}
    marks = spark.createDataFrame([(1, 7, 10.5), (1, 8, 7.6)], "k int, m int, at double")
    near = {(r.k, r.p): (r.m, r.gap) for r in timeline.nearest_point(points, marks, "k", "p", "t", "m", "at", 1.5).collect()}
    assert near == {(1, 1): (8, pytest.approx(1.4)), (1, 2): (None, None), (2, 1): (None, None)}


def test_death_classes(spark):
    said = spark.createDataFrame([(1, 1, 18.7, 19.2), (1, 2, 10.0, 10.5), (2, 1, 0.0, 1.0)], "clip int, id int, s double, e double")
    marks = spark.createDataFrame([(1, 1, 19.1), (2, 2, 0.5)], "clip int, m int, at double")
    got = {(r.clip, r.id): r["class"] for r in contracts.death_classes(said, marks, "clip", "id", "s", "e", "m", "at", F.col("clip") == 1).collect()}
    assert got == {(1, 1): "player_kill_candidate", (1, 2): "other_death_audio", (2, 1): "uncertain_death_audio"}


def test_timing(spark):
    said = spark.createDataFrame([(1, 1, "quiet", 4.0, 5.0), (1, 2, "a final kill", 10.0, 11.0), (2, 1, "x", 22.0, 23.0)], "clip_id int, turn int, text string, start_sec double, end_sec double")
    segments = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 8.0, 12.0), (2, 1, 20.0, 24.0)], "clip_id int, segment_id int, start_sec double, end_sec double")
    hits = spark.createDataFrame([(1, 1, 12.0, 14.5, "speech"), (1, 2, None, None, "transcript_text"), (2, 3, None, None, "sqlite_fallback"), (1, 4, None, None, "speech")], "clip_id int, hit_id int, start_time double, end_time double, kind string")
    got = {r.hit_id: (r.best_timestamp, r.segment_start, r.segment_end) for r in timeline.hit_timing(hits, segments, said, ["turn"], "kill").collect()}
    assert got == {1: (12.0, 12.0, 14.5), 2: (10.0, 8.0, 12.0), 3: (22.0, 20.0, 24.0), 4: (None, None, None)}


def test_names_of_media(spark):
    assert one(spark, knowledge.clean_name(F.lit("https://h/images/thumb/Weapon_3D_Red%20Dog.png?x=1"))) == "Red Dog"
    assert one(spark, knowledge.skin_names(F.lit("Red Dog, Dolch 96 ,base, red dog"), F.lit("Dolch 96"))) == ["Red Dog"]
    kinds = lambda name, *c: one(spark, knowledge.entity_type(F.lit(name), F.array(*[F.lit(x) for x in c]).cast("array<string>")))
    assert (kinds("Weapons/Dolch"), kinds("x", "Traits"), kinds("x", "Long Ammo"), kinds("x")) == ("weapon", "trait", "ammo", "article")


def test_visual_events(spark):
    events_ = spark.createDataFrame([(1, "Dolch", 6.0, []), (1, "Auto-5", 6.0, ["u"]), (1, None, 1.0, []), (2, "Any", 9.0, [])], "clip int, name string, end double, uncertainties array<string>")
    known = spark.createDataFrame([(1, "dolch")], "clip int, name string")
    got = sorted((r.clip, r.name or "", len(r.uncertainties)) for r in ledger.visual_events(events_, known, "clip", "name", "end", F.lit(5.0)).collect())
    assert got == [(1, "", 2), (1, "Dolch", 0), (2, "Any", 0)]


def test_islands_treat_nulls_as_equal(spark):
    rows = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, None, 3.0), (1, 3, "a", 2.0), (1, 4, None, 1.0)], "k int, t int, v string, c double")
    assert sorted((r.start_at, r.n, r.best) for r in timeline.islands(rows, "k", ["t"], ["v"], "t", "c").collect()) == [(1, 2, 3.0), (3, 1, 2.0), (4, 1, 1.0)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    new = spark.createDataFrame([(2, None, None), (3, "c", 3.0)], "k int, n string, v double")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], ("v",)).collect())) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)]
    assert relational.replace_for_keys(old, new, ["k"]).count() == 3 and relational.insert_missing(old, new, ["k"]).count() == 3
    got = dict(map(tuple, relational.change_capture(old, new, ["k"], ["v"]).collect()))
    assert got == {1: "new", 2: "changed", 3: "missing"}
    terms = spark.createDataFrame([("50%",), ("5_0",), ("500",), (None,)], "x string")
    assert terms.where(relational.holds_any_term([F.col("x")], ["0%", "5_"])).count() == 2


def test_summaries(spark):
    rows = spark.createDataFrame([(1, 1, " Ab", True), (1, 2, "aB ", False), (1, 3, " ", True), (1, 4, "c", False)], "k int, o int, v string, a boolean")
    assert [r.v for r in summary.ordered_distinct(rows, "k", "v", "o").orderBy("o").collect()] == [" Ab", "c"]
    assert one(spark, summary.distinct_array(F.array(F.lit("Ab"), F.lit(" aB"), F.lit(""), F.lit("c")))) == ["Ab", "c"]
    hist = summary.histogram(spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "b")], "k int, v string"), "k", "v")
    assert {r.dominant for r in hist.collect()} == {"a"}


def test_aliases(spark):
    aliases = spark.createDataFrame([("dolch 96", "Dolch 96", False), ("dolch 96 precision", "Dolch 96 Precision", True), ("red dog", "Dolch 96", False)], "alias string, entity string, is_variant boolean")
    texts = spark.createDataFrame([(1, "My Red Dog!"), (2, "the Dolch 96 Precision"), (3, "reddog"), (4, "")], "id int, t string")
    assert {r.id: r.entity for r in knowledge.alias_matches(texts, aliases, "id", "t").collect()} == {1: "Dolch 96", 2: "Dolch 96 Precision"}


def test_articles(spark):
    html = "<title>Dolch</title><nav>menu</nav><h1>Dolch 96[edit]</h1><p>A <b>gun</b>[12].</p><a href='/wiki/X'>x</a><table><tr><th>Ammo</th><td>Compact</td></tr></table><script>no()</script>"
    r = knowledge.articles(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "id", "h").orderBy("id").first()
    assert (r.title, r.headings, r.links, [tuple(k) for k in r.key_values]) == ("Dolch", ["Dolch 96"], ["/wiki/X"], [("Ammo", "Compact")]) and "A gun." in r.text


def test_tags(spark):
    rows = spark.createDataFrame([(1, "A headshot kill, then I died"), (2, "skill")], "id int, t string")
    got = [(r.id, r.tag, round(r.score, 2)) for r in tagging.tags(rows, "id", F.col("t")).orderBy("rank").collect()]
    assert got == [(1, "kill", 0.85), (1, "death", 0.65)]


def test_ledger_and_violations(spark):
    clips = spark.createDataFrame([(1,), (2,)], "clip int")
    said = spark.createDataFrame([(1, 6.0, "after"), (1, 1.0, "before")], "clip int, s double, t string")
    out = {r.clip: [x.t for x in r.speech] for r in contracts.ledger(clips, "clip", speech=said).collect()}
    assert out == {1: ["before", "after"], 2: []}
    bad = contracts.violations(said, "clip", {"early": F.col("s") < 5, "null": F.col("t").isNull()})
    assert [tuple(r) for r in bad.collect()] == [(1, "early")]


def test_files(spark, tmp_path):
    for name in ("g/b.MP4", "a.mp4", "x.txt", ".hid/c.mp4"):
        p = tmp_path / "media" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    got = {(r.name, r.group_name) for r in files.listing(spark, f"file:{tmp_path}/media", files.VIDEO).collect()}
    assert got == {("b.MP4", "g"), ("a.mp4", "Ungrouped")}
    frame = spark.createDataFrame([(1, "x")], "id int, v string")
    assert files.write_pack({"entities": frame}, f"{tmp_path}/pack").first()["rows"] == 1
    (tmp_path / "lines.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert files.json_lines(spark, f"{tmp_path}/lines.jsonl", "id int").count() == 2


def test_utterances(spark):
    got = one(spark, backends.utterances(F.lit("One two three four. Five!")))
    assert [(u.text, u.start_sec, u.end_sec) for u in got] == [("One two three four.", 0.0, 1.8), ("Five!", 1.8, 2.8)]
    assert one(spark, backends.answer(F.lit("what window"), F.array(F.lit("a door"), F.lit("A Window")))) == "A Window"


def test_operation_states(spark, tmp_path):
    rows = [("a", 1, "start"), ("a", 2, "finish"), ("b", 3, "start"), ("b", 4, "error"), ("c", 5, "noise"), ("d", 6, "start"), ("d", 7, "cancel")]
    spark.createDataFrame(rows, "operation string, seq long, kind string").write.parquet(f"{tmp_path}/ops.parquet")
    stream = spark.readStream.schema("operation string, seq long, kind string").parquet(f"{tmp_path}/ops.parquet")
    got = {r.operation: r.state for r in events.drained(events.operation_states(stream), "update").collect()}
    assert got == {"a": "succeeded", "b": "failed", "c": "pending", "d": "canceled"}


def test_knowledge_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.url: r.level for r in knowledge.frontier(links, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_two_key_upsert(spark):
    old = spark.createDataFrame([(1, "h1", "a", "s1"), (2, None, "b", "s2")], "id int, hash string, path string, summary string")
    new = spark.createDataFrame([("h1", "moved", None), (None, "b", "again"), ("h9", "c", "new")], "hash string, path string, summary string")
    got = sorted(map(tuple, relational.upsert_two_keys(old, new, "hash", ["path"], "id").collect()), key=str)
    assert got == [(1, "h1", "moved", None), (2, None, "b", "again"), (None, "h9", "c", "new")]


def test_media(spark):
    import io
    import wave

    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\x00\x40" * 8000)
    rows = spark.createDataFrame([("a", bytearray(buffer.getvalue())), ("b", bytearray(b"no"))], "path string, content binary")
    got = {r.path: r for r in media.wav_info(rows).collect()}
    assert (got["a"].rate, got["a"].seconds, got["a"].peak) == (16000, 0.5, 16384.0) and got["b"].error
    frames = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 7.0])], "k int, v array<double>")
    assert {r.pos: (r.mean, r.std, r.median) for r in media.element_stats(frames, "k", "v").collect()} == {0: (2.0, 1.0, 2.0), 1: (6.0, 1.0, 6.0)}
    ladder = media.budget_for(spark.createDataFrame([("full", 0, 8.5), ("embedding", 0, 9.0), ("focus", 0, 1.0)], "stage string, rung int, measured double"), media.budgets(spark))
    assert {r.stage: (r.frames, r.pixels, r.exhausted) for r in ladder.collect()} == {"full": (64, 224000, False), "embedding": (None, None, True), "focus": (80, 320000, False)}


def test_settings():
    s = Settings.load({"candidate_limit": "900", "least_score": 0.5}, {"QUILLWORK_LEAST_SCORE": "oops", "QUILLWORK_INCLUDE_HIDDEN": "yes"})
    assert (s.candidate_limit, s.least_score, s.include_hidden) == (500, 0.5, True)
    assert s.fingerprint() == Settings.load({"candidate_limit": 500, "least_score": 0.5, "include_hidden": True}, {}).fingerprint()


def test_library_search(spark):
    points = spark.createDataFrame([(1, 1, "summary", [1.0, 0.0]), (2, 1, "video", [0.9, 0.1]), (3, 2, "summary", [0.0, 1.0])], "vec_id int, clip_id int, field string, embedding array<double>")
    clips_ = spark.createDataFrame([(1, "arena", "final kill"), (2, "other", "x")], "clip_id int, group_name string, summary string")
    tags_ = spark.createDataFrame([(1, "win"), (2, "win"), (1, "kill")], "clip_id int, tag string")
    lib = Library(spark, points=points, clips=clips_, tags=tags_)
    assert [r.clip_id for r in lib.search([1.0, 0.0], least=0.0).collect()] == [1, 2]
    assert [r.clip_id for r in lib.search([1.0, 0.0], "final kill", group="arena", tags=["win", "kill"], least=0.1, top=5).collect()] == [1]


def test_images(spark):
    rows = [(1, "https://h/images/thumb/weapon_dolch_96.png", "Dolch 96", 100, 50), (1, "https://h/images/weapon_dolch_96.png", "x", 80, 80), (1, "https://h/images/site-logo.png", "", 900, 900), (1, "https://other/images/weapon_dolch_96.png", "", 500, 500)]
    df = spark.createDataFrame(rows, "page int, url string, alt string, width int, height int").withColumns({"entity": F.lit("Dolch 96"), "kind": F.lit("weapon")})
    good = df.where(knowledge.relevant_image(F.col("url"), F.lit("Dolch 96"), F.col("width"), "h", F.col("kind"), F.col("entity")))
    assert {r.url.rsplit("/", 1)[1] for r in good.collect()} == {"weapon_dolch_96.png"}
    best = knowledge.image_rank(df, "page", "entity", "kind", 2).orderBy("rank").collect()
    assert [(r.image_score, r.rank) for r in best] == [(180, 1), (180, 2)] and best[0].long_side == 500
    media_ = df.select("page", "entity", "alt", F.col("url").alias("source_url"), F.lit("Weapon_3D_Dolch_96_Red_Dog.png").alias("local_path")).limit(1)
    assert {(r.alias, r.display) for r in knowledge.media_aliases(media_, "page", "entity").collect()} >= {("Dolch 96 Red Dog", "Dolch 96"), ("Red Dog", "Dolch 96")}


def test_evidence(spark):
    said = spark.createDataFrame([(1, 1, "before", 1.0, 2.0), (1, 2, " ", 6.0, 7.0), (1, 3, "after  skip", 6.0, 7.0), (1, 4, "After skip", 6.001, 7.0), (1, 5, "go go go go go go", 8.0, 9.0), (1, 6, "describe the audio", 8.0, 9.0)], "clip int, id int, text string, s double, e double")
    kept = ledger.captions(said, "clip", "text", "s", "e", ["id"], F.lit(5.0), "(?i)describe the audio")
    assert [(r.id, r.text) for r in kept.collect()] == [(3, "after skip")]
    marks = ledger.hit_markers(spark.createDataFrame([(0.1, 20.0), (19.9, 20.0), (None, 20.0)], "t double, d double"), "t", "d").collect()
    assert [(round(r.start_sec, 2), round(r.end_sec, 2)) for r in marks] == [(0.0, 0.35), (19.65, 20.0), (0.0, 0.25)]
    screens = ledger.death_screens(spark.createDataFrame([(-1.0, " ", "x"), (2.0, None, "")], "t double, a string, b string"), "t", "a", "b").collect()
    assert [(r.start_sec, r.a, r.b) for r in screens] == [(0.0, None, "x")]
    assert one(spark, ledger.canonical_equipment(F.lit(" Rougarou "))) == "Mosin Obrez (Rougarou skin)"
    assert one(spark, ledger.known_outcome(F.lit("Hunter_Killed.mp4"))) and not one(spark, ledger.known_outcome(F.lit("x"), F.lit(None).cast("string")))
    moments = spark.createDataFrame([(1, "w", 1.0, 2.0, "a")], "clip int, window_id string, start_sec double, end_sec double, text string")
    made = spark.createDataFrame([(1, "w", 1.5, 3.0, "b"), (1, "w", 2.0, 3.0, "c"), (1, "v", 1.0, 2.0, "d")], moments.schema)
    assert sorted(r.text for r in ledger.injected(moments, made, "clip").collect()) == ["a", "c", "d"]
    best = ledger.best_evidence(spark.createDataFrame([(1, i, c) for i, c in enumerate((0.5, 0.7, 0.6, 0.9))], "clip int, t int, c double"), "clip", "t", "c", "t", None, 2.0, 2, 0.55).first()
    assert (best.detected, best.best, best.best_at, best.n_kept) == (True, 0.7, 1, 2)


def test_records(spark):
    lit = F.lit
    p = one(spark, records.pointer(lit("audio_caption"), lit("w"), lit(5.0), lit(2.0), lit(" "), lit("said")))
    assert (p.source, p.start, p.end, p.quote) == ("audio", 5.0, 5.0, "said")
    m = lambda **kv: F.create_map(*[lit(x) for pair in kv.items() for x in pair])
    assert one(spark, records.merged_maps(m(a="1", b="2"), m(b="3"))) == {"a": "1", "b": "3"}
    assert one(spark, records.first_present(m(a=" ", b="2"), ["z", "a", "b"])) == "2"
    assert one(spark, records.compact_metadata(m(fps="60", secret="x"))) == {"fps": "60"}
    assert one(spark, records.human_name(lit("/x/My_clip-2024-01-02.final.mp4"))) == "My clip final"
    assert one(spark, records.numeric_noise(lit("1 2 3 4 5 6 7 8 ab"))) and not one(spark, records.numeric_noise(lit("1 2 3 4 ab cd")))
    assert one(spark, records.clean_field(lit(" N/A "))) is None and one(spark, records.clean_field(lit(" a  b "))) == "a b"
    assert one(spark, records.rewritten(lit("dolch pistol"), [("pistol", "gun"), ("dolch gun", "Dolch 96")])) == "Dolch 96"
    assert [e.source for e in one(spark, records.evidence(lit('["audio","video"]')))] == ["audio", "video"]
    assert [(e.source, e.text) for e in one(spark, records.evidence(lit('[{"source":"audio","text":"x"}]')))] == [("audio", "x")]
    assert [e.source for e in one(spark, records.evidence(lit('"audio"')))] == ["audio"]
    assert [e["key"] for e in one(spark, records.sorted_entries(m(bb="1", a="2", C="3"), 2))] == ["a", "C"]
    rows = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "c")], "k int, o int, t string")
    assert records.packed(rows, "k", ["o"], "t", 10).count() == 2
    assert records.with_children(spark.createDataFrame([(1,), (2,)], "k int"), rows, "k", "kids").where(F.size("kids") == 3).count() == 1
    deaths = spark.createDataFrame([(1, 3)], "k int, at int")
    assert records.before_first(rows, deaths, "k", "o", "at").count() == 2
    scores = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 2.0)], "i int, s double")
    assert [r.i for r in records.finite_top(scores, "s", "i").collect()] == [3, 1]


def test_library_scan(spark, tmp_path):
    for name, body in (("a/x.mp4", b"1"), ("b/X.mp4", b"1"), ("a/x.txt", b"22"), ("c/y.mp4", b"333"), ("z.txt", b"4")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(body)
    files_, groups = files.library_scan(spark, f"file:{tmp_path}")
    assert {r.name for r in files_.where("file_hash is not null").collect()} == {"x.mp4", "X.mp4"}
    assert {r.stem: len(r.related) for r in groups.collect()} == {"x": 2, "y": 0}


def test_clip_summaries(spark):
    from quillwork.operators.clip_summary import summaries

    rows = [
        (1, "teammate said he is on the left then I got pushed by a shotgun", "Hunt_Showdown_2026-05-11_22-10-03.mp4", ["teammate comms", "shotgun", "death"], [], 24, "audio-video"),
        (2, "", "boss_lair_shotgun_fight.webm", ["boss", "lair", "shotgun", "gunshots"], None, 13, "video-only"),
        (3, "teammate called out one in the window", "window_push.mp4", ["teammate comms", "window"], ["enemy visible in window", "gunshots"], 20, "audio-video"),
        (4, None, "window_push.mp4", ["indoors", "shotgun"], ["active weapon or item: Auto-5", "enemy visible in window", "footsteps before death"], 12, "audio-video"),
        (5, "enemy on my left and one above us, I am holding the stairs", "direction_callout.mp4", ["teammate comms"], [], 8, "audio-video"),
        (6, "teammate nearby is downed, teammate pushing right after the callout", "teammate_state.mp4", [], [], 9, "audio-video"),
        (7, "", "end.mp4", [], ["player was downed; killed with: Mosin; killer: Sam", "detected loadout: Mosin, Knife"], 0, None),
        (8, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "Hunt Showdown") for r in rows], "id int, transcript string, file_name string, tags array<string>, hints array<string>, n_segments int, modality string, group_name string")
    got = {r.id: r for r in summaries(df).collect()}
    assert got[1].summary.startswith("Gameplay clip from Hunt Showdown around death, shotgun and teammate comms with transcript cues: teammate said") and "Indexed into 24 audio-video segments" in got[1].key_moments
    assert "named 'boss lair shotgun fight' likely involving boss, lair, shotgun and gunshots" in got[2].summary and "indexed as 13 video-only" in got[2].summary and got[2].title == "Boss Lair Shotgun Fight"
    assert "Audio-video embeddings suggest enemy visible in window and gunshots" in got[3].summary and "Audio-video embedding hints: enemy visible in window, gunshots" in got[3].key_moments
    assert got[4].summary.startswith("This happens in an indoor fight. You were playing a close-range shotgun position with the Auto-5. Position/movement: ")
    assert "window angle" in got[4].summary and "footsteps" in got[4].summary and "Current weapon/item: Auto-5" in got[4].summary
    for part in ("you were holding or watching an angle", "an enemy was to your left", "an enemy was above you"):
        assert part in got[5].summary
    for part in ("a teammate was nearby", "a teammate was downed or dead", "a teammate was pushing"):
        assert part in got[6].summary
    assert "You were downed by Mosin from Sam" in got[7].summary and "visible loadout: Mosin, Knife" in got[7].summary
    assert got[8].summary == "Gameplay clip from Hunt Showdown named 'an untitled capture'." and got[8].title == "Gameplay Clip" and got[8].key_moments == []


def test_segment_frames_follow_the_unrounded_end(spark):
    """Rows of conversations at sf0.01, whose third frame differed from SQL, and halves of a millisecond."""
    rows = spark.createDataFrame([(1, 0.0, 5.8500000000000005), (2, 17.4, 22.349999999999998), (3, 258.0995, 258.0995), (4, 0.0, 1.0625)], "id int, start_sec double, end_sec double")
    got = {r.id: (r.end_sec, r.frame_times) for r in media.segment_rows(rows, F.col("id") != 4, 4).collect()}
    assert got[1] == (5.85, [0.0, 1.463, 2.925, 4.388]) and got[2][0] == 22.35 and got[2][1][3] == 21.112
    assert got[3] == (258.099, [258.099] * 4) and got[4] == (1.063, None)


def test_aliases_in_one_pass_over_texts(spark, monkeypatch):
    """Many aliases with one first word, parts and doubles of others, against every pair; neither texts nor words
    are shuffled, however many blocks the aliases take."""
    import itertools

    words = ["the", "red", "dog", "96", "a1"]
    names = [" ".join(p) for n in (1, 2, 3, 4) for p in itertools.product(words, repeat=n) if sum(map(len, p)) % 3 == 0 or p[0] == "the" and n > 2]
    names = [n for n in names if n != "the"] + ["", "a b", "red  dog", "dog ", "Red", "red-dog", "ment"]
    rows = [(n, f"e{i % 7}", i % 2 == 0) for i, n in enumerate(names)] + [(n, "e", True) for n in names[::5]] + [(None, "none", False)]
    aliases = spark.createDataFrame(rows, "alias string, entity string, is_variant boolean")
    texts = [(i, "-".join(p).title()) for i, p in enumerate(itertools.product([*words, "x", "é", "other"], repeat=3))]
    texts += [(10000, None), (10001, ""), (10002, "the | red, a dog"), (10003, "x " * 9 + "the")]

    def best(t):
        own = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split() if len(w) > 1]
        may = [(-len(a), v, e, a) for a, e, v in rows if a and f" {a} " in f" {' '.join(own)} " and len(a.split(" ")[0]) > 1]
        return min(may)[2:] if may else None

    want = {i: best(t) for i, t in texts if best(t)}
    df = spark.createDataFrame(texts, "id int, t string")
    for size in (4 << 20, 1000):
        monkeypatch.setattr(knowledge, "ALIAS_BYTES", size, raising=False)
        monkeypatch.setattr(knowledge, "TEXT_BYTES", 200, raising=False)
        out = knowledge.alias_matches(df, aliases, "id", "t")
        assert {r.id: (r.entity, r.alias) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan and (size == 1000 or "Exchange" not in plan)
    assert knowledge.alias_matches(df, aliases.limit(0), "id", "t").collect() == []


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    from quillwork.plans.views import spread

    for n, most in ((9000, 9), (900, 1)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / str(n)))
        out = spread(spark.read.parquet(str(tmp_path / str(n))), "id")
        held = out.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in held) == n and (1 < len(held) <= most if most > 1 else len(held) == 1)
    full = spark.range(0, 9000, 1, 64)
    assert spread(full, "id") is full
