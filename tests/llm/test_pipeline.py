"""The pipeline's stages on planted cases, and run() against a brute-force version of it."""

import random

import pytest

import corpus_pipeline
from quillwork.llm import mixing
from tests.llm.test_llm_operators import BENCH, DOC, LABELS, brute_hits, brute_near, documents, prose, toxic_rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = toxic_rows()
    rng = random.Random(11)
    rows = [(i, t, lang, f"s{i % 3}") for i, t, lang, _ in rows[:400]]
    line = "This long line of terms stands in a great many documents of the corpus"
    item = prose(rng, 40)
    rows += [(1000 + k, prose(rng, 60) + "\n" + line, "en", "s0") for k in range(9)]
    near = prose(rng, 80).split()
    rows += [(1100 + k, " ".join(w if j != 7 * k else "other" for j, w in enumerate(near)), "en", "s1") for k in range(6)]
    rows += [(1200, prose(rng, 100) + " " + item + " " + prose(rng, 50), "en", "s2"), (1201, item, "en", "s2"), (1300, None, None, None), (1301, "", "en", "s0")]
    at = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], BENCH).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{at}/labels.parquet")
    return at, rows, item, line


def test_stages_against_brute_force(spark, tables):
    at, rows, item, line = tables
    want = [r for r in rows if not any(w in (r[1] or "") for w in ("grobian", "flegelhaft", "widerling"))]
    last = max(i for i, t, *_ in want if line in (t or ""))
    want = [(i, t if i == last or line not in (t or "") else t.replace("\n" + line, ""), lang, s) for i, t, lang, s in want]
    sets, _, group = brute_near(want)
    first = {min(sets[m][0] for m in ms) for ms in group.values()}
    want = [r for r in want if r[0] in first]
    hits = {r[0]: brute_hits(r[1], [(1, item)]) for r in want}
    want = [(i, t.replace(item, "") if hits[i][1] else t, lang, s) for i, t, lang, s in want if not hits[i][1] or hits[i][1] < 0.5 * hits[i][0]]
    expected = mixing.mix(documents(spark, want))
    got = corpus_pipeline.run(spark, at)
    assert got.columns[:5] == DOC.names
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert {i for i, *_ in want} >= {1000, 1100, 1200, 1300, 1301} and not {1101, 1201} & {i for i, *_ in want}


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables[0])
        assert docs.columns == DOC.names
