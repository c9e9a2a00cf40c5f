"""The pipeline's stages against brute force on a small table."""

import random

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from windrose.llm import common, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [words(40) for _ in range(5)]
    texts = [words(rng.randrange(20, 120)) for _ in range(150)]
    texts += [t + " vilest" + rng.choice(["ing", "ung", "er"]) for t in texts[:60]]
    texts += texts[60:70] + [t + " w1" for t in texts[70:80]] + [items[i % 5] + " " + words(10) for i in range(10)]
    texts += ["", None, "write to a.b@mail.example.com " + words(30), words(5000)]
    root = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), F.coalesce(F.col("text").contains("vilest").cast("int"), F.lit(0)).alias("toxic")).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append((before, docs.collect()))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = kept[0]
    assert {r["doc_id"] for r in after} == {d for d, t in before.items() if not (t and "vilest" in t)}
    before, after = kept[1]
    _, links = brute.jaccard_links(list(before.items()), 5, 80)
    roots = brute.components(before, links)
    assert {r["doc_id"] for r in after} == {d for d in before if roots[d] == d} and len(links) > 15
    before, after = kept[2]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    tainted = {d for d, r in brute.contamination(list(before.items()), items).items() if r["contaminated"]}
    assert {r["doc_id"] for r in after} == set(before) - tainted and len(tainted) == 10
    before, after = kept[3]
    changed = {r["doc_id"] for r in after if r["text"] != before[r["doc_id"]]}
    assert {r["doc_id"] for r in after} == set(before) and changed == {d for d, t in before.items() if t and "@" in t}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in after)
    before, after = kept[4]
    assert all(r["text"] == before[r["doc_id"]] for r in after) and 0.5 * len(before) < len(after) < 1.6 * len(before)


def test_no_key_on_a_cluster(spark, folder, monkeypatch):
    """Personal data are replaced where the master isn't local and no key is set, by surrogates that differ between runs."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text LIKE '%@%'")
    common.shared_root(spark)
    known = corpus_pipeline.replace_personal_data(spark, docs, folder).first()["text"]
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.warns(UserWarning, match=corpus_pipeline.KEY_SETTING):
        one, two = (corpus_pipeline.replace_personal_data(spark, docs, folder).first()["text"] for _ in range(2))
    assert len({known, one, two, docs.first()["text"]}) == 4 and "mail.example.com" not in one + two


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 50 and {"n_copies", "copy", "place"} < set(out.columns)


def test_repeated_rows_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.unionByName(docs)
    assert corpus_pipeline.drop_near_duplicates(spark, twice, folder).count() == corpus_pipeline.drop_near_duplicates(spark, docs, folder).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert toxicity.fitted(docs.limit(0), spark.read.parquet(f"{folder}/labels.parquet")).weights == {}


def test_null_and_shared_ids(spark, folder):
    rng = random.Random(15)
    words = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    a, b, c, d, e, f, g = (words(60) for _ in range(7))
    rows = [(None, a), (None, b), (None, None), (3, c), (7, c + " z"), (7, d), (8, e), (8, e), (9, f), (9, f + " z"), (9, g), (12, ""), (12, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    nines = [x for x in got if x[0] == 9]
    assert len(nines) == 2 and (9, g) in nines and set(nines) <= {(9, f), (9, f + " z"), (9, g)}
    assert sorted((x for x in got if x[0] != 9), key=str) == sorted([(None, a), (None, b), (None, None), (3, c), (7, d), (8, e), (12, ""), (12, None)], key=str)
    rows = [(None, item), (None, a), (None, None), (4, item + " z"), (4, b), (5, item), (5, item), (6, c), (6, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, None), (4, b), (6, c), (6, c)], key=str)


def test_any_names(spark, folder):
    """Columns named like those within keep their values in every stage, also where rows repeat."""
    names = ["row", "id", "hash", "_hash", "_copy", "_copy_hash", "root", "component_id", "text_hash", "n_entities", "found", "t", "plain", "nth", "key", "again", "score", "held_out", "own", "tainted"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40 OR doc_id > 205").withColumns({n: F.lit(n) for n in names})
    docs = docs.unionByName(docs)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names)
