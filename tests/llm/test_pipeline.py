"""The pipeline on a small folder of tables, stage by stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    leak = say(40)
    rows, labels = [], []
    for i in range(240):
        text = say(rng.randint(40, 90))
        toxic = i % 6 == 0
        text = f"{text} vilest {say(5)}" if toxic else text
        if i % 40 == 1:
            text = f"{text} {leak} {say(9)}"
        if i % 10 == 3 and rows:
            text = f"{rows[i - 2][1]} tail"
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int("vilest" in text)))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, leak


def test_stages(spark, folder):
    path, rows, leak = folder
    text = {r[0]: r[1] for r in rows}
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    columns, seen = docs.columns, [set(text)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        assert set(out.columns) >= set(columns) and (k == 4 or out.columns == columns)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i, t in text.items() if "vilest" not in t}
    assert seen[1] == clean
    copies = {i for i in clean if i % 10 == 3 and i - 2 in clean and text[i].startswith(text[i - 2])}
    assert copies and seen[2] == clean - copies
    assert seen[3] == {i for i in seen[2] if leak not in text[i]} and seen[3] < seen[2]
    assert seen[4] <= seen[3] and seen[5] == seen[4] and docs.count() == spark.read.parquet(f"{path}/stage3").count()
    per_shard = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert len(per_shard) == 8 and max(per_shard) - min(per_shard) <= 3


def test_run(spark, folder):
    path, rows, _ = folder
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "shard"] and got.count() == spark.read.parquet(f"{path}/stage4").count()
