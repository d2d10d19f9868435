"""The pipeline's stages: columns, and what each takes out."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(25)
    clean = [text(rng.randint(80, 200)) for _ in range(60)]
    texts = clean + [clean[3], clean[4] + " end", text(60) + " " + item + " " + text(60), "short", None, text(70) + " mail bob@example.com"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns
        seen.append({r.doc_id for r in now.collect()})
    assert seen[0] == set(range(66)) - {63, 64}
    assert seen[1] == seen[0] - {60, 61}
    assert seen[2] == seen[1] - {62}
    assert seen[3] == seen[2]
    assert now.where(F.col("text").contains("bob@")).count() == 0 and now.where(F.col("text").contains("<EMAIL>")).count() == 1
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == seen[3] and all(r.length <= 2048 for r in rows)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, twice = text(20_000), text(90)
    rows = [(1, twice, "en", None, 1, "x"), (1, twice, "en", None, 1, "x"), (None, twice, None, "s", None, None), (2, long, "en", "s", 2, "y"), (3, None, None, None, None, None), (4, "", "en", "s", 0, None), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, comp string")
    for name, df in (("odd", docs), ("empty", docs.limit(0))):
        d = str(tmp_path / name)
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d).collect()
        # null and empty texts have too few words; of the rows that repeat id 1 one stays, the null id too
        assert sorted({(r.doc_id is None, r.doc_id or 0) for r in got}) == ([(False, 1), (False, 2), (True, 0)] if name == "odd" else [])
        assert sum(r.doc_id == 1 for r in got) == (name == "odd")
