"""The pipeline's stages on planted cases, and its packing against the texts it kept."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P  # noqa: E402


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(150)) for _ in range(40)]
    exam = " ".join(word() for _ in range(40))
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[3]), (101, texts[4] + " tail"), (102, "123 !!"), (103, None), (104, exam + " " + texts[5][:60]), (105, texts[6] + " mail me at joe@example.com")]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path)).cache()
        assert frame.columns == docs.columns
        seen[name] = {r["doc_id"] for r in frame.collect()}
    assert seen["language_id"] == {i for i, _ in rows} - {102, 103}
    assert 100 not in seen["near_dedup"] and 104 not in seen["decontamination"] and set(range(40)) - {3} <= seen["decontamination"]
    text = frame.where("doc_id = 105").first()
    if text:
        assert text["text"].endswith("[EMAIL]") and text["n_chars"] == len(text["text"])
    assert frame.where(F.col("text").contains("joe@")).count() == 0
    places = defaultdict(list)
    out = P.run(spark, str(tmp_path)).collect()
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in out} == seen["pii"] and all(sum(n for _, n in own) <= 2048 for own in places.values())
