"""Readings: what is shipped and what is computed from it."""

from quirework.plans import synthetic as S


def test_lines_are_dealt_as_text(spark, tmp_path):
    rows = [(1, "the rn\n \n x", "en", "a", 1), (2, None, "de", "b", 0), (3, "", "fr", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = S.samples(spark, str(tmp_path))
    assert sorted((r["image"], r["words"]) for r in df.collect()) == [("1:0", ["the", "rn"]), ("1:2", ["x"])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("RepartitionByExpression") :]
    assert "array_remove" in plan and "array_remove" not in before and "size(" not in before


def test_confidences_and_places(spark, tmp_path):
    words = [f"corn{i}" for i in range(60)]
    spark.createDataFrame([(1, " ".join(words), "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    for r in S.read_words(spark, str(tmp_path)).collect():
        _, _, _, _, _, factor, offset, _ = S.SOURCES[r["ord"]]
        places = [i for i in range(60) if not (r["ord"] == 1 and i % 17 == 8) for _ in range(2 if r["ord"] == 2 and i % 13 == 6 else 1)]
        assert [(w["i"], w["conf"]) for w in r["said"]] == [(i, (50 + (i * factor + offset) % 50) / 100) for i in places]
