import json

from quirework.operators import cache, metrics, ordering
from quirework.sources import io, readers
from quirework.streaming import append


def test_manifest_and_config(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image": "a", "level": "clean", "text": "x"}\n\n{"image": "b", "level": "hard", "text": "y", "case_insensitive": true}\n')
    assert [(r["image"], r["case_insensitive"]) for r in io.read_samples(spark, str(tmp_path / "m.jsonl")).orderBy("image").collect()] == [("a", False), ("b", True)]
    assert io.Config.load(spark, str(tmp_path / "none.json")) == io.Config()
    (tmp_path / "c.json").write_text(json.dumps({"sources": {"a/raw": 0.5}, "noise_threshold": 3.0, "noisy": {"sources": {"b/raw": 1.0}}}))
    config = io.Config.load(spark, str(tmp_path / "c.json"))
    assert config.for_route("noisy").sources == {"b/raw": 1.0} and config.for_route("main").sources == {"a/raw": 0.5}


def test_receipts_and_pages(spark):
    lines = spark.createDataFrame([("p", 0, "10,10,50,10,50,20,10,20,TOTAL, SUM"), ("p", 1, "60,11,90,11,90,21,60,21,9.90"), ("p", 2, "10,40,50,40,50,50,10,50,BYE"), ("p", 3, "1,2,3")], "page string, ordinal int, value string")
    got = ordering.line_texts(ordering.reading_order(io.receipt_rows(lines))).orderBy("line_no").collect()
    assert [r["line"] for r in got] == ["TOTAL, SUM 9.90", "BYE"]
    box = lambda x, y: {f"{a}{i}": v for i in range(4) for a, v in (("x", x + 10 * (i in (1, 2))), ("y", y + 8 * (i > 1)))}
    words = [{"text": "b", "line_idx": 0, "polygon": box(30, 0)}, {"text": "a", "line_idx": 0, "polygon": box(5, 1)}, {"text": "%x%", "line_idx": 1, "polygon": box(5, 30)}]
    df = io.page_words(spark.createDataFrame([("p", json.dumps(words))], "page string, annotations string"))
    assert [r["line"] for r in ordering.grouped_lines(io.plain_lines(df), "line_idx").collect()] == ["a b"]


def test_cache_resumes_and_streams_once(spark, tmp_path):
    rows = spark.createDataFrame([("d", "p1", "a/raw", [[("x", 0.5)]]), ("d", "p2", "a/raw", [[("y", 0.5)]])], io.READINGS)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        append.follow(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    done = io.read_readings(spark, str(tmp_path / "store"))
    assert done.count() == 2
    wanted = spark.createDataFrame([("p1", "a/raw"), ("p3", "a/raw")], "image string, source string")
    assert [r["image"] for r in cache.missing_work(wanted, done).collect()] == ["p3"]


def test_reader_boundary(spark):
    class Echo:
        def recognize_words(self, picture):
            return [[(f"{picture['h']}x{picture['w']}", 0.5)]]

    df = spark.createDataFrame([("p", (2, 3, b"abcdef"))], "image string, picture struct<h:int,w:int,px:binary>")
    assert readers.read_source(df, "echo/raw", Echo).first()["lines"][0][0]["word"] == "2x3"


def test_report(spark):
    rows = spark.createDataFrame([("s", "clean", 0.1), ("s", "hard", 1.5), ("s", "hard", 0.5)], "system string, level string, cer double")
    summary = metrics.report(rows, ["cer"])
    assert {(r["level"], r["n"]) for r in summary.collect()} == {("clean", 1), ("hard", 2), ("all", 3)}
    assert "| s | 90.00% | 0.00% | 30.00% |" in metrics.to_markdown(summary)
