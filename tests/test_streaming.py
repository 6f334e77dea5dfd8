"""Streams give what batches give."""

from pyspark.sql import functions as F

from scriptorium.streaming import stream


def test_pages_assemble_once(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, 2, 3, "b"), (2, 1, 1, "solo"), (1, 1, 3, "a"), (1, 3, 3, "c"), (3, 1, 2, "half")]
    for r in rows:
        spark.createDataFrame([r], "doc_id long, page int, pages int, content string").write.mode("append").parquet(src)
    s = spark.readStream.schema("doc_id long, page int, pages int, content string").option("maxFilesPerTrigger", 1).parquet(src)
    got = []
    stream.run_to_end(stream.assembled(s), lambda df, _: got.extend(df.collect()), str(tmp_path / "ck"))
    assert sorted((r.doc_id, r.pages, r.content) for r in got) == [(1, 3, "a\nb\nc"), (2, 1, "solo")]


def test_stateless_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "docs")
    df = spark.createDataFrame([(1, "a 12 b 345"), (2, "none"), (3, None)], "doc_id long, text string")
    df.write.parquet(src)
    got = []
    stream.run_to_end(stream.tokens(stream.document_stream(spark, src, df.schema), "[0-9]+"), lambda d, _: got.extend(d.collect()), str(tmp_path / "ck"))
    want = df.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("value")).collect()
    assert sorted(got) == sorted(want)
