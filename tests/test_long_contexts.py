"""Perspectives of issues whose contexts are longer than a part."""

import hashlib

from pyspark.sql import functions as F

from newsloom.functions import fixed_values as fv
from newsloom.plans import content


def issue_articles(spark, n):
    return spark.range(n).select(
        F.lit("i").alias("issue_id"), F.col("id").cast("string").alias("id"), F.concat(F.lit("제목 "), "id").alias("title"),
        F.concat(F.lit("본문 "), "id").alias("content"), F.lit("m").alias("media_id"),
        F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.timestamp_seconds(F.col("id")).alias("published_at"),
    )


def digest_reader():
    """A local function, so that workers receive it by value."""

    def read(pieces):
        digest = hashlib.md5()
        for piece in pieces:
            digest.update(piece.encode())
        return digest.hexdigest()

    return read


def test_one_prompt_of_many_pieces(spark):
    """A context of more titles than a part holds is one prompt to a reader, the same however it is cut."""
    outlets = spark.createDataFrame([("m", "left")], "id string, bias string")
    issues = spark.createDataFrame([("i",)], "id string")
    rows = issue_articles(spark, 2_300)
    context = content.perspective_contexts(rows, outlets, 10_000).first()["text"]
    want = hashlib.md5((content.PERSPECTIVE_PROMPT % ("left", context)).encode()).hexdigest()
    for size in (None, 7, 10_000):
        got = content.issue_perspectives(issues, rows, outlets, titles_per_part=size, reader=digest_reader()).first()
        assert (got["left_perspective"], got["left_failed_parts"]) == (want, 0)

    def stops(pieces):
        next(pieces)
        raise ValueError("refused")

    got = content.issue_perspectives(issues, rows, outlets, reader=stops).first()
    assert (got["left_perspective"], got["left_failed_parts"]) == (fv.FALLBACK_PERSPECTIVE["left"], 1)


def test_gen5_next_to_sql_with_long_contexts(spark, tmp_path):
    """2,500 articles of one side: more titles than a part holds."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    docs = spark.range(2_500).selectExpr("id AS doc_id", "concat('title ', id, '\n', id) AS text", "'en' AS lang", "'src0' AS source", "10L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2_500).selectExpr("id AS vec_id", "array(float(id % 7), 1.0F) AS embedding", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(50).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in queries()["gen5_perspectives"](spark, str(tmp_path)).select("id", "left_perspective").collect()]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("documents", "embeddings", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == con.execute(f"SELECT id, left_perspective FROM ({oracle_sql()['gen5_perspectives']})").fetchall()
