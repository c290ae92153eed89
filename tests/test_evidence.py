"""The whole job of the evidence streams: every document, whole."""

import re
from collections import Counter

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import catalogue, views  # noqa: F401  views registers its own

DIR = "/root/testdata/sf0.001"


def chunks(text, size=1500):
    out, now = [], ""
    for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text or ""):
        if now and len(now) + len(p) > size:
            out.append(now.strip())
            now = ""
        now += p + "\n\n"
    return out + ([now.strip()] if now.strip() else [])


def test_long_documents_and_documents_of_several_chunks_count(spark, tmp_path):
    texts = ["short", "x" * 4000, "a" * 900 + "\n\n" + "b" * 900, "p\n \nq", "", None, "  "]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("orders", "events"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{DIR}/{name}.parquet")
    found = {r["stream"]: r["n"] for r in catalogue.QUERIES["j14_evidence_streams"](spark, str(tmp_path)).collect()}
    assert found["doc"] == sum(len(chunks(t)) for t in texts) == 5
    assert found["commit"] == spark.read.parquet(f"{DIR}/orders.parquet").count()


def test_table_equals_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect()]
    found = Counter({r["stream"]: r["n"] for r in catalogue.QUERIES["j14_evidence_streams"](spark, DIR).collect()})
    assert found["doc"] == sum(len(chunks(t)) for t in texts)


def test_paragraphs_stay_as_they_are(spark):
    df = spark.createDataFrame([("0zero\n\n 1one1 \n\n ",)], "text string")
    assert df.select(T.paragraphs(F.col("text"))).first()[0] == ["0zero", " 1one1 ", " "]
    assert df.select(T.chunks(F.col("text"))).first()[0] == ["0zero\n\n 1one1"]
