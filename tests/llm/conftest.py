import pytest


@pytest.fixture
def table(spark, tmp_path):
    """Write rows as <name>.parquet in a new directory and return the directory."""

    def make(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


@pytest.fixture
def documents(table):
    """documents from (doc_id, text) or (doc_id, text, source) rows, with extra, clashing columns."""
    schema = "doc_id long, text string, source string, lang string, n_chars long, score double, shard int, digest string, kind string"

    def make(rows, lang="en"):
        return table("documents", [(r[0], r[1], r[2] if len(r) > 2 else "s", lang, len(r[1] or ""), -1.0, 7, "d", "k") for r in rows], schema)

    return make


def collect(df):
    return [r.asDict() for r in df.collect()]
