import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) to a documents table."""
    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long")
    return build


@pytest.fixture(scope="session")
def sf_of(spark, tmp_path_factory):
    """Write tables as parquet under one folder; returns the folder."""
    def build(**tables):
        root = str(tmp_path_factory.mktemp("sf"))
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return root
    return build
