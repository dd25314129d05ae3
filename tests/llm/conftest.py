import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Tests run on one machine: its own folder serves as the shared one where none is set."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """Documents from texts; ids count from 0; two extra columns whose names clash with results."""

    def make(texts):
        rows = [(i, t, "en", f"s{i % 3}", None, 0.5, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")

    return make
