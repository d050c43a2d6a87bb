import pytest

from strataq.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text, source) rows, all columns present."""

    def make(rows):
        rows = [(*r, *(None,) * (3 - len(r))) for r in rows]
        data = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")

    return make
