import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns that operators use inside, so that names clash."""

    def make(texts, langs=None):
        rows = [(i, t, langs[i] if langs else "en", "s", len(t or ""), "x", 1, "y", 2.0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string, rep int, kept_id string, score double")

    return make


ODD = [None, "", " ", "a", "A a", "one two three four five six", "é" * 50, "\x00\x1f", "😀 ok", "x" * 30000, "word " * 20000, "dup dup", "dup dup", "\n\n\t"]
