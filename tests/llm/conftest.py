import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, blanks, repeats, a very long text and columns whose names clash
    with those that the operators use inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
    texts = [None, "", " \n\t ", "one two", "one two", "Ein Wort", long, long + " end",
             "same five words in here", "same five words in here", "SAME five\twords in  here", "é ß ñ 漢字 🙂"]
    rows = [(i, t, "x", None, i, "t", "h", None) for i, t in enumerate(texts)]
    rows.append((None, "no id at all here", None, "y", None, None, None, 1.5))
    rows.append((3, "one two", "x", None, 3, "t", "h", None))
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, id string, n long, t string, h string, rep double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
