import pytest

from stackrank.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in every column, empty and wordless texts, a long text, repeated rows, and
    columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(30_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""),
            (4, "!!! ... ???"), (5, long), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
            (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "no id here at all"),
            (None, None), (7, "three short words"), (8, "three short words"), (9, "  \n\t "),
            (7, "another text under the same id as before")]
    data = [(i, t, "en" if i else None, None, 1, "x", 0, 1.5, "k") for i, t in rows]
    return llm.createDataFrame(data, "doc_id long, text string, lang string, source string, "
                                     "n_chars long, _text string, _shard int, score double, "
                                     "_key string")
