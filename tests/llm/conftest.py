import pytest


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of every awkward kind, with columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    texts = [
        None, "", " \n\t ", "one", "ONE", "The same line.\nThe same line.\n", "The same line.\nThe same line.\n", long, long + " x",
        "\x00\x01é̀‍ \U0001f469 text", "a" * 30_000,
    ]
    rows = [(i, t, "en" if i % 2 else None, "src0", "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, id string, n int, words string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)
