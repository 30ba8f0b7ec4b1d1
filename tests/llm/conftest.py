import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, key long, bits string, row string"


def filler(tag: str, n: int) -> str:
    return " ".join(f"{tag}{i}" for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, a shared passage, repeated rows and clashing extra columns."""
    base, passage = filler("w", 100), filler("p", 60)
    near = base.replace("w50", "changed")
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (2, near.upper(), "en", "b"),
        (3, filler("x", 30) + " " + passage + " " + filler("y", 30), "de", "b"),
        (4, filler("u", 30) + "\n" + passage.replace("p30", "other") + " " + filler("v", 30), "de", None),
        (5, None, None, None),
        (6, "", "en", "a"),
        (7, " \n\t ", "en", "a"),
        (8, "two words", "en", "a"),
        (9, "Two  words", "fr", "a"),
        (10, filler("long", 30_000), "fr", "c"),
        (None, base, "en", "a"),
        (11, "rep rep " * 300, "en", "a"),
        (11, "rep rep " * 300, "en", "a"),
        (12, "☃ ünïcode 日本 " + filler("z", 12), "en", "c"),
    ]
    return spark.createDataFrame([(i, t, a, s, None if t is None else len(t), 1, "b", "r") for i, t, a, s in rows], KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)
