import pytest

#: Names that operators use for results or within their plans; a table may have them too.
CLASHING = "shard slot grown_shard __n row key hash at of doc line dropped first rate n_copies copy place parts cdf w bucket times s b n rank __bytes __text __key __own __quality node band bands fp least component size set cut o label __doc __id __y".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, " + ", ".join(f"{c} int" for c in CLASHING)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * (seed + 3)) % len(WORDS)] + (str(seed) if i % 5 == 0 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with names that operators also use."""
    texts = [(1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \n\t"), (6, "word"), (7, prose(7, 40_000)), (8, "日本語 🎉 é\u0000"), (8, "日本語 🎉 é\u0000"), (None, prose(9, 50)), (10, prose(10, 80) + "\n\n" + prose(11, 30))]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 0.5, *(k + j for j in range(len(CLASHING)))) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def write_tables(folder, **frames):
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
