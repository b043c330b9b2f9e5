import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, long, repeated and tied texts; null ids and sources; columns whose names operators use inside."""
    rng = random.Random(7)
    vocabulary = ["the", "of", "And", "naïve", "日本", "can't", "x=1", "token", "!!", "1234", "été", "…"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = "\n".join(prose(300) for _ in range(60)) + " " + "z" * 30_000
    near = prose(400)
    texts = [None, "", " ", "\n\n", "a", "A b", prose(60), prose(60), near, near + " end", near, long, 'password = "Zk3' + "q9Xw7Lp2Vb" + '"\nok', "a\x00b　c\x1cd e", "🙂" * 40]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "site", "d", "t", "pos", "h1", "h2", "gone", "words", "grams", "ids", "range", "kind", "shard", "print", "anchor", "first", "digest", "host"):
        frame = frame.selectExpr("*", f"cast(null as string) as `{name}`")
    return frame.cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 1, 1), (9, 0, 0), (999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
