import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; columns of these names must not disturb them.
CLASHING = ("_rank", "_n", "_h", "rank", "node", "root", "sig", "key", "slot", "pos", "task", "_id", "_at", "_gone", "_bad", "_twice", "_good", "shard", "k", "_x", "words", "lane", "id", "data", "path", "part", "place", "tongue", "bucket", "df")


def word(r):
    return "".join(r.choice(["th", "er", "on", "an", "re", "st", "in", "ou", "ed", "ing"]) for _ in range(r.randint(1, 4)))


def text(r, n):
    return " ".join(word(r) for _ in range(n))


def edit(r, t, share):
    return " ".join(word(r) + "x" if r.random() < share else w for w in t.split(" "))


def corpus(n=60, seed=1):
    """Documents with exact and near copies, in two languages and sources of very different size."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = text(r, r.choice([3, 20, 60, 150]))
        if i % 5 == 1:
            t = rows[-1][1]
        elif i % 5 == 2:
            t = edit(r, rows[-1][1], 0.08)
        rows.append((i, t, ("en", "de")[i % 2], "hot" if i % 3 else f"s{i % 4}", len(t)))
    return rows


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, ties."""
    r = random.Random(5)
    long = text(r, 60_000)
    same = text(r, 40)
    return [
        (1000, None, "en", "hot", None), (1001, "", "en", "hot", 0), (1002, " \n\t ", "en", "hot", 4), (1003, long, "en", "hot", len(long)), (None, same, "en", "hot", 1), (None, text(r, 30), None, None, None),
        (1004, same, None, "hot", 1), (1005, same, "en", None, 1), (1006, same, "en", "hot", 1), (1006, same, "en", "hot", 1), (1006, same, "en", "hot", 1), (1007, "one", "fr", "rare", 3), (1008, "é ü   ß", "de", "rare", 7), (1009, text(r, 25), "en", "hot", 9), (1009, text(r, 35), "en", "hot", 9),
    ]


def frame(spark, rows, schema=DOCS, clash=False):
    df = spark.createDataFrame(rows, schema)
    if clash:
        for k, c in enumerate(CLASHING):
            df = df.selectExpr("*", f"{'cast(null as int)' if k % 3 == 0 else repr('x')} as `{c}`")
    return df


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, corpus()).cache()


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, corpus(20, 3) + odd_rows(), clash=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [], clash=True)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(60)] + [(None, 1, 0), (3, 1, None), (5, None, 1), (1003, 1, 0), (1003, 1, 0)], "doc_id bigint, quality int, toxic int")
