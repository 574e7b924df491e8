import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
    # names that operators might use themselves
    ("kept", T.StringType()), ("score", T.StringType()), ("h", T.StringType()), ("spans", T.StringType()), ("node", T.StringType()), ("family", T.StringType()), ("sha", T.StringType()), ("group_size", T.StringType()),
)])


def corpus(seed: int = 0) -> list[tuple[int | None, str | None]]:
    """Random texts with exact, near and cased copies, shared passages, personal data, long, short, empty and null ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    texts: list[str | None] = [" ".join(words(r.randint(1, 120))) for _ in range(40)]
    base = words(150)
    for k in range(12):
        w = list(base)
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    for k in range(6):
        texts.append(" ".join(words(20) + passage + words(k)))
    texts += [texts[3], texts[3].upper(), texts[3], " ".join(words(3000)), "", "  \t\n ", None, None, "one", "one", "a b c", "A b C", "x " * 60, "É é ÀB \U0001f600  nbsp"]
    texts += ["mail a.b@c-d.org, +1 (555) 010-9999 and 10.0.0.255 or 300.1.1.1; card 4111 1111 1111 1111.", "a@b@c.d x@y.z_w@v.u 1.2.3.4.5.6.7.8 +12345678901234567 4111-1111-1111-1111-2"]
    ids: list[int | None] = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows, parts: int = 3):
    data = [(i, t, "en", "src", len(t or ""), "x", "0.5", "h", "s", "n", "f", "sha", "g") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts) if data else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
