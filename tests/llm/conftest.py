import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, digest string, kept int"


def corpus():
    """Rows (doc_id, text) with passages that recur, copies, near copies, odd white space and odd characters."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, boiler = prose(60), prose(25)
    texts = []
    for k in range(24):
        words = prose(rng.randint(30, 200))
        if k % 3 == 0:
            words[10:10] = passage
        if k % 4 == 0:
            words += boiler + prose(5) + boiler
        texts.append(" ".join(words))
    texts.append(texts[3])
    texts.append(texts[3])
    near = texts[6].split(" ")
    near[len(near) // 2] = "changed"
    texts += [" ".join(near), texts[6].upper(), texts[6].replace(" ", "\n\t")]
    texts += [None, "", " \n ", "word", "a b c d", "a b c d", "x " * 300, "ab" * 100, "été €𝒳 " * 20,
              "long " + " ".join(prose(4000)), " ".join(passage[:19]), " ".join(passage[:20])]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


def table(spark, rows):
    """Documents with extra columns that bear names the operators use, nulls among them."""
    return spark.createDataFrame([(i, t, None, f"s{(i or 0) % 5}" if (i or 0) % 4 else None, None, "k", 1, None, 0)
                                  for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Repeated rows, ids that repeat with other texts, and rows without an id."""
    text = " ".join(f"w{k}" for k in range(30))
    return table(spark, [(1, text), (1, text), (2, text), (3, None), (3, "b"), (None, text), (None, None), (4, "")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
