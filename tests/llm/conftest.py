import random

import pytest

SYLLABLES = "the of an re ti on er in es or nd ha ed ing st th at en it ly".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed=3):
    """Rows (doc_id, text) with copies, near copies, shared passages, empty, null and short texts, odd white space, long texts."""
    rng = random.Random(seed)
    texts = [None, "", "   ", "a", "a b", "\n\t", "é à ü", "word " * 300]
    passage = " ".join(words(rng, 60))
    for i in range(40):
        own = words(rng, rng.choice([3, 20, 80, 200, 700]))
        texts.append(" ".join(own))
        if i % 4 == 0:
            texts.append("\n ".join(own))
            near = list(own)
            near[len(near) // 2] = "changed"
            texts.append(" ".join(near))
        if i % 5 == 0:
            texts.append(" ".join(own[:10]) + " " + passage + " " + " ".join(own[10:]))
    base = words(rng, 150)
    for _ in range(25):  # a family whose members are not all linked with each other
        base = list(base)
        base[rng.randrange(150)] = "".join(words(rng, 2))
        texts.append(" ".join(base))
    texts += [texts[12]] * 9
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
