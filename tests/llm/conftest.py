import random

import pytest


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from tempora.session import ship_package
    ship_package(spark)


@pytest.fixture
def rng():
    return random.Random(7)


def words(rng, n, vocab=400):
    return " ".join("w%d" % rng.randrange(vocab) for _ in range(n))
