import random
import string

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make():
    """Seeded words and texts."""
    rng = random.Random(11)

    def words(n: int, size: int = 4000) -> list[str]:
        return [f"w{rng.randrange(size)}x" for _ in range(n)]

    words.rng = rng
    words.letters = string.ascii_lowercase
    return words


@pytest.fixture(scope="session")
def sf():
    return SF
