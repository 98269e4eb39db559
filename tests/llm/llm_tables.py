"""Invented texts and columns for the tests of the text operators."""
import random


def words(seed: int, n: int, size: int = 2000) -> list[str]:
    """A reproducible text of invented words."""
    rng = random.Random(seed)
    return ["w" + format(rng.randrange(size), "x") for _ in range(n)]


#: columns whose names clash with those the operators use inside
CLASHING = ["1 AS id", "'x' AS score", "'y' AS component", "'z' AS stratum", "0 AS part", "'k' AS `key`", "true AS kept", "'r' AS row"]
