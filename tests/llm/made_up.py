"""Made-up prose for tests that need texts of a known kind."""

import random


def prose(seed: int, n: int, letters: str = "abcdeéñü") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))
