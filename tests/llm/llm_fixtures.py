import random


def prose(seed, n, words=400):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))
