import random

import numpy as np
import pytest

from codequarry.llm import near_dedup
from tests.llm.test_corpus import random_text

TIMES = 200


def edited(rng, a, edits, kinds):
    b = list(a)
    for at in sorted(rng.sample(range(len(a)), edits), reverse=True):
        kind = rng.choice(kinds)
        b[at : at + 1] = {"replace": [f"new{at}"], "delete": [], "insert": [a[at], f"new{at}"]}[kind]
    return b


@pytest.mark.parametrize("kinds", [("replace",), ("replace", "delete", "insert")])
@pytest.mark.parametrize("n", [5, 6, 7, 9, 10, 12, 16, 20, 28, 34, 40, 48, 80, 150, 400, 600])
def test_recall_at_the_threshold_by_length(n, kinds):
    """As many edits as alignment just accepts, at scattered places: at least 0.9 of the pairs share a sketch."""
    rng, found, pairs = random.Random(n), 0, 0
    while pairs < TIMES:
        a = random_text(rng, n)
        b = edited(rng, a, int(0.2 * n), kinds)
        words, bounds = near_dedup.hashed_words([" ".join(a), " ".join(b)])
        if near_dedup.similar(words[: bounds[1]], words[bounds[1] :]):
            of, keys = near_dedup.bucket_keys(words, bounds)
            found += np.intersect1d(keys[of == 0], keys[of == 1]).size > 0
            pairs += 1
    print("recall", n, kinds, found / TIMES)
    assert found >= 0.9 * TIMES


def test_texts_have_the_sketches_of_their_own_length_and_of_shorter_similar_ones():
    rng = random.Random(2)
    sizes = [0, 1, 3, 7, 8, 9, 10, 16, 19, 20, 28, 34, 35, 48, 60, 61, 500, 624, 625]
    words, bounds = near_dedup.hashed_words([" ".join(random_text(rng, n)) for n in sizes])
    of, keys = near_dedup.bucket_keys(words, bounds)
    forms = {n: len({next((i for i, (limit, *_) in enumerate(near_dedup.SHORT) if x < limit), len(near_dedup.SHORT)) for x in (n, -(-8 * n // 10))}) for n in sizes}
    assert [int((of == k).sum()) for k in range(len(sizes))] == [forms[n] * near_dedup.SKETCHES if n else 0 for n in sizes]
    assert (np.diff(of) >= 0).all() and keys.size == of.size
