import time

import numpy as np

from inkwell.llm import decontamination as D

TEXT = np.random.default_rng(5).choice(np.frombuffer("eettaaoinshrdlcu  é".encode("utf-32-le"), np.uint32), 3 * D.WALKED + 7)


def plain(text, walk):
    """Key and end of each walk, step by step from its first character."""
    padded = np.concatenate([text, np.zeros(D.STEPS, np.uint32)])
    moves, names = D.mixed(padded, 2 * walk + 1), D.mixed(padded, 2 * walk + 2)
    sampled = np.random.default_rng(walk).permutation(D.STEPS)[: D.SAMPLED]
    place, key, power = np.arange(len(text), dtype=np.int32), np.zeros(len(text), np.uint32), 1
    for step in range(D.STEPS):
        if step in sampled:
            power = power * 0xC2B2AE3D % 2**32
            key += names.take(place) * np.uint32(power * pow(0xC2B2AE3D, -1, 2**32) % 2**32)
        place += (moves.take(place) >> np.uint32(step) & np.uint32(1)).view(np.int32)
    return key >> np.uint32(32 - D.HASH_BITS), place


def test_keys_and_ends_of_walks_equal_plain_walks():
    for text in (TEXT, TEXT[: D.WALKED], TEXT[:1], TEXT[:0]):
        for walk in range(D.WALKS):
            keys, ends = plain(text, walk)
            assert (D.walk_keys(text, walk) == keys).all() and (D.walk_ends(text, walk) == ends).all()


def test_walks_of_a_text_cost_less_than_looking_up_each_step():
    items = D.Items([(1, "some words of an item that is long enough to have walks of its own, as items of a benchmark are")])

    def seconds(f):
        begun = time.process_time()
        f()
        return time.process_time() - begun

    looked_up = min(seconds(lambda: [plain(TEXT, walk) for walk in range(D.WALKS)]) for _ in range(5))
    assert min(seconds(lambda: items.regions(TEXT)) for _ in range(5)) < 0.7 * looked_up
