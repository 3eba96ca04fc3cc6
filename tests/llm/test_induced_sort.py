import random

import numpy as np
import pytest

from pipewise.llm.induced_sort import InducedSorter, TupleQueue


def plain(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return order, common


@pytest.mark.parametrize("memory", [100, 1 << 20])
def test_order_and_common_prefixes(memory):
    rng = random.Random(memory)
    for _ in range(150):
        letters = rng.choice([2, 3, 5, 256])
        parts = [
            [rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 60))]
            for _ in range(rng.randrange(1, 8))
        ]
        parts += [p[rng.randrange(len(p)) :] for p in parts[: rng.randrange(4)]]
        text = [x for p in parts for x in [*p, 0]]
        order, common = InducedSorter(np.array(text, np.uint16), 250, memory).sort()
        assert (order.tolist(), common.tolist()) == plain(text)


def test_order_up_to_a_depth():
    rng = random.Random(9)
    text = [rng.randrange(1, 3) for _ in range(2000)] + [0]
    order, common = InducedSorter(np.array(text, np.uint16), 6).sort()
    heads = [tuple(text[i : i + 6]) for i in order.tolist()]
    assert heads == sorted(heads) and sorted(order.tolist()) == list(range(len(text)))
    same = [heads[k] == heads[k - 1] for k in range(1, len(heads)) if len(heads[k]) == 6]
    assert sum(same) == sum((common >= 6).tolist())


def test_queue_gives_back_what_it_wrote():
    queue = TupleQueue(memory=64)
    for k in range(20):
        queue.put(k % 2, np.arange(k, dtype=np.int32), np.full(k, k, np.uint8))
    places, common = queue.take(1)
    assert places.tolist() == [x for k in range(1, 20, 2) for x in range(k)]
    assert common.tolist() == [k for k in range(1, 20, 2) for _ in range(k)]
    assert len(queue.take(1)[0]) == 0
    queue.close()
