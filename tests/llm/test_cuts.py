import random

import pytest

from factorweave.llm.sharding import cuts


def brute(sizes, shards):
    """The starts of shards under the smallest capacity, tried one by one."""
    total, capacity = sum(sizes), max(sizes, default=0)
    while True:
        starts, used, at = [0], 0, 0
        for s in sizes:
            if used + s > capacity:
                starts.append(at)
                used = 0
            used += s
            at += s
        if len(starts) <= shards:
            return [x for x in starts if x < total] or [0]
        capacity += 1


@pytest.mark.parametrize(("most_ends", "ways"), [(1 << 20, 64), (0, 3), (4, 4), (10, 2)])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_cuts_equal_brute_force(spark, most_ends, ways, shards):
    """Whether all ends come at once, or after rounds that bring the capacity closer."""
    rng = random.Random(shards + ways)
    for sizes in ([], [5], [rng.randint(1, 40) for _ in range(60)], [*[1] * 30, 200, *[3] * 20]):
        before = [sum(sizes[:i]) for i in range(len(sizes))]
        sums = spark.createDataFrame(list(zip(before, sizes, strict=True)), "bytes_before long, bytes long").repartition(3)
        assert cuts(sums, shards, ways, most_ends) == brute(sizes, shards), sizes
