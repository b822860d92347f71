import time

import numpy as np

from shapeloom.llm.chunks import by_bucket


def test_ranges_of_buckets_that_occur():
    bucket = np.sort(np.random.default_rng(1).integers(0, 10**12, 3000))
    parts = list(by_bucket(bucket, 10**12))
    assert [b for b, _ in parts] == np.unique(bucket).tolist()
    assert np.concatenate([bucket[s] for _, s in parts]).tolist() == bucket.tolist() and all((bucket[s] == b).all() for b, s in parts)
    assert list(by_bucket(bucket[:0], 5)) == []


def test_time_does_not_grow_with_the_number_of_buckets():
    bucket = np.sort(np.random.default_rng(1).integers(0, 1000, 100_000))
    began = time.perf_counter()
    for _ in range(20):
        assert len(list(by_bucket(bucket, 1000))) == len(list(by_bucket(bucket, 10**15)))
    assert time.perf_counter() - began < 5
