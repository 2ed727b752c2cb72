"""What a task holds while it reads texts: it must not grow with the batch that it is handed."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from cratelake.llm import debruijn, neardup


@pytest.mark.parametrize("read", [neardup._sketch(5), debruijn._deal(20, 10, 800, np.zeros(0, np.uint64))])
def test_a_batch_of_texts_is_read_in_small_slices(read):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 600))) for _ in range(2000)]
    ids = pa.array(range(2000), pa.int64())
    batch = pa.record_batch([ids, ids, pa.array(texts)], ["doc_id", "key", "text"])
    assert sum(map(len, texts)) > 8_000_000
    tracemalloc.start()
    assert sum(b.num_rows for b in read(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000, most
