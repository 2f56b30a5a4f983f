"""Memory of the Python workers, which counts as their executor's."""

import re
import tracemalloc
from pathlib import Path

import numpy as np

from weftgraph.llm import vectext
from weftgraph.llm.common import arrow_map


def test_words_are_hashed_block_by_block():
    words = [b"%d" % i for i in range(600_000)]
    words[300_000] = b"x" * 700_000  # longer than a block
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    vectext._powers.clear()
    tracemalloc.start()
    h = vectext.spans(data, start, end)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 50 << 20 and kept - h.nbytes < 6 << 20
    for i in [0, 1, 299_999, 300_000, 300_001, *range(400_000, 600_000, 4321)]:
        assert h[i] == vectext.Words([words[i]]).hash[0]


def test_a_task_returns_the_memory_it_freed(spark):
    def anonymous() -> float:
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    pins: list[bytes] = []

    def kernel(batches):
        held = [bytes(1000) for _ in range(200_000)]
        pins.extend(held[::500])  # what lives on among what is freed
        del held
        yield {"n": [1]}

    before = anonymous()
    assert [b.num_rows for b in arrow_map(Frame(), kernel, "n int")([])] == [1]
    assert anonymous() - before < 60
