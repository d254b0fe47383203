"""What a Python process of the similarity join holds at once, whatever the size of a batch."""

import numpy as np
import pyarrow as pa

from tallyforge.llm import hashing, jaccard


def test_texts_are_hashed_in_small_buffers(monkeypatch):
    texts = [" ".join(f"w{(i * 31 + k * k) % 977}" for k in range(400)) for i in range(1600)]
    whole = [jaccard.shingles(hashing.words(t.encode())[0], 5) for t in texts]
    sizes, words = [], hashing.words
    monkeypatch.setattr(hashing, "words", lambda data: sizes.append(len(data)) or words(data))
    monkeypatch.setattr(hashing, "_powers", [np.ones(0, np.uint64), np.ones(0, np.uint64)])
    got = list(jaccard.sets(pa.array(texts), 5))
    assert sum(map(len, texts)) > 2_000_000 and max(sizes) < 700_000 and max(map(len, hashing._powers)) < 700_000
    assert all(np.array_equal(a, b) for a, b in zip(got, whole, strict=True))


def test_batches_are_taken_in_slices():
    b = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    got = list(jaccard.sliced(iter([b, b.slice(0, 0)])))
    assert [x.num_rows for x in got] == [1024, 1024, 452] and sum((x["x"].to_pylist() for x in got), []) == list(range(2500))
