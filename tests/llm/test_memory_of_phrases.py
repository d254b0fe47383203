"""What a task of the phrase counts holds and sends."""

import numpy as np
import pyarrow as pa

from tallyforge.llm import collocations


def test_runs_are_summed_over_buffers(monkeypatch):
    """A key is sent once where a task's keys fit, and again only after others have filled HELD; the sums are the same."""
    rng = np.random.default_rng(7)
    docs = pa.RecordBatch.from_pydict({"row": list(range(400)), "lang": ["en"] * 400, "text": [" ".join(f"w{x}" for x in rng.integers(0, 40, 30)) for _ in range(400)]})
    monkeypatch.setattr(collocations, "BYTES", 1000)
    summed = []
    for held in (1 << 18, 64):
        monkeypatch.setattr(collocations, "HELD", held)
        got = pa.Table.from_batches(collocations.run_counts(iter([docs]), (0, 1, 2), None, 64))
        summed.append(sorted(zip(*got.group_by("key").aggregate([("n", "sum"), ("checks", "sum"), ("row", "min")]).to_pydict().values())))
        assert (got.num_rows == len(summed[-1])) == (held == 1 << 18)
    assert summed[0] == summed[1] and sum(r[1] for r in summed[0]) == 400 * (30 + 30 + 29)
