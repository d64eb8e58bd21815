import numpy as np
import pandas as pd

from weftscan.llm import language_model as lm


def test_what_chunks_share_is_looked_up_once(monkeypatch):
    """A shard looks up each distinct word or pair once, however many chunks ask for it."""
    asked = []
    counts, lookup = lm.Words.counts, lm.Successors.lookup
    monkeypatch.setattr(lm.Words, "counts", lambda self, hashes: asked.append(len(hashes)) or counts(self, hashes))
    monkeypatch.setattr(lm.Successors, "lookup", lambda self, c, r, s: asked.append(len(s)) or lookup(self, c, r, s))
    keys, more = np.array([5, 9, 2**63], np.uint64), np.array([7, 8, 1, 4], np.uint32)
    row = {"keys": keys.tobytes(), "runs": np.array([2, 1, 1], np.uint32).tobytes(), "more": more.tobytes()}
    rows = [row | {"chunk": k, "counts": np.array([k == 3, 1, 0, 0], np.uint32).tobytes()} for k in range(40)]
    pairs = lm._answer(3)(pd.DataFrame([r | {"shard": 9} for r in rows]))
    code = lambda n: 1 + round(np.log10(n) * lm.CODE_STEPS)
    assert [list(x) for x in pairs["found"]] == [[code(1), code(40), 0, 0]] * 40
    words = lm._answer(3)(pd.DataFrame([r | {"shard": 1, "counts": np.array([1, k == 3, 0], np.uint32).tobytes()} for k, r in enumerate(rows)]))
    assert [np.frombuffer(x, np.int64).tolist() for x in words["found"]] == [[40, 1, 0]] * 40
    assert set(words["total"]) == {41} and set(words["distinct"]) == {2}
    assert asked == [4, 3]
