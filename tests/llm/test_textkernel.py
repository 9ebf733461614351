import random
import re

import numpy as np
import pyarrow as pa

from loomgraph.llm import textkernel as K


def test_words_and_windows_against_python():
    rnd = random.Random(12)
    texts = [None, "", "a", "  ", "é ß\tx\x0by", "tail ", " head"] + ["".join(rnd.choice("ab \n\té") for _ in range(rnd.randrange(0, 60))) for _ in range(200)]
    seen = {}
    for limit in (1, 50, 10**6):
        for first, last, data, offsets in K.chunks(pa.array(texts), limit):
            found = K.Words(data, offsets)
            hashes = found.hashes()
            for k in range(first, last):
                want = re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "")
                a, b = found.bounds[k - first], found.bounds[k - first + 1]
                got = [bytes(data[s:e]).decode() for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)]
                assert got == want
                for w, h in zip(want, hashes[a:b].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
            owner, start = K.window_owner(found.bounds, 3)
            windows = K.window_hashes(hashes, 3)
            for o, s in zip(owner.tolist(), start.tolist(), strict=True):
                key = tuple(bytes(data[found.starts[i] : found.ends[i]]).decode() for i in range(s, s + 3))
                assert found.bounds[o] <= s and s + 3 <= found.bounds[o + 1]
                assert seen.setdefault(key, int(windows[s])) == int(windows[s])
    assert len(set(seen.values())) == len(seen)


def test_long_texts_hash_alike_in_runs(monkeypatch):
    text = np.frombuffer(("word%d " * 4000 % tuple(range(4000)) + "a" * 5000).encode(), np.uint8)
    whole = K.Words(text, np.array([0, len(text)])).hashes()
    monkeypatch.setattr(K, "CHUNK_BYTES", 100)
    assert (K.Words(text, np.array([0, len(text)])).hashes() == whole).all()
