import random

import numpy as np

from seedweave.operators import kmers, matching, scan
from seedweave.operators.index import refs_meta


def test_window_hashes_tell_windows_apart():
    rng = random.Random(5)
    text = "".join(rng.choice("abü👍") for _ in range(300))
    for k in (1, 2, 3, 5, 8, 16, 17, 31):
        hashes = scan.window_hashes(scan._codes(text), k)
        windows = [text[i : i + k] for i in range(len(text) - k + 1)]
        assert len(hashes) == len(windows)
        assert len(set(hashes.tolist())) == len(set(windows))
        alone = [scan.window_hashes(scan._codes(w), k)[0] for w in windows]
        assert np.array_equal(hashes, np.array(alone))
    assert len(scan.window_hashes(scan._codes("ab"), 3)) == 0


def test_scan_finds_what_the_join_finds(sequences, monkeypatch):
    rng = random.Random(9)
    motif = "".join(rng.choice("acgü") for _ in range(70))
    refs = {i: "".join(rng.choice("acgü") for _ in range(rng.randint(0, 90))) + motif * (i % 3) for i in range(40)}
    refs[40] = "N" * 60 + motif
    reads = sequences({0: motif, 1: motif[20:] + "N" * 40, 2: "short"}.items())
    meta = refs_meta(sequences(refs.items())).repartition(3)
    seeds = kmers.query_seeds(reads, 31)
    # Small pieces and steps, so that windows meet their borders.
    monkeypatch.setattr(scan, "SCAN_PIECE", 24)
    monkeypatch.setattr(scan, "STEP_CHARS", 100)
    scanned = matching.seed_hits(seeds, scan.scan_postings(meta, seeds, 17))
    joined = matching.seed_hits(seeds, kmers.ref_kmers(meta, 17))
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(scanned) == key(joined) != []
    assert scan.scan_postings(meta, seeds.where("q = 2"), 17).count() == 0
