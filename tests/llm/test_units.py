"""Units that piece_sampling keeps from block to block."""

from pathlib import Path

import numpy as np
import public_tokenizers

from plotline.llm import piece_sampling
from plotline.llm.piece_sampling import VOCABULARY, Lattices, sample_rows


def test_units_met_again_are_kept_and_change_nothing():
    model = Path(public_tokenizers.path(VOCABULARY)).read_bytes()
    common = "the quick brown fox jumps over a lazy dog"
    rare = lambda k: " ".join("".join(chr(97 + (k * k * 31 + k * j * (7 + w) + j * j * 11 + w * 5) % 26) for j in range(7)) for w in range(6))
    texts = [f"{common} {rare(k)} 日ü" for k in range(40)]

    def drawn(lattices, forget):
        out = []
        for k in range(0, 40, 8):
            units = lattices.units_of(texts[k : k + 8])
            found = sample_rows(lattices, units, np.arange(k, k + 8).astype(np.uint64), 2)
            out += [([i.tolist() for i in lattices.spelled([p[0] for p in row])], [p[1:] for p in row]) for row in found] + [lattices.encoded(u).tolist() for u in units]
            if forget and k % 16:
                lattices.forget()
                assert 0 < len(lattices.roots) == len(lattices.keys) == len(lattices.hits) < 60
        return out

    assert drawn(Lattices(model, 1.0), True) == drawn(Lattices(model, 1.0), False)
    assert piece_sampling.KEPT_UNITS > 120_000


def test_later_tables_are_asked_for_few_keys_and_texts_are_encoded_together(monkeypatch):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 63, 30_000).astype(np.uint64))
    table, asked, slots = piece_sampling._Hashed(keys), [], piece_sampling._Hashed._slots
    monkeypatch.setattr(piece_sampling._Hashed, "_slots", lambda self, k, n: asked.append((n, len(k))) or slots(self, k, n))
    some = np.concatenate([keys, rng.integers(0, 1 << 63, 30_000).astype(np.uint64)])
    assert (table.find(some) == np.concatenate([np.arange(len(keys)), np.full(30_000, -1)])).all()
    assert len(table.tables) > 1 and all(n < len(some) / 8 for k, n in asked if k)
    lattices = Lattices(Path(public_tokenizers.path(VOCABULARY)).read_bytes(), 1.0)
    units = lattices.units_of(["the cat sat", "", "on a mat"])
    assert [x.tolist() for x in lattices.encoded_texts(units)] == [lattices.encoded(u).tolist() for u in units]
