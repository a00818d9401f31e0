"""Suffix arrays and common prefixes against sorting and comparing."""

import random

import numpy as np
import pytest

from footfall.llm import suffixes


def texts():
    rnd = random.Random(11)
    yield from (b"a", b"aaaa" * 30, b"ab" * 50, b"banana", bytes(range(256)), bytes(range(255, -1, -1)), b"mississippi" * 9)
    for _ in range(150):
        letters = rnd.choice(["ab", "abc", "\x00\xffa", "abcdefgh"])
        yield "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 200))).encode("latin-1")
    block = bytes(rnd.randrange(256) for _ in range(90))
    yield block + b"\xff" + block[:50] + b"\xff" + block


@pytest.mark.parametrize("least", [64, 1, 5])
def test_order_and_prefixes(monkeypatch, least):
    monkeypatch.setattr(suffixes, "LEAST", least)
    for raw in texts():
        text = np.frombuffer(raw, "uint8")
        order = suffixes.of_bytes(text)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        prior, length = suffixes.permuted_prefixes(text, order)
        for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            n = 0
            while max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
                n += 1
            assert prior[i] == j and length[i] == n
        assert prior[order[0]] == -1 and length[order[0]] == 0
        for size in (1, 3, 12):
            grams = [raw[i : i + size] for i in range(len(raw) - size + 1)]
            want = [i for i, g in enumerate(grams) if grams.count(g) > 1]
            assert np.flatnonzero(suffixes.repeated_starts(text, size)).tolist() == want


def test_large_text():
    rnd = np.random.default_rng(5)
    text = np.concatenate([rnd.integers(97, 101, 40_000), np.full(300, 97), rnd.integers(0, 256, 40_000)]).astype("uint8")
    text = np.concatenate([text, text[5_000:60_000], np.tile(text[:7], 500)])
    raw = text.tobytes()
    order = suffixes.of_bytes(text).tolist()
    assert sorted(order) == list(range(len(raw)))
    assert all(raw[i : i + 60_000] < raw[j : j + 60_000] for i, j in zip(order[:-1:7], order[1::7], strict=False))
