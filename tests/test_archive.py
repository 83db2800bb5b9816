"""Archives coded together against archives coded alone, and damaged ones."""

import random

import pytest

from tallow.operators.archive import compress, compress_all, decompress, decompress_all


def inputs():
    rng = random.Random(4)
    sizes = [0, 1, 31, 32, 33, 4095, 4096, 4097, 8192, 1_200_000, 0, 700]
    kinds = [lambda n: rng.randbytes(n), lambda n: bytes(n), lambda n: bytes(rng.choice(b"aab c") for _ in range(n))]
    return [kinds[i % 3](n) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("bits", [9, 10, 11])
def test_company_does_not_change_an_archive(bits):
    many = inputs()
    together = compress_all(many, bits)
    assert together == [compress(x, bits) for x in many]
    assert decompress_all(together) == many and compress_all([], bits) == []


def test_mixed_precisions_and_damage():
    many = inputs()
    mixed = [compress(x, 9 + i % 3) for i, x in enumerate(many)]
    assert decompress_all(mixed) == many and decompress_all([]) == []
    good = compress(b"some text, some text" * 40)
    for bad in (b"", b"x" * 32 + good[32:], good[:-2], good[:32] + bytes(512) + good[544:], good[:560] + b"\xff\xff" + good[562:]):
        with pytest.raises(ValueError):
            decompress(bad)
