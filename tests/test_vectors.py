"""Known vectors: values worked out by hand or by a plain scalar coder, not by the code under test."""

import random
import struct

import numpy as np
import pytest

from tallow.operators.archive import archive_size, compress, max_archive_size, max_block_size, read_header
from tallow.operators.bytestream import decode_lanes, encode_lanes
from tallow.operators.elements import to_groups, with_positions
from tallow.operators.quantize import quantize, quantize_counts
from tallow.operators.residual import lane_hex, map_groups, pack_groups, restore_lane, unmap_groups
from tallow.operators.scan import exclusive_scan, exclusive_scan_two_level


def groups(spark, *lists):
    return spark.createDataFrame(list(enumerate(map(list, lists))), "gid bigint, vals array<bigint>")


def test_element_map(spark):
    vals = [100, 101, 99, 226, 227, 352, 353, 0, -26, -27]
    r = map_groups(groups(spark, vals), 100).first()
    assert r.lens == [1, 1, 1, 1, 2, 2, 3, 1, 1, 2] and r.codes == [1, 2, 3, 252, 2, 252, 2, 201, 253, 3]


def test_groups(spark):
    lists = [[100] * 16, [100, 101, 99, 226, 227, 352, 353, 0] + [100] * 8, [1000] * 5, [0, 1000]]
    rows = sorted(map_groups(groups(spark, *lists)).collect(), key=lambda r: r.gid)
    assert [r.center for r in rows] == [100, 141, 1000, 500]
    assert rows[0].codes == [1] * 16 and rows[2].codes == [1] * 5 and rows[3].codes == [245, 244]
    assert rows[1].codes == [83, 81, 85, 170, 172, 170, 172, 31] + [83] * 8
    assert rows[1].lens == [1, 1, 1, 1, 1, 2, 2, 2] + [1] * 8 and rows[3].lens == [4, 4]
    mapped = map_groups(groups(spark, *lists))
    assert {r.gid: r.hex.lower() for r in lane_hex(mapped).where("lane = 0").collect()} == {0: "ffff", 1: "fd5fff", 2: "ff", 3: "88"}
    packed = {r.gid: (r.sig_len, bytes(r.signals)[: r.sig_len].hex()) for r in pack_groups(mapped).collect()}
    assert packed == {0: (2, "ffff"), 1: (3, "fd5fff"), 2: (1, "ff"), 3: (1, "88")}
    for padding in ("byte", "ones"):
        back = {(r.gid, r.lane): r.lens for r in restore_lane(lane_hex(mapped, padding)).collect()}
        assert back == {(g, 0): row.lens for g, row in enumerate(rows)} or padding == "ones"


@pytest.mark.parametrize("width", [2, 4])
def test_byte_form_at_its_limits(spark, width):
    top = (1 << 8 * width) - 1
    edge = 504 if width == 2 else 1008
    lists = [[5000 - d for d in (edge, edge + 1)] + [5000 + d for d in (edge, edge + 1)] + [5000] * 12, [0, top] * 8, [0, 254, 255, 254 * 257, 255 * 257, top] * 3, [0, 0, 126, 126, 252, 252, 253, 253, 0], [7], list(range(0, 512 * 3, 3))]
    rows = encode_lanes(groups(spark, *lists), width)
    got: dict = {}
    for r in decode_lanes(rows, width).collect():
        got.setdefault(r.gid, {})[r.lane] = r.vals
    assert [[v for lane in sorted(got[i]) for v in got[i][lane]] for i in range(len(lists))] == lists
    assert all(len(r.bytes) % 8 == 0 for r in rows.collect())


@pytest.mark.parametrize("width", [2, 4])
def test_literals_beyond_the_width(spark, width):
    top = (1 << 8 * width) - 1
    vals = [top + 1, -1, 0, top, -top - 1, 1 << 50, -(1 << 50), 254 * 256, (top + 1) * 254 + 255, 3, -7 * top]
    rows = encode_lanes(groups(spark, vals), width)
    assert len(rows.first().bytes) == -(-len(vals) * (width + 1) // 8) * 8
    assert decode_lanes(rows, width).first().vals == vals


@pytest.mark.parametrize("n", [1, 15, 16, 17, 511, 512, 513])
def test_short_tails(spark, n):
    values = [int(v) for v in np.random.default_rng(n).integers(0, 65_536, n)]
    df = spark.createDataFrame([(i * 3 - 50, v) for i, v in enumerate(values)], "k bigint, v bigint")
    back = unmap_groups(map_groups(to_groups(with_positions(df, "k", "v")))).orderBy("gid").collect()
    assert [v for r in back for v in r.vals] == values and all(len(r.vals) <= 512 for r in back)


def test_no_values(spark):
    empty = spark.createDataFrame([], "k bigint, v bigint")
    assert pack_groups(map_groups(to_groups(with_positions(empty, "k", "v")))).count() == 0


@pytest.mark.parametrize("n", [1, 1024, 1025])
def test_both_scans_agree(spark, n):
    rng = random.Random(n)
    df = spark.createDataFrame([(i, rng.randint(0, 99)) for i in range(n)], "gid bigint, sig_len bigint")
    one, two = ({(r.gid, r.offset) for r in f.collect()} for f in (exclusive_scan(df, "gid", "sig_len"), exclusive_scan_two_level(df, "gid", "sig_len", fanout=16)))
    assert one == two and len(one) == n


WEIGHTS = [
    ({65: 3, 66: 1}, 9, {65: 384, 66: 128}),
    ({65: 1, 66: 1, 67: 1}, 9, {0: 1, 1: 1, 65: 170, 66: 170, 67: 170}),
    ({7: 5000}, 10, {7: 1024}),
    ({0: 100_000, 1: 1, 2: 1, 3: 1}, 9, {0: 509, 1: 1, 2: 1, 3: 1}),
    ({0: 30_000, 1: 30_000, 2: 1, 3: 1, 4: 1}, 9, {0: 254, 1: 255, 2: 1, 3: 1, 4: 1}),
]


@pytest.mark.parametrize(("counts", "bits", "want"), WEIGHTS)
def test_weights(spark, counts, bits, want):
    full = np.array([counts.get(i, 0) for i in range(256)])
    assert {i: w for i, w in enumerate(quantize_counts(full, bits).tolist()) if w} == want
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(full)], "sym int, cnt bigint")
    assert {r.sym: r.pdf for r in quantize(df, bits).collect() if r.pdf} == want


@pytest.mark.parametrize("bits", [9, 10, 11])
def test_weights_over_several_rounds(spark, bits):
    rng = random.Random(bits)
    for kind in range(4):
        full = np.array([[10**6 if i == 3 else 1 for i in range(256)], [1] * 256, [rng.randint(0, 3) for _ in range(256)], [int(rng.paretovariate(0.4)) for _ in range(256)]][kind])
        got = quantize_counts(full, bits)
        assert got.sum() == 1 << bits and (got[full > 0] >= 1).all()
        df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(full)], "sym int, cnt bigint")
        assert [r.pdf for r in quantize(df, bits).orderBy("sym").collect()] == got.tolist()


def test_other_precisions_are_refused():
    for bits in (8, 12):
        with pytest.raises(ValueError):
            compress(b"abc", bits)


def plain_block(data, pdf, bits):
    """One block by the coder's definition, a symbol at a time: final states and words in order of step and lane."""
    cdf = [sum(pdf[:i]) for i in range(256)]
    state, words = [1 << 15] * 32, []
    for i, s in enumerate(data):
        lane = i % 32
        if state[lane] >= pdf[s] << (31 - bits):
            words.append(state[lane] & 0xFFFF)
            state[lane] >>= 16
        state[lane] = (state[lane] // pdf[s] << bits) + state[lane] % pdf[s] + cdf[s]
    return state, words


@pytest.mark.parametrize("bits", [9, 10, 11])
@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 4095, 4096, 4097, 8192])
def test_archives_by_a_plain_coder(bits, n):
    rng = random.Random(n)
    for data in (bytes(rng.choice(b"aaaabbc ") for _ in range(n)), rng.randbytes(n), b"\x07" * n, bytes([9] * max(0, n - 255)) + bytes(range(min(n, 255)))):
        blob = compress(data, bits)
        pdf = quantize_counts(np.bincount(np.frombuffer(data, np.uint8), minlength=256), bits).tolist()
        blocks = [data[i : i + 4096] for i in range(0, n, 4096)]
        coded = [plain_block(b, pdf, bits) for b in blocks]
        room = [-(-len(w) // 8) * 8 for _, w in coded]
        want = struct.pack("<8I", 0xD00D0001, len(blocks), n, sum(room), bits, 0, 0, 0) + struct.pack("<256H", *pdf)
        want += b"".join(struct.pack("<32I", *s) for s, _ in coded)
        index, at = [], 0
        for b, (_, w), r in zip(blocks, coded, room, strict=True):
            index += [len(b) << 16 | len(w), at]
            at += r
        index += [0, 0] * (len(blocks) % 2)
        want += struct.pack(f"<{len(index)}I", *index)
        want += b"".join(struct.pack(f"<{r}H", *w, *[0] * (r - len(w))) for (_, w), r in zip(coded, room, strict=True))
        assert blob == want
        assert len(blob) == archive_size(len(blocks), sum(room)) <= max_archive_size(n) and read_header(blob).words == sum(room)


def test_a_worked_block():
    """Two symbols of weight 512 of 1024: 32768 becomes (32768 // 512 << 10) + 0 + start = 65536 + start; no word is written."""
    blob = compress(b"ab" * 16, 10)
    states = struct.unpack_from("<32I", blob, 32 + 512)
    assert states == (65536, 65536 + 512) * 16 and read_header(blob).words == 0 and len(blob) == 32 + 512 + 128 + 16
    assert len(compress(b"\x07" * 5000, 10)) == 816 and max_block_size(4096) == 5120
