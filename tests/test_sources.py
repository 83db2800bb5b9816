"""Raw files, blobs, whole-file archives, section archives, streams and the command line."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from tallow.operators.elements import to_groups
from tallow.operators.residual import map_groups, pack_groups
from tallow.schema import GROUP
from tallow.sources import codec_file, raw, section
from tallow.streaming import stream

EDGES = [0, 1, 15, 16, 17, 511, 512, 513, 5000]


@pytest.mark.parametrize(("dtype", "kind"), [("uint8", "u1"), ("uint16", "<u2"), ("uint32", "<u4")])
def test_integers_at_the_edges(spark, tmp_path, dtype, kind):
    rng, want = np.random.default_rng(1), {}
    for n in EDGES:
        want[n] = rng.integers(0, 1 << 8 * np.dtype(kind).itemsize, n).astype(kind)
        (tmp_path / f"{n}.bin").write_bytes(want[n].tobytes() + (b"\x07" if kind != "u1" else b""))  # an odd byte at the end
    (tmp_path / "other.txt").write_bytes(b"1234")
    rows = raw.read_integers(spark, str(tmp_path), dtype, ".bin", split_groups=2).collect()
    for n in EDGES:
        got = sorted((r.pos, r.val) for r in rows if r.path.endswith(f"/{n}.bin"))
        assert [p for p, _ in got] == list(range(n)) and [v for _, v in got] == want[n].tolist()
    assert len(rows) == sum(EDGES)
    assert raw.read_integers(spark, f"file://{tmp_path}/513.bin", dtype).count() == 513
    with pytest.raises(Exception, match="missing"):
        raw.read_integers(spark, str(tmp_path / "missing"), dtype).count()


def test_pieces(spark, tmp_path):
    data = random.Random(2).randbytes(10_000)
    (tmp_path / "a").write_bytes(data)
    files = raw.read_bytes(spark, str(tmp_path))
    for size, limit in ((4096, 10), (700, 10), (10_000, 10), (10_001, 10), (100, 7)):
        got = sorted((r.piece, bytes(r.content)) for r in raw.split_pieces(files, size, limit).collect())
        want = [(i, data[i * size : (i + 1) * size]) for i in range(-(-len(data) // size))][:limit] if size <= len(data) else []
        assert got == want


def test_blobs_get_their_names_together(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", bytearray(b"one")), ("deep/er/a.bin", bytearray(b"two")), ("empty", bytearray())], "name string, content binary")
    for _ in range(2):  # the second replaces the first
        raw.write_blobs(rows.repartition(3), str(tmp_path))
    found = {os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(tmp_path) for f in fs}
    assert found == {"a.bin": b"one", "deep/er/a.bin": b"two", "empty": b""}
    bad = spark.createDataFrame([("kept", bytearray(b"x")), ("../out", bytearray(b"y"))], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="not a name"):
        raw.write_blobs(bad, str(tmp_path / "new"))
    assert not [f for _, _, fs in os.walk(tmp_path / "new") for f in fs]


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(path) for f in fs}


def made_tree(path):
    rng = random.Random(3)
    for i, n in enumerate([2, 1, 31, 4096, 4097, 20_000]):
        (path / f"d{i % 2}").mkdir(parents=True, exist_ok=True)
        (path / f"d{i % 2}" / f"{i // 2}.u2").write_bytes(bytes(rng.choice(b"aab c") for _ in range(n)))
    return tree(path)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    want = made_tree(tmp_path / "in")
    rows = codec_file.encode_file(spark, str(tmp_path / "in"), str(tmp_path / "mid")).collect()
    stored = tree(tmp_path / "mid")
    assert {r.name: (r.raw, r.stored) for r in rows} == {n: (len(d), len(stored[n + ".rc"])) for n, d in want.items()}
    codec_file.decode_file(spark, str(tmp_path / "mid"), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want
    (tmp_path / "in" / "none.u2").write_bytes(b"")  # Spark's file scan has no row for it
    assert raw.read_bytes(spark, str(tmp_path / "in")).count() == len(want)
    one = next(iter(want))
    codec_file.encode_file(spark, f"file://{tmp_path}/in/{one}", str(tmp_path / "single"), bits=11)
    assert list(tree(tmp_path / "single")) == [os.path.basename(one) + ".rc"]


def test_command_line(tmp_path):
    want = made_tree(tmp_path / "in")
    args = [sys.executable, "-m", "tallow", "compress", *(str(tmp_path / x) for x in ("in", "mid", "out"))]
    done = subprocess.run(args, capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0 and f"files 6, raw {sum(map(len, want.values()))}" in done.stdout and "lossless" in done.stdout
    assert tree(tmp_path / "out") == want


def grouped(spark, values):
    return to_groups(spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "pos bigint, val bigint"))


def test_section_archives(spark):
    values = np.random.default_rng(4).integers(0, 65_536, GROUP * 5 + 7)
    packed = pack_groups(map_groups(grouped(spark, values)))
    parts = sorted((r.part, bytes(r.archive)) for r in section.archive_sections(packed, per=2).collect())
    assert [p for p, _ in parts] == [0, 1, 2]
    assert np.concatenate([section.parse(a) for _, a in parts]).tolist() == values.tolist()
    for n in (1, 511, 512, 513):
        assert section.parse(section.encode_values(values[:n])).tolist() == values[:n].tolist()
    whole = section.archive_sections(packed).collect()
    assert bytes(whole[0].archive) == section.assemble([(r.center, r.sig_len, bytes(r.codes), bytes(r.signals)) for r in sorted(packed.collect(), key=lambda r: r.gid)], 4)


def test_two_file_form(spark, tmp_path):
    values = np.random.default_rng(5).integers(0, 2000, GROUP * 3 + 100)
    mapped = map_groups(grouped(spark, values))
    codec_file.write_code_signal(mapped, str(tmp_path), per=2)
    found = tree(tmp_path)
    rows = sorted(mapped.collect(), key=lambda r: r.gid)
    for name, want in (("code", [c for r in rows for c in r.codes]), ("signal", [2 * (x - 1) for r in rows for x in r.lens])):
        parts = [found[f"{name}.bin/{i:010d}"] for i in range(2)]
        assert list(b"".join(parts)) == want


def test_streams(spark, tmp_path):
    values = np.random.default_rng(6).integers(0, 3000, GROUP * 4)
    groups = grouped(spark, values)
    groups.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(groups.schema).parquet(str(tmp_path / "in"))
    done = stream.map_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    done.awaitTermination()
    got = {r.gid: (r.center, r.lens, r.codes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.gid: (r.center, r.lens, r.codes) for r in map_groups(groups).collect()}
    texts = spark.createDataFrame([(1, "abc" * 50), (2, None), (3, "")], "id bigint, text string")
    texts.write.parquet(str(tmp_path / "texts"))
    source = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "texts"))
    stream.append_archives(source, "text", str(tmp_path / "archives"), str(tmp_path / "c2")).awaitTermination()
    from tallow.operators.archive import decode_column

    back = decode_column(spark.read.parquet(str(tmp_path / "archives")))
    assert {(r.id, r.data and bytes(r.data)) for r in back.collect() if r.id != 3} == {(1, b"abc" * 50), (2, None)}
