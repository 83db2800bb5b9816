import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallow.operators.archive import compress
from tallow.plans.queries import QUERIES, SQL, elements
from tallow.sources.section import encode_values
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


SWEEPS = {"piece_sweep", "coder_sweep"}  # the smallest table is smaller than their smallest piece


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert check(df, con, SQL[name]) > 0 or name in SWEEPS
    else:
        assert df.count() > 0 or name in SWEEPS


def test_sweeps_skip_sizes_larger_than_the_file(spark):
    sf = "/root/testdata/sf0.01"
    assert check(QUERIES["piece_sweep"](spark, sf), connect(sf), SQL["piece_sweep"]) == 2
    rows = {r.size_kb: r for r in QUERIES["coder_sweep"](spark, sf).collect()}
    values = np.array([r.val for r in elements(spark, sf, "u16").orderBy("pos").collect()], "<u2")
    assert set(rows) == {16, 4}
    for kb, r in rows.items():
        parts = [values[i : i + kb * 512] for i in range(0, len(values), kb * 512)][:10]
        assert (r.pieces, r.original) == (len(parts), sum(p.nbytes for p in parts))
        assert r.raw_coded == sum(len(compress(p.tobytes())) for p in parts)
        mapped = [parse_sections(p) for p in parts]
        assert r.mapped_coded == sum(len(compress(m)) for m in mapped)


def parse_sections(piece):
    """Codes and signals of a piece, by the whole-piece archive."""
    blob = encode_values(piece)
    groups = -(-len(piece) // 512)
    return blob[17 + 4 * (groups + 1) + 2 * groups :]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Events whose skewed column does not fit 16 bits: beyond them by one, by far, below zero, and a full lane of literals."""
    sf = str(tmp_path_factory.mktemp("wide"))
    rng = np.random.default_rng(7)
    values = rng.exponential(100.0, 1500).round(2)
    values[5::40], values[6::40], values[7::40], values[8::40] = 655.35, 655.36, 10485.76, -3.0
    values[[100, 900, 1499]] = -2500.5, 1e12, -1e12
    values[512:528] = [700.0, *[0.0, 400.0] * 7, 1.0]
    con = duckdb.connect()
    con.register("v", pa.table({"event_id": np.arange(1500) * 3 + 11, "value": values}))
    con.execute(f"COPY v TO '{sf}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    return sf, con


@pytest.mark.parametrize("name", ["byte_stream_roundtrip_skewed", "byte_stream_length_skewed", "byte_stream_hex"])
def test_values_wider_than_their_column(spark, wide, name):
    assert check(QUERIES[name](spark, wide[0]), wide[1], SQL[name]) > 0
