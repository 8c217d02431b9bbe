"""Queries against their SQL on tables whose ids have more than six digits."""

import duckdb
import pytest
from compare import compare, connect

from plumbline.queries.spark import REGISTRY

SMALL = "/root/testdata/sf0.001"
#: the ids that are moved; the names of the views keep their first six digits
MOVED = {"events": "event_id", "orders": "o_orderkey"}


@pytest.fixture(scope="module")
def long_ids(tmp_path_factory):
    """The smallest events and orders: odd ids in steps of ten beyond a million, so that cut names stay unique, even ids at 200,000."""
    folder = tmp_path_factory.mktemp("ids")
    con = duckdb.connect()
    for name in ("nation", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        source, key = f"'{SMALL}/{name}.parquet'", MOVED.get(name)
        moved = f" REPLACE (CASE WHEN {key} % 2 = 1 THEN 1000000 + {key} * 10 + 5 ELSE {key} + 200000 END AS {key})" if key else ""
        con.execute(f"COPY (SELECT *{moved} FROM {source}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["frame_gate", "frame_order", "jump_flags", "trajectory_steps", "trajectory_stats", "pose_qa", "normalized_extrinsics"])
def test_ids_beyond_six_digits(spark, long_ids, name):
    ok, note = compare(spark, connect(long_ids), long_ids, name)
    assert ok, note


@pytest.mark.parametrize("name", ["pairs_exhaustive", "pairs_sequential"])
def test_equal_names_have_an_order(spark, tmp_path, name):
    """Names that the view cuts to the same six digits: the order of the rows in the file must not matter."""
    con, got = duckdb.connect(), []
    for order in ("", " DESC"):
        folder = tmp_path / f"rows{len(got)}"
        folder.mkdir()
        con.execute(f"""COPY (SELECT 1000000 + range AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::BIGINT AS user_id, 'view' AS event_type,
            1.0::DOUBLE AS value, '' AS props FROM range(60) ORDER BY 1{order}) TO '{folder}/events.parquet' (FORMAT parquet)""")
        got.append(sorted(map(tuple, REGISTRY[name](spark, str(folder)).collect())))
    assert got[0] == got[1]
