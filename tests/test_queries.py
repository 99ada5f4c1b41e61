import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxframe import registry

SF = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all of them.
SOME = ["m1_segment_and_measure", "agg_20_triangle", "krn_4_eigen_2d", "agg_17_tortuosity", "jon_5_nearest", "agg_31_best_matches", "opr_6_interpolate_backward", "opr_7_reassign_chain", "agg_7_mode", "jon_12_overlay", "src_12_output_name", "prj_4_validation"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def text(rows):
    return sorted(tuple("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert text(df.select(*cols).collect()) == text(want)


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
