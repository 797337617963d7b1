"""Contract checks: names, SQL twins, and that the flagship runs."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from check import TABLES, canon
from tests.conftest import SF


def test_registry_is_consistent():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) >= 180 and set(s) <= set(q) and len(s) >= 150


def test_every_inventory_row_has_a_query():
    have = {n.split("__")[-1].rstrip("q") for n in entry.queries()}
    rows = {"S": 12, "P": 19, "J": 14, "U": 5, "G": 11, "B": 17, "A": 27, "W": 9, "T": 14, "M": 15, "I": 14, "E": 16, "X": 8}
    missing = [f"{k}{i}" for k, n in rows.items() for i in range(1, n + 1) if f"{k}{i}" not in have]
    assert not missing


def test_flagship_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and {"cov_group", "width_group", "inf_rate"} <= set(df.columns)


@pytest.mark.parametrize("name", ["array_content_hash__P10", "keyed_seeds__P15", "cell_keys__P16", "table_expectations__S10"])
def test_key_and_check_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert len(got) and canon(got).equals(canon(want))


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_array_hash_equals_its_sql_on_ties_and_odd_elements(spark, tmp_path, kind):
    """Binary values halfway between two decimals, missing, infinite and huge ones; empty and missing arrays."""
    rng = np.random.default_rng(2)
    inf, nan = float("inf"), float("nan")
    vecs = [[0.10351562, k / 512, -k / 512] for k in range(1, 40)] + rng.normal(0, 1, (50, 7)).tolist()
    vecs += [[1.0, None, 2.0], [1.0, 2.0, None], [None], [], None, [nan, 1.0], [-nan, 1.0], [inf, -inf], [0.0], [-0.0], [-1e-9], [5e-9]]
    vecs += [[1e23], [3e38], [1234567890.1234567], [-123456789.12345678]]
    e = pa.table({"vec_id": pa.array(range(len(vecs)), pa.int64()), "embedding": pa.array(vecs, pa.list_(kind))})
    pq.write_table(e, tmp_path / "embeddings.parquet")
    name = "array_content_hash__P10"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert len(got) == len(vecs) and canon(got).equals(canon(want))


def test_near_duplicate_query_equals_its_sql_on_copies_and_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.125, (120, 64)).astype(np.float32).tolist()
    vecs = base + base[:30] + [base[0]] * 10 + [[None, *base[1][1:]], [None] * 64, base[2][:40], base[2] + [3.0], [], None]
    vecs += [[float("inf"), *base[1][1:]], [float("nan"), *base[1][1:]]]
    ids = [*range(len(vecs) - 1), 0]
    e = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array([i % 2 for i in range(len(vecs))], pa.int32())})
    pq.write_table(e, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    name = "join_near_duplicates__J9"
    got, want = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert (want["rms"] == 0).sum() > 50 and canon(got).equals(canon(want))
