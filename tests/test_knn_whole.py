import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    """Vectors whose nearest neighbours differ in label only where vec_id is not divisible by 20."""
    d, r = tmp_path_factory.mktemp("knn"), np.random.default_rng(5)
    base = r.normal(size=(60, 8))
    x = np.repeat(base, 2, 0) + r.normal(size=(120, 8)) * 0.01
    ids = np.arange(120)
    label = np.where(ids // 2 % 2 == 0, "a", "b")
    label[ids % 20 == 7] = "c"  # the neighbour of 6 is 7
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([v.tolist() for v in x.astype(np.float32)], pa.list_(pa.float32())), "label": pa.array(label.tolist())}), d / "embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["knn_confusion", "knn_macro_f1"])
def test_every_vector_is_judged(spark, vectors, name):
    got = entry.queries()[name](spark, vectors)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{vectors}/embeddings.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())
    if name == "knn_confusion":
        cells = {(r.y_true, r.y_pred): r.n for r in got.collect()}
        assert sum(cells.values()) == 120 and cells["c", "b"] == 6
