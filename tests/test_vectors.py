"""The cell index against brute force."""

import tracemalloc

import numpy as np
import pandas as pd

from pairloom.operators import vectors
from pairloom.plans import similarity


def test_cell_index_recall(spark, tmp_path):
    rows = np.random.default_rng(3).normal(size=(1500, 64))
    table = [(i, x.tolist(), i % 10) for i, x in enumerate(rows)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    exact, found = ({(r.query, r.neighbour) for r in query(spark, str(tmp_path)).collect()} for query in (similarity.vector_knn, similarity.vector_ivf))
    assert len(exact) == 75 * 5 and len(exact & found) >= 0.9 * len(exact)


def test_full_blocks_are_scored_in_little_memory():
    """Two full blocks take a small part of the 540 MB that their whole matrix and its order take."""
    rng = np.random.default_rng(3)
    units = list(rng.normal(size=(vectors.BLOCK, 8)))
    marks = [str(i) for i in range(vectors.BLOCK)]
    a, b = pd.DataFrame({"qid": range(vectors.BLOCK), "qunit": units, "qmark": marks}), pd.DataFrame({"id": range(vectors.BLOCK), "unit": units, "mark": marks})
    tracemalloc.start()
    made = vectors.block_nearest(a, b, 2, -100.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and len(made) == 2 * vectors.BLOCK
    whole = np.stack(units) @ np.stack(units).T
    np.fill_diagonal(whole, -np.inf)
    assert made["neighbour"].to_numpy()[::2].tolist() == whole.argmax(axis=1).tolist()


def test_probed_cells_are_scored_in_blocks(spark, monkeypatch):
    """All cells give what brute force gives, from blocks of cells; before, each pair of vectors was a row."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    units = np.random.default_rng(5).normal(size=(300, 8))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist(), int(x[0] > 0)) for i, x in enumerate(units)], "id long, unit array<double>, cell int")
    found = vectors.probe_search(rows.where("id % 3 = 0"), rows, [[0.5] + [0.0] * 7, [-0.5] + [0.0] * 7], 4, 2)
    assert "CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()
    exact = vectors.nearest(rows.where("id % 3 = 0"), rows, 4)
    got, want = ({(r["query"], r["rank"], r["neighbour"]) for r in x.collect()} for x in (found, exact))
    assert got == want and len(got) == 400
