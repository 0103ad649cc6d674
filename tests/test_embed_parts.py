"""What the learned embedding moves and holds."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from ordstack.models import embed


def test_a_column_is_met_by_few_tasks(spark):
    rng = random.Random(2)
    rows = [(i, [(0, 1.0), (1 + rng.randrange(200), 1.0)]) for i in range(4000)]
    cells = spark.createDataFrame(rows, "row_id long, cells array<struct<idx: bigint, value: double>>").repartition(8)
    made = embed._clustered(cells, 201)

    def met(batches):
        seen = set()
        for b in batches:
            seen |= {x["idx"] for row in b.column(0).to_pylist() for x in row}
        yield pa.RecordBatch.from_arrays([pa.array([len(seen)])], names=["n"])

    assert made.count() == 4000
    counts = [r.n for r in made.select("cells").mapInArrow(met, "n long").collect()]
    assert sum(counts) <= 201 + 3 * len(counts)


def test_slices_bound_what_a_task_multiplies():
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000))], names=["x"])
    parts = list(embed._parts(iter([batch]), 1032))
    assert sum(p.num_rows for p in parts) == 10_000 and max(p.num_rows for p in parts) * 1032 <= embed.STEP


CELLS = "row_id long, cells array<struct<idx: bigint, value: double>>"


def some_rows(n, width, seed):
    """Rows of several cells, one with none, a repeated row and one whose column is met twice."""
    rng = np.random.default_rng(seed)
    rows = [[(int(i), float(rng.normal())) for i in rng.choice(width, 4, replace=False)] for _ in range(n)]
    return [*rows, [], rows[0], [(1, 2.0), (1, 3.0)]]


def dense(rows, width):
    out = np.zeros((len(rows), width))
    for r, cells in enumerate(rows):
        for i, v in cells:
            out[r, i] += v
    return out


def test_columns_that_meet_are_summed_once(spark, monkeypatch):
    rows = some_rows(300, 40, 5)
    cells = spark.createDataFrame(list(enumerate(rows)), CELLS).repartition(5)
    whole = dense(rows, 40)
    for pairs, few in ((embed.DENSE_PAIRS, embed.PAIRS), (0, 50)):  # multiplied, or looked for pair by pair
        monkeypatch.setattr(embed, "DENSE_PAIRS", pairs)
        monkeypatch.setattr(embed, "PAIRS", few)
        found = embed._crossed(cells, 40, 8).collect()
        got = np.zeros((40, 40))
        for r in found:
            got[r.idx, r.j] = r.g
        assert len(found) == len({r.idx for r in found})
        assert np.allclose(got, whole.T @ whole)


def test_a_basis_of_many_blocks_is_applied_without_storing_dense_rows(spark, monkeypatch):
    rows = some_rows(500, 60, 6)
    cells = spark.createDataFrame([(i, f"n{i}", r) for i, r in enumerate(rows)], "row_id long, name string, " + CELLS[13:])
    lines = np.random.default_rng(7).normal(size=(60, 6))
    lines[9] = 0  # not in the table
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(lines) if i != 9], "idx long, v array<double>")
    stored, store = [], embed.store
    monkeypatch.setattr(embed, "store", lambda df, label: stored.append(df.columns) or store(df, label))
    monkeypatch.setattr(embed, "BLOCK_BYTES", 8 * 60)
    monkeypatch.setattr(embed, "PART_ROWS", 100)
    basis = embed.Basis(table, 60, 6, [1.0] * 6)
    assert len(basis.blocks()) == 6
    for few in (embed.DENSE_LINES, 0):
        monkeypatch.setattr(embed, "DENSE_LINES", few)
        got = embed.embed_rows(cells, basis, ["row_id", "name"], 7).toPandas().sort_values("row_id")
        assert got["name"].tolist() == [f"n{i}" for i in range(len(rows))]
        values = got[[f"e_{i}" for i in range(7)]].to_numpy()
        assert np.allclose(values[:, :6], dense(rows, 60) @ lines) and not values[:, 6].any()
    assert stored and not any(c.startswith("_e") for columns in stored for c in columns)


def test_a_projection_adds_a_rows_cells_up_without_a_search_per_component(spark):
    rows = [*some_rows(50, 300, 8), [(4, None), (5, 1.0)]]
    cells = spark.createDataFrame([(i, f"n{i}", r) for i, r in enumerate(rows)], "row_id long, x string, " + CELLS[13:]).withColumnRenamed("x", "a.name")
    made = embed.project(cells, 16, 3)
    assert "try_element_at" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas().sort_values("row_id")
    want = np.zeros((len(rows), 16))
    for r, held in enumerate(rows[:-1]):
        for i, v in held:
            digest = hashlib.md5(f"3:{i}".encode()).hexdigest()
            want[r, int(digest[:8], 16) % 16] += v * (1 if int(digest[8], 16) % 2 == 0 else -1)
    values = got[[f"e_{i}" for i in range(16)]].to_numpy()
    assert np.array_equal(values[:-1], want[:-1]) and np.isfinite(values[-1]).all()
    assert got["a.name"].tolist() == [f"n{i}" for i in range(len(rows))]
