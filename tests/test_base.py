"""The raw table moves every line once per aggregate."""

from ordstack.plans import fixture


def test_base_moves_no_line_twice(spark, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    line = [(1, 7, 3), (1, 7, 3), (1, 8, None), (1, None, 3), (2, None, 4), (None, 5, 5)]
    write(
        [(o, p, s, 1.0, 0.1, 0.1, 2.0) for o, p, s in line],
        "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double",
        "lineitem",
    )
    write([(i, 1, 5.0, "1", "O", None) for i in (1, 2, 3)],
          "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string, o_orderdate date", "orders")
    write([(1, 1, "a", 1.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", "customer")
    made = fixture.base(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in made.select("row_id", "f_0", "f_11", "target").collect())
    assert rows == [(1, 2, 1, 4), (2, 0, 1, 1), (3, 0, 0, 0)]
    assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()
