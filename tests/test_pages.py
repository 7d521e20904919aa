from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from scanloom.operators import page_arrays as P
from scanloom.plans import layout


def test_near_pairs_are_all_pairs(monkeypatch):
    monkeypatch.setattr(P, "PAIRS_AT_ONCE", 500)
    rng = np.random.default_rng(5)
    page = np.repeat([0, 1, 2], [40, 300, 5])
    make = lambda: np.column_stack([rng.integers(0, 700, (len(page), 2)), rng.integers(20, 300, (len(page), 2))]).astype("float64")
    a, b = make(), make()
    i, j, iou = P.near_pairs(page, a, page[:320], b[:320], 0.3, 64.0)
    want = {(x, y) for x in range(len(a)) for y in range(320) if page[x] == page[y] and P.overlap_ratios(a[x : x + 1], b[y : y + 1])[0] >= 0.3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 100 and iou.min() >= 0.3


def test_decisions_of_odd_lines_as_in_sql_with_one_shuffle(spark, tmp_path):
    random.seed(2)
    keys = [(random.randrange(200), random.randrange(1, 8)) for _ in range(1500)] + [(10**6, k) for k in range(1, 400)] + [(None, 3)]
    rows = [(o, k, random.choice([*[None] * 60, *range(1, 300)]) if o != 10**6 else random.randrange(9000), random.randrange(1, 99), float(random.randrange(1, 51)), random.choice("ANR"), random.choice("FO")) for o, k in keys]
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]
    pq.write_table(pa.table({n: pa.array([r[i] for r in rows], types[i]) for i, n in enumerate(names)}), tmp_path / "lineitem.parquet")
    out = layout.apply_decisions(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = order(out.collect())
    assert got == order(con.execute(layout.SQL["apply_decisions"]).fetchall()) and any((r[0] or 0) < 0 for r in got)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 0
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
