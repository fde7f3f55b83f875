import random

import pyarrow as pa
import pyarrow.parquet as pq

from tagweave.plans import part_queries as Q


def test_first_and_last_rows_of_equal_line_numbers_are_those_stored_first(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.randrange(300), draw.randrange(1, 4), i) for i in range(20_000)]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64()))], names=["l_orderkey", "l_linenumber", "l_partkey"])
    (tmp_path / "lineitem.parquet").mkdir()
    for name, part in (("part-0", table.slice(0, 2000)), ("part-1", table.slice(2000))):  # Spark begins with the larger file
        pq.write_table(part, tmp_path / "lineitem.parquet" / f"{name}.parquet", row_group_size=500)
    first, last, low = {}, {}, {}
    for key, seq, part in rows:
        if key not in first or seq < first[key][0]:
            first[key] = (seq, part)
        if key not in last or seq > last[key][0]:
            last[key] = (seq, part)
        low[key] = min(low.get(key, seq), seq)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "16k")  # so that many tasks read the file and their rows meet in any order
        got = [{r.l_orderkey: (r.l_partkey, r.seq) for r in q(spark, str(tmp_path)).collect()} for q in (Q.first_rows, Q.last_rows)]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got[0] == {k: (part, seq) for k, (seq, part) in first.items()}
    assert got[1] == {k: (part, low[k]) for k, (_, part) in last.items()}
