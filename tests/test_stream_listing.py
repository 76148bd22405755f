"""A stream of many small files is not held up by the tasks that look at them."""

import os

from tidemark.streaming import stream_filings

LOOKERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def test_files_are_looked_at_by_few_tasks(spark, tmp_dir):
    src, n = f"{tmp_dir}/in", 300
    for i in range(n):
        os.makedirs(f"{src}/{i % 7}", exist_ok=True)
        with open(f"{src}/{i % 7}/{i:05d}.txt", "w") as f:
            f.write(f"filing {i}")
    spark.conf.unset(LOOKERS)
    df = stream_filings(spark, src)
    few = int(spark.conf.get(LOOKERS))
    assert few < 100 and few >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = (df.writeStream.format("parquet").option("path", f"{tmp_dir}/out")
         .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.accession, r.raw) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert got == {(f"{i:05d}", f"filing {i}") for i in range(n)}

    spark.conf.set(LOOKERS, "77")              # a session's own choice stays
    stream_filings(spark, src)
    assert spark.conf.get(LOOKERS) == "77"
    spark.conf.unset(LOOKERS)
