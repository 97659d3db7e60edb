import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lotwright.llm import common


@pytest.mark.parametrize("how", ["inner", "left"])
def test_dealt_join_gives_the_rows_of_a_plain_join(spark, how):
    rows = [(i, "hot" if i % 3 else f"k{i % 40}", f"x{i}") for i in range(3000)] + [(7, "hot", "twice")] * 2 + [(8, None, None), (None, "alone", "")]
    left = spark.createDataFrame(rows, "id long, k string, _salt string")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(30)], ("never", 5)], "k string, _salts int")
    got, want = common.dealt_join(left, right, "k", how, by=["id"]), left.join(right, "k", how)
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_dealt_join_deals_a_hot_key(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        left, right = spark.range(4000).withColumn("k", F.lit(1)), spark.createDataFrame([(1, "a")], "k int, v string")
        tasks = common.dealt_join(left, right, "k", by=["id"]).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in tasks) == 4000 and max(r["count"] for r in tasks) < 2400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_dealt_join_of_empty_tables(spark):
    left, right = spark.createDataFrame([], "id long, k int"), spark.createDataFrame([], "k int, v string")
    assert common.dealt_join(left, right, "k").collect() == []
    assert common.dealt_join(spark.createDataFrame([(1, 2)], left.schema), right, "k", "left").collect() == [(2, 1, None)]


_WORKER = """
import random, re
from pathlib import Path
import public_tokenizers, pyarrow as pa
from lotwright.llm import common, packing

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024

encode = packing._encoder(public_tokenizers.path("word_bpe_49k.json"))
rnd, words = random.Random(1), [f"w{i}x" for i in range(20_000)]
batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rnd.choices(words, k=20_000)) for _ in range(64)])], ["text"])
before = held()
for part in common.chunks(iter([batch]), "text", packing.ENCODED_BYTES):
    encode.rows(part.column("text"))
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_worker_gives_unused_memory_back():
    """Idle workers of one stage of the pipeline stand beside the next stage's executor."""
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "OMP_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", _WORKER], env=env, capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) < 30, "MB"
