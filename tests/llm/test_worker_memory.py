"""What a Python worker holds from task to task, and how many rows it gets at a time."""

import os
import subprocess
import sys

import corpus_pipeline

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Runs tasks over 24 MB of text in batches of 2000 rows, and tells how many MB the process has grown by at most.
SCRIPT = """
import io, random, re, sys, threading, time
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa
from eventwarden.llm import near_dedup, repeats

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

rnd = random.Random(4)
words = ["".join(rnd.choice("bcdfghkprt") for _ in range(5)) for _ in range(999)]
texts = [" ".join(rnd.choices(words, k=330)) for _ in range(2000)]
sink = io.BytesIO()
with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64()), ("text", pa.string())])) as out:
    for n in range(6):
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["id", "text"]))
open({path!r}, "wb").write(sink.getvalue())
del texts, sink, out

def batches():
    with open({path!r}, "rb") as file:
        yield from pa.ipc.open_stream(file)

def edited(batch):
    n = len(batch)
    places = pa.array([[3] if k % 5 == 0 else [] for k in range(n)], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*batch.columns, places, pa.array([False] * n), pa.array([0] * n, pa.int64())],
                                      ["id", "text", "places", "whole", "level"])

pa.default_memory_pool().release_unused()
begin, most, stop = held(), [0], threading.Event()
def watch():
    while not stop.is_set():
        most[0] = max(most[0], held())
        time.sleep(0.002)
thread = threading.Thread(target=watch)
thread.start()
for task, rows in ((near_dedup.signature_of(near_dedup.Banding.of(0.8), 5), batches()),
                   (near_dedup.shingle_sets(5), batches()), (repeats.cut_out(50), map(edited, batches()))):
    for batch in task(rows):
        pass
    del batch
stop.set()
thread.join()
print("grown", round(most[0] - begin), round(held() - begin))
"""


def grown(path) -> tuple[int, int]:
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, path=str(path))], capture_output=True, text=True, timeout=120)
    assert "grown" in done.stdout, done.stderr[-2000:]
    most, left = done.stdout.split("grown")[1].split()
    return int(most), int(left)


def test_a_worker_holds_little(tmp_path):
    most, left = grown(tmp_path / "rows.arrow")
    assert most < 70 and left < 70, (most, left)


def test_stages_leave_no_text_task_to_the_writer(spark, tmp_path):
    """The batch size is that of the session that writes: stages but the first write what tasks over texts give them."""
    words = [f"w{n}" for n in range(120)]
    rows = [(n, " ".join(words[n % 7:] + [f"d{n}x{k}" for k in range(200)])) for n in range(20)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"i{n}" for n in range(30)))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert name == "toxicity" or "MapInArrow" not in docs._jdf.queryExecution().toString(), name
    assert docs.count() == 20
