"""Python workers live on from stage to stage; what a stage has used must not stay with them."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing
from tessera.llm.common import worker_cache

CODE = """
import re, sys
import numpy as np, pyarrow as pa
from tessera.llm import minhash, packing

def mb():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    text = pa.array(texts)
    return pa.RecordBatch.from_arrays([ids, ids, text] if sys.argv[1] == "sketch" else [ids, text, ids], ["a", "b", "c"])

run = minhash._sketch(5, 38, 6) if sys.argv[1] == "sketch" else packing._pieces(packing.VOCABULARY, 2048, 1, 1, True)
list(run([batch(["a few words"])]))
g, before = np.random.default_rng(3), mb()
for _ in run(batch([" ".join(f"w{x}" for x in g.integers(0, 9999, 300).tolist()) for _ in range(2000)]) for _ in range(3)):
    pass
print(mb() - before)
"""


@pytest.mark.parametrize("name, most", [("sketch", 5), ("pieces", 15)])
def test_freed_memory_goes_back_at_the_end_of_a_task(name, most):
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", CODE, name], cwd=root, capture_output=True, text=True, timeout=120)
    assert float(done.stdout.split()[-1]) < most, done.stderr[-500:]


def test_packing_drops_the_encoder_with_one_shard_too():
    worker_cache()["encoder", "x"] = np.zeros(9)
    one = np.array([5, 1], "<u2").tobytes()
    t = pa.table({"shard": pa.array([0], pa.int32()), "id": [1], "start": [0], "length": [2], "crc": [0], "doc_tokens": [2], "ids": pa.array([one], pa.binary()), "again": [0]})
    assert packing._fill(2048, True, True)(t).num_rows == 1
    assert not worker_cache()
