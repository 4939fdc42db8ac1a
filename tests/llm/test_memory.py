"""What Python workers hold, each measured in a process of its own."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from cairn.llm import exact_dedup as ed

MEMTABLE = """
import numpy as np
import pyarrow as pa
from cairn.llm import exact_dedup as ed

def batches():
    for i in range(20):
        texts = [f"{i} {j} " + "x" * 6000 for j in range(500)]
        texts[:2] = "copy", f"copy {i}"
        yield pa.RecordBatch.from_pydict({"digest": [f"{hash(t) % (1 << 64):064x}" for t in texts], "text": texts, "key": np.arange(500)})

runs = []
for t in ed.memtables(batches(), 24 << 20):
    runs.append(ed.run_of(t))
    del t
assert sum(sum(r["n"].to_pylist()) for r in runs) == 10_000
print(pa.default_memory_pool().max_memory() / (24 << 20))
"""

FREED = """
import re
from pathlib import Path
from cairn.shared import gives_back

def anon():
    return int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

def run(batches):
    blocks = [b"x" * 60_000 for _ in range(2000)]
    yield blocks[-1]  # above the freed ones, so malloc alone keeps those

before = anon()
kept = list((WRAPPED)(iter([])))
print(anon() - before)
"""


def printed(code: str) -> float:
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=120)
    return float(out.stdout)


def test_a_memtable_becomes_a_run_without_a_copy_of_its_texts():
    assert printed(MEMTABLE) < 1.5


def test_a_task_returns_to_the_system_what_it_freed():
    assert printed(FREED.replace("(WRAPPED)", "run")) > 80
    assert printed(FREED.replace("(WRAPPED)", "gives_back(run)")) < 20


def test_run_of_a_memtable_against_plain_python():
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 1), (40, 3), (200, 60), (200, 2000)):
        data = [(f"d{d}", f"t{d}{x}", int(k)) for d, x, k in zip(rng.integers(0, kinds, n), rng.integers(0, 12, n) // 11, rng.integers(0, 99, n), strict=True)]
        batches = pa.Table.from_pylist([dict(zip(("digest", "text", "key"), r, strict=True)) for r in data]).to_batches(max_chunksize=7)
        (t,) = ed.memtables(iter(batches), 1 << 24)
        got = [tuple(r.values()) for r in ed.run_of(t).to_pylist()]
        want = []
        for d in sorted({r[0] for r in data}):
            of = [r for r in data if r[0] == d]
            want.append((d, min(r[2] for r in of), len(of), len({r[1] for r in of}) > 1))
        assert got == want
