"""What tasks leave in their worker process."""

import subprocess
import sys

# Many blocks are freed below one that stays, so the heap cannot shrink by itself.
CODE = """
import numpy as np
from fleetlens.llm.workers import tidy

def held():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Pss_Anon:"))

kept = []

def work(batches):
    blocks = [np.ones(8_000) for _ in range(4_000)]
    kept.append(np.ones(8_000))
    yield len(blocks)

before = held()
list(tidy(work)([]))
print(held() - before)
"""


def test_tasks_hand_freed_memory_back():
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 64_000  # of 256,000 kB
