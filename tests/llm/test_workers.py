"""What a Python worker keeps of a task that is done."""

import re
from pathlib import Path

from driftloom.llm.common import giving_back


def own_mb():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_a_worker_gives_back_what_a_task_took():
    kept = []

    def work(batches):
        rows = [bytes(600) for _ in range(250_000)]
        kept.append(bytes(600))  # stands behind the others, so their room is not at the end
        yield len(rows)

    list(giving_back(work)(iter([])))
    before = own_mb()
    assert list(giving_back(work)(iter([]))) == [250_000]
    assert own_mb() < before + 40
    list(work(iter([])))
    assert own_mb() > before + 100
