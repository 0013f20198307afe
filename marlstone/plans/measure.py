"""Fingerprints of corpora and timing of repeated runs."""

from __future__ import annotations

import hashlib
import math
import resource
import time
from collections.abc import Callable
from pathlib import Path


def corpus_fingerprint(path: str | Path) -> str:
    """SHA-256 over name and content of every file in the order of paths, each led by its length.

    Links are refused; compiled Python is passed over.
    """
    root = Path(path)
    files = [root] if not root.is_dir() else [p for p in sorted(root.rglob("*")) if (p.is_file() or p.is_symlink()) and "__pycache__" not in p.relative_to(root).parts]
    h = hashlib.sha256()
    for p in files:
        if p.is_symlink() or root.is_symlink():
            raise ValueError(f"{p} is a link")
        for piece in (str(p.relative_to(root) if root.is_dir() else p.name).encode(), p.read_bytes()):
            h.update(len(piece).to_bytes(8, "big") + piece)
    return f"sha256:{h.hexdigest()}"


def measure(run: Callable[[], object], warmups: int = 1, repetitions: int = 5, gate_ns: int | None = None) -> dict:
    """Latencies of a run with their nearest-rank p50 and p95, throughput and this process's peak memory;
    the gate, if there is one, is on p95."""
    if warmups < 0 or repetitions <= 0 or (gate_ns is not None and gate_ns <= 0):
        raise ValueError("repetitions and the gate are positive, warm-ups not negative")
    for _ in range(warmups):
        run()
    took = []
    for _ in range(repetitions):
        start = time.perf_counter_ns()
        run()
        took.append(time.perf_counter_ns() - start)
    at = lambda share: sorted(took)[max(0, math.ceil(share * len(took)) - 1)]
    out = {"warmups": warmups, "repetitions": repetitions, "latency_ns": took, "p50_ns": at(0.5), "p95_ns": at(0.95), "runs_per_second": repetitions / (sum(took) / 1e9), "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024}
    return out | {"gate_ns": gate_ns, "passed": None if gate_ns is None else out["p95_ns"] <= gate_ns}
