"""Settings of a run; all are checked when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _flag(name: str, value: object) -> None:
    if not isinstance(value, bool):
        raise TypeError(f"{name} must be known at build time as a bool, not {value!r}")


@dataclass(frozen=True)
class CompileConfig:
    """``use_unsafe`` has no effect: columnar scans read raw memory anyway.

    ``enable_logging`` prints the plan of each collection, with generated code.
    ``strict_inlining`` refuses collectors that aren't named classes whose methods
    are column expressions, since only those stay inside generated code.
    """

    use_unsafe: bool = True
    enable_logging: bool = False
    strict_inlining: bool = True

    def __post_init__(self) -> None:
        for name in ("use_unsafe", "enable_logging", "strict_inlining"):
            _flag(name, getattr(self, name))


@dataclass(frozen=True)
class RuntimeConfig:
    """How many logical chunks an ordered parallel reduction has.

    Chunks decide the result of order-sensitive reductions only; Spark schedules
    tasks as it likes.
    """

    worker_count: int = field(default_factory=lambda: os.cpu_count() or 1)
    chunks_per_worker: int = 8

    def __post_init__(self) -> None:
        if self.worker_count <= 0:
            raise ValueError("workerCount must be positive")
        if self.chunks_per_worker <= 0:
            raise ValueError("chunksPerWorker must be positive")
