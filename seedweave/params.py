"""Match parameters: every size in the engine derives from one threshold."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_THRESHOLD = 31


@dataclass(frozen=True)
class MatchParams:
    """``threshold`` (T) is the shortest matching stretch that may score.

    ``step`` is the stride of the seeds cut from a read, ``k`` their length.
    """

    threshold: int = DEFAULT_THRESHOLD

    def __post_init__(self) -> None:
        if not isinstance(self.threshold, int) or isinstance(self.threshold, bool):
            raise ValueError(f"threshold must be an integer, got {self.threshold!r}")
        # A threshold of 1 would give a seed stride of zero.
        if self.threshold < 2:
            raise ValueError(f"threshold must be at least 2, got {self.threshold}")

    @property
    def step(self) -> int:
        return self.threshold // 2

    @property
    def k(self) -> int:
        return self.threshold - self.step + 1


def check_percentage(value: float, name: str = "percentage") -> float:
    if not 0 <= value <= 100:
        raise ValueError(f"{name} must lie between 0 and 100, got {value}")
    return value
