"""Progress of long calculations, as told to a callback."""

from __future__ import annotations

import time
from collections.abc import Callable


class Progress:
    """Calls callback(step, done, total, unit, seconds since the start) as work is done; without a callback does nothing."""

    def __init__(self, callback: Callable | None, total: int, unit: str = "calculations"):
        self.callback, self.total, self.unit, self.done, self.begun = callback, total, unit, 0, time.monotonic()

    def step(self, n: int = 1) -> None:
        self.done += n
        if self.callback is not None:
            self.callback(n, self.done, self.total, self.unit, time.monotonic() - self.begun)
