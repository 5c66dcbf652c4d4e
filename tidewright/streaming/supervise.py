"""Restarts of a live topology from its checkpoint, with the delays of a schedule."""

from __future__ import annotations

import time
from collections.abc import Callable

from ..functions.schedule import Schedule
from .live import Handle


def supervise(start: Callable[[], Handle], schedule: Schedule, retryable: Callable[[Exception], bool] = lambda _: True, sleep: Callable[[float], None] = time.sleep) -> Handle:
    """Runs until the query ends well. After a failure it starts anew; a run that made progress resets the schedule."""
    attempt, elapsed = 0, 0.0
    while True:
        handle = None
        try:
            handle = start()
            handle.await_exit()
            return handle
        except Exception as error:
            if handle is not None and handle.metrics()["items_processed"] > 0 and attempt:
                attempt, elapsed = 0, 0.0
            if not retryable(error) or (delay := schedule.step(attempt, elapsed)) is None:
                raise
            sleep(delay / 1000)
            attempt, elapsed = attempt + 1, elapsed + delay
