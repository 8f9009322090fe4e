"""Retries for what the driver itself does (files, services); tasks are retried by Spark."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from typing import Any

#: What can be tried again, by error type; anything else is raised at once.
RECOVERABLE = (ConnectionError, TimeoutError, InterruptedError, OSError)


def retry(times: int = 3, first_wait: float = 1.0, errors: tuple[type[Exception], ...] = RECOVERABLE, sleep: Callable[[float], Any] = time.sleep):
    """Call again after 1, 2, 4, ... times first_wait seconds; the last error is raised."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*args: Any, **kwargs: Any) -> Any:
            for n in range(times):
                try:
                    return f(*args, **kwargs)
                except errors:
                    sleep(first_wait * 2**n)
            return f(*args, **kwargs)

        return run

    return wrap


def error_event(error: Exception, **context: str) -> dict[str, Any]:
    """A row of an error log: error_type, message, context, can_recover, timestamp."""
    return {"error_type": type(error).__name__, "message": str(error), "context": context, "can_recover": isinstance(error, RECOVERABLE), "timestamp": time.time()}
