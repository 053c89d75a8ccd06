"""Limits around a provider: a sliding request window, retries with back-off, a pause after repeated refusals."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from tidemark.errors import IllegalTransition, ProviderError
from tidemark.operators.control import TRANSITIONS


class SlidingWindow:
    """At most ``rpm`` starts in any ``seconds``; a start exactly that old no longer counts.

    Each executor process has its own: give it the global rate divided by the number of processes.
    """

    def __init__(self, rpm: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rpm, self.seconds, self.clock, self.sleep = rpm, seconds, clock, sleep
        self.starts: deque[float] = deque()

    def count(self) -> int:
        """Starts that still count now."""
        now = self.clock()
        while self.starts and self.starts[0] <= now - self.seconds:
            self.starts.popleft()
        return len(self.starts)

    def start(self) -> None:
        """Waits until a start is allowed and records it."""
        while self.count() >= self.rpm:
            self.sleep(max(self.starts[0] + self.seconds - self.clock(), 0.001))
        self.starts.append(self.clock())


def with_retries(call: Callable[[], object], limited: Callable[[Exception], bool], retries: int = 5, first: float = 2.0, most: float = 120.0, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; refusals for the rate are retried with doubling waits, other errors are not."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if not limited(e):
                raise
            if attempt == retries:
                raise ProviderError(f"gave up after {retries} retries") from e
            sleep(min(first * 2**attempt, most))


class Limited:
    """A provider whose calls respect a window and retries, and that counts refusals in a row."""

    def __init__(self, provider, window: SlidingWindow, limited: Callable[[Exception], bool] | None = None, pause_after: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.provider, self.window, self.pause_after, self.sleep = provider, window, pause_after, sleep
        self.limited = limited or (lambda e: any(w in str(e).lower() for w in ("429", "quota", "resource_exhausted")))
        self.refusals = 0

    def __getattr__(self, name: str):
        method = getattr(self.provider, name)
        if not callable(method):
            return method

        def call(*args):
            def once():
                self.window.start()
                try:
                    out = method(*args)
                except Exception as e:
                    self.refusals = self.refusals + 1 if self.limited(e) else self.refusals
                    raise
                self.refusals = 0
                return out

            return with_retries(once, self.limited, sleep=self.sleep)

        return call

    @property
    def should_pause(self) -> bool:
        return self.refusals >= self.pause_after


def transition(state: str, event: str, strict: bool = False) -> str:
    """The state after an event; an illegal one changes nothing, or raises with ``strict``."""
    new = TRANSITIONS.get((state, event))
    if new is None and strict:
        raise IllegalTransition(f"{event} in {state}")
    return new or state
