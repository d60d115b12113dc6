"""Small helpers of the driver's side: caches, ordered parallel calls, timing."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cache, wraps

memoize = cache


def timed_cache(seconds: float):
    """Remember results for so long."""

    def wrap(fn):
        held: dict = {}

        @wraps(fn)
        def call(*a, **k):
            key, now = (a, tuple(sorted(k.items()))), time.monotonic()
            if key not in held or now - held[key][0] >= seconds:
                held[key] = (now, fn(*a, **k))
            return held[key][1]

        call.clear = held.clear
        return call

    return wrap


def parallel_map(fn: Callable, items: Iterable, workers: int = 8) -> list:
    """Results in order; an item that fails gives None. For jobs of the driver, such as submitting several plans at once."""

    def one(x):
        try:
            return fn(x)
        except Exception:
            logging.getLogger(__name__).exception("item failed")
            return None

    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(one, items))


@contextmanager
def timer(name: str):
    t = time.perf_counter()
    got: dict = {"name": name}
    try:
        yield got
    finally:
        got["seconds"] = time.perf_counter() - t
        logging.getLogger(__name__).debug("%s took %.3f s", name, got["seconds"])
