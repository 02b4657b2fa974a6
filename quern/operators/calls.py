"""Calls to a service from tasks: a bounded number in flight, results in order, nothing read ahead of what is in flight."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any


def ordered_calls(items: Iterable[Any], call: Callable[[Any], Any], in_flight: int) -> Iterator[Any]:
    """call(item) for each item, in the items' order. At most `in_flight` calls run at a time, and an item is taken from the source only when
    there is room for its call, so a slow service holds the source back. An exception of a call is raised where its result would be; the
    calls that are running then are awaited."""
    if in_flight < 1:
        raise ValueError("in_flight must be positive")
    if in_flight == 1:
        yield from map(call, items)
        return
    pool, waiting = ThreadPoolExecutor(in_flight), deque[Future]()
    try:
        for item in items:
            waiting.append(pool.submit(call, item))
            if len(waiting) == in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
    finally:
        for f in waiting:
            f.cancel()
        pool.shutdown(wait=True)


def task_count(cluster_limit: int, in_flight: int) -> int:
    """The number of partitions with which all tasks together keep to a limit: each has `in_flight` calls at most."""
    if cluster_limit < in_flight:
        raise ValueError("a task alone would exceed the limit")
    return cluster_limit // in_flight
