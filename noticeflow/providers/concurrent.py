"""Calls of a provider that wait for an answer elsewhere, some of them at a time."""

from __future__ import annotations

import asyncio
import heapq
import queue
import threading
import time
from collections import deque
from collections.abc import Callable

from noticeflow.providers.base import Provider, opened

IN_FLIGHT, TIMEOUT_SECONDS, ATTEMPTS, PAUSE_SECONDS = 50, 60.0, 3, 0.5
IDLE_SECONDS = 5.0  # after which a thread without calls ends


class Concurrent:
    """A provider whose enrichments run up to ``in_flight`` at a time in each task.

    A call that fails or takes over ``timeout`` seconds is tried again, ``attempts`` times in all, after pauses that double. What
    fails in the end is the answer of its notice alone: the others keep theirs, in the order of the notices. A provider with a
    coroutine ``enrich_async`` is awaited, and cancelled when it is late; another's ``enrich`` runs in threads that are kept from batch to
    batch (see Crew). A thread cannot be stopped, so that a late call goes on behind and its answer is dropped. The executors' tasks times ``in_flight`` bound
    the calls that a service sees.
    """

    def __init__(self, provider: Provider, in_flight: int = IN_FLIGHT, timeout: float = TIMEOUT_SECONDS, attempts: int = ATTEMPTS, pause: float = PAUSE_SECONDS):
        if in_flight < 1 or attempts < 1:
            raise ValueError("in_flight and attempts are at least 1")
        self.provider, self.in_flight, self.timeout, self.attempts, self.pause = provider, in_flight, timeout, attempts, pause
        self.dimension = provider.dimension
        self.intent, self.embed, self.chat, self.enrich = provider.intent, provider.embed, provider.chat, provider.enrich
        self._crew: Crew | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_crew": None}

    def open(self) -> Concurrent:
        return Concurrent(opened(self.provider), self.in_flight, self.timeout, self.attempts, self.pause)

    def enrich_many(self, notices: list[tuple[str, str]]) -> list[dict | Exception]:
        if hasattr(self.provider, "enrich_async"):
            return asyncio.run(self._all(notices))
        if self._crew is None:
            self._crew = Crew(self.provider.enrich, self.in_flight, self.timeout, self.attempts, self.pause)
        return self._crew.run(notices)

    async def _all(self, notices: list[tuple[str, str]]) -> list[dict | Exception]:
        places = asyncio.Semaphore(self.in_flight)

        async def one(notice: tuple[str, str]) -> dict | Exception:
            async with places:
                for attempt in range(self.attempts):
                    if attempt:
                        await asyncio.sleep(self.pause * 2 ** (attempt - 1))
                    try:
                        return await asyncio.wait_for(self.provider.enrich_async(*notice), self.timeout)
                    except TimeoutError:
                        failure: Exception = _late(self.timeout)
                    except Exception as e:
                        failure = e
                return failure

        return list(await asyncio.gather(*map(one, notices)))


def _late(timeout: float) -> TimeoutError:
    return TimeoutError(f"no answer within {timeout:g} s")


class _Batch:
    """Calls by their places: (place, tries before) of those that are ready, the time before it of those that pause, and by thread
    the deadline before it of those that run."""

    def __init__(self, notices: list[tuple[str, str]], lock: threading.Lock):
        self.notices, self.left, self.out = notices, len(notices), [None] * len(notices)
        self.ready: deque[tuple[int, int]] = deque((i, 0) for i in range(len(notices)))
        self.pausing: list[tuple[float, int, int]] = []
        self.running: dict[object, tuple[float, int, int]] = {}
        self.offered, self.wake, self.news = False, 0.0, threading.Condition(lock)


class Crew:
    """Up to ``size`` threads that make the calls of batches; one that is idle for IDLE_SECONDS ends.

    A thread makes calls of a batch for as long as any is ready, and offers the batch to one more thread before each. So calls that
    answer at once cost no change of threads, while each call that waits lets another one begin. A thread whose call is late
    is given up and counts no more.
    """

    def __init__(self, ask: Callable[[str, str], dict], size: int, timeout: float, attempts: int, pause: float):
        self.ask, self.size, self.timeout, self.attempts, self.pause = ask, size, timeout, attempts, pause
        self.lock, self.offers, self.threads, self.idle = threading.Lock(), queue.SimpleQueue(), 0, 0

    def run(self, notices: list[tuple[str, str]]) -> list[dict | Exception]:
        batch = _Batch(notices, self.lock)
        with self.lock:
            while batch.left:
                now = time.monotonic()
                for thread, (deadline, i, before) in list(batch.running.items()):
                    if deadline <= now:
                        del batch.running[thread]
                        self.threads -= 1
                        self._failed(batch, i, before, _late(self.timeout))
                while batch.pausing and batch.pausing[0][0] <= now:
                    batch.ready.append(heapq.heappop(batch.pausing)[1:])
                if batch.ready:
                    self._offer(batch)
                if batch.left:
                    batch.wake = min([now + self.timeout, *(r[0] for r in batch.running.values()), *(p[0] for p in batch.pausing[:1])])
                    batch.news.wait(max(0.0, batch.wake - now))
        return batch.out

    def _offer(self, batch: _Batch) -> None:
        if not batch.offered:
            batch.offered = True
            self.offers.put(batch)
        if self.offers.qsize() > self.idle and self.threads < self.size:
            self.threads, self.idle = self.threads + 1, self.idle + 1
            threading.Thread(target=self._work, daemon=True).start()  # doesn't keep the process alive

    def _next(self, batch: _Batch, thread: object) -> tuple[int, int] | None:
        if not batch.ready:
            return None
        i, before = batch.ready.popleft()
        batch.running[thread] = (time.monotonic() + self.timeout, i, before)
        if batch.ready:
            self._offer(batch)
        return i, before

    def _failed(self, batch: _Batch, i: int, before: int, failure: Exception) -> None:
        if before + 1 < self.attempts:
            due = time.monotonic() + self.pause * 2**before
            heapq.heappush(batch.pausing, (due, i, before + 1))
            if due < batch.wake:
                batch.wake = due
                batch.news.notify()
        else:
            self._done(batch, i, failure)

    def _done(self, batch: _Batch, i: int, answer: dict | Exception) -> None:
        batch.out[i] = answer
        batch.left -= 1
        if not batch.left:
            batch.news.notify()

    def _work(self) -> None:
        me = object()
        while True:
            try:
                batch = self.offers.get(timeout=IDLE_SECONDS)
            except queue.Empty:
                with self.lock:
                    if self.offers.empty():
                        self.threads, self.idle = self.threads - 1, self.idle - 1
                        return
                continue
            with self.lock:
                self.idle -= 1
                batch.offered = False
                call = self._next(batch, me)
            while call:
                i, before = call
                answer, failure = None, None
                try:
                    answer = self.ask(*batch.notices[i])
                except TimeoutError:
                    failure = _late(self.timeout)
                except Exception as e:
                    failure = e
                with self.lock:
                    if batch.running.pop(me, None) is None:  # given up
                        return
                    if failure is None:
                        self._done(batch, i, answer)
                    else:
                        self._failed(batch, i, before, failure)
                    call = self._next(batch, me)
            with self.lock:
                self.idle += 1
