"""A lease on shared storage: of several drivers one at a time writes an index.

The holder is who wrote the lease file, which is created only where there is none, and reads itself in
it afterwards. It touches the file while it works; a file that was not touched for `ttl` seconds is of a
driver that is gone, and is set aside by renaming, which one of those who wait succeeds in.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import EngineError

TTL, WAIT, EVERY = 120.0, 3600.0, 1.0


class LeaseLost(EngineError):
    """Another driver has taken the lease over."""


class _File:
    def __init__(self, spark: SparkSession, path: str):
        self._new, self.path = spark._jvm.org.apache.hadoop.fs.Path, path
        self._fs = self._new(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def owner(self) -> str | None:
        try:
            held = self._fs.open(self._new(self.path))
        except Py4JJavaError:
            return None
        try:
            return held.readUTF()
        except Py4JJavaError:  # not written yet
            return ""
        finally:
            held.close()

    def age(self) -> float | None:
        try:
            return time.time() - self._fs.getFileStatus(self._new(self.path)).getModificationTime() / 1000
        except Py4JJavaError:
            return None

    def take(self, me: str) -> bool:
        try:
            out = self._fs.create(self._new(self.path), False)
            out.writeUTF(me)
            out.close()
        except Py4JJavaError:
            return False
        time.sleep(0.05)
        return self.owner() == me

    def touch(self) -> None:
        self._fs.setTimes(self._new(self.path), int(time.time() * 1000), -1)

    def set_aside(self) -> None:
        gone = f"{self.path}.{uuid.uuid4().hex}"
        if self._fs.rename(self._new(self.path), self._new(gone)):
            self._fs.delete(self._new(gone), False)

    def drop(self) -> None:
        self._fs.delete(self._new(self.path), False)


@contextmanager
def lease(spark: SparkSession, path: str, ttl: float = TTL, wait: float = WAIT, every: float = EVERY) -> Iterator[None]:
    """Holds the lease of `path` inside; waits for it up to `wait` seconds. If it was lost meanwhile, the end
    raises LeaseLost."""
    file, me, until = _File(spark, path), uuid.uuid4().hex, time.time() + wait
    while not file.take(me):
        if time.time() > until:
            raise EngineError(f"{path} was held by another driver for {wait:g} s")
        age = file.age()
        if age is not None and age > ttl:
            file.set_aside()
        else:
            time.sleep(every)
    done = threading.Event()

    def keep() -> None:
        while not done.wait(ttl / 4):
            if file.owner() != me:
                return
            file.touch()

    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        yield
    finally:
        done.set()
        keeper.join()
        mine = file.owner() == me
        if mine:
            file.drop()
    if not mine:
        raise LeaseLost(f"{path} was taken over by another driver")
