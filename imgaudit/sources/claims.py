"""Who builds a table: a claim beside it, held by one driver at a time and lost with it."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession

from imgaudit.sources.files import create_new, modified, read_text, remove, rename, touch


class Claim:
    """A file created in one step, with its owner inside, and touched while the owner lives.

    A claim not touched for ``lease`` seconds belongs to a lost driver. Whoever moves it aside
    first may claim anew. Clocks of drivers and the file system should agree within the lease.
    """

    def __init__(self, spark: SparkSession, path: str, lease: float = 60.0):
        self.spark, self.path, self.lease = spark, path, lease
        self.owner = uuid.uuid4().hex
        self._done = threading.Event()

    def take(self) -> bool:
        """Try to become the owner; true if this is it now."""
        if create_new(self.spark, self.path, self.owner):
            self._done.clear()
            threading.Thread(target=self._renew, daemon=True).start()
            return True
        seen = modified(self.spark, self.path)
        if seen is not None and time.time() * 1000 - seen > self.lease * 1000:
            aside = f"{self.path}-lost-{uuid.uuid4().hex}"
            if rename(self.spark, self.path, aside):
                remove(self.spark, aside)
        return False

    def held(self) -> bool:
        """Whether the claim is still this driver's."""
        return read_text(self.spark, self.path) == self.owner

    def release(self) -> None:
        self._done.set()
        if self.held():
            remove(self.spark, self.path)

    def _renew(self) -> None:
        while not self._done.wait(self.lease / 3) and self.held():
            touch(self.spark, self.path, int(time.time() * 1000))
