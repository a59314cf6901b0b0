"""Versions of a folder, published one after the other by the exclusive creation of one file each."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tomeforge.runtime import delete_path


class Superseded(RuntimeError):
    """Another run has published a version meanwhile."""


class Versions:
    """A state (any JSON object) per version; what it names is written before, so a version is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_published")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _state(self, number: int) -> dict:
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_published/{number:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict | None:
        """The state of the latest version, with its number as version; None before the first. Errors of the file system are raised."""
        numbers = self._numbers()
        return self._state(numbers[-1]) if numbers else None

    def new_folder(self) -> str:
        return f"{self.path}/v-{uuid.uuid4().hex}"

    def publish(self, after: dict | None, state: dict) -> dict:
        """Publish state as the version after `after`; only one run can, as a rename never replaces a file that is there."""
        state = state | {"version": after["version"] + 1 if after else 1}
        jvm, fs = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(path(f"{self.path}/_published"))
        draft = path(f"{self.path}/_published/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = path(f"{self.path}/_published/{state['version']:012d}")
        try:
            context.rename(draft, target, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Superseded(f"version {state['version']} was published by another run") from e
            raise
        return state

    def vacuum(self, keep: int = 2, older_than_seconds: float = 86_400.0) -> int:
        """Delete folders that none of the last `keep` versions names and that have been untouched for a while; returns their number."""
        jvm, fs = self._fs()
        used = " ".join(json.dumps(self._state(v)) for v in self._numbers()[-max(1, keep) :])
        limit = jvm.java.lang.System.currentTimeMillis() - older_than_seconds * 1000
        gone = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used and s.getModificationTime() <= limit]
        for name in gone:
            delete_path(self.spark, f"{self.path}/{name}")
        return len(gone)
