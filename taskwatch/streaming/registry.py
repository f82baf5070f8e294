"""Model versions for running streams (T5), and what a micro-batch is bound to.

A version is a folder ``version=<name>`` that is written whole and committed
last by one small marker file. The marker is created, never overwritten, so a
version is either visible whole or not at all, and no two publishers can commit
the same name. Names are ordered by time.

A stream's ledger binds every micro-batch, when it is first tried, to the
newest version and to what earlier batches had seen. The binding is created
once; a retry, also after a restart and also if newer versions were published
meanwhile, reads it and does the same work with the same models. A second
entry closes a batch when its outputs exist.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import SparkSession

from taskwatch.config import Params
from taskwatch.plans.detector import DetectorModel
from taskwatch.plans.featurize import FeatureModel
from taskwatch.plans.jobs import train_job

READY = "_READY"


class Files:
    """Small files through the Hadoop FileSystem of their path."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, path: str, text: str) -> bool:
        """Write ``text`` unless the file exists; whether it was written. The
        text goes to a file of its own first, so that the file is never seen in part."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        draft = p.suffix(f".{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.exists(p) and fs.rename(draft, p):
            return True
        fs.delete(draft, False)
        return False

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class ModelRegistry:
    """Versions of fitted models under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)
        self._held: tuple[str, tuple[FeatureModel, DetectorModel]] | None = None

    def path(self, version: str) -> str:
        return os.path.join(self.root, f"version={version}")

    def new_version(self) -> str:
        """Ordered by time, and never the same for two publishers."""
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def commit(self, version: str) -> str:
        """Make a version whose files are all written visible."""
        if not self.files.create(os.path.join(self.path(version), READY), version):
            raise FileExistsError(f"version {version} is committed already")
        return version

    def versions(self) -> list[str]:
        """Committed versions, oldest first."""
        names = [n[8:] for n in self.files.names(self.root) if n.startswith("version=")]
        return [n for n in names if self.files.exists(os.path.join(self.path(n), READY))]

    def newest(self) -> str:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no published model under {self.root}")
        return found[-1]

    def publish(self, features: FeatureModel, detector: DetectorModel, version: str | None = None) -> str:
        """Save fitted models as a new version."""
        version = version or self.new_version()
        features.save(os.path.join(self.path(version), "features"))
        detector.save(self.spark, os.path.join(self.path(version), "detector"))
        return self.commit(version)

    def retrain(self, data_path: str, params: Params | None = None, version: str | None = None) -> str:
        """Train on the task table at ``data_path`` into a new version. A failed
        training leaves a folder without marker, which no stream reads."""
        version = version or self.new_version()
        train_job(self.spark, data_path, self.path(version), params)
        return self.commit(version)

    def load(self, version: str) -> tuple[FeatureModel, DetectorModel]:
        """The models of a committed version; the last one loaded is kept."""
        if self._held is None or self._held[0] != version:
            path = self.path(version)
            self._held = (version, (FeatureModel.load(self.spark, os.path.join(path, "features")),
                                    DetectorModel.load(self.spark, os.path.join(path, "detector"))))
        return self._held[1]


class BatchLedger:
    """Per micro-batch: what it is bound to (``open``) and what it left behind (``done``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.files = path, Files(spark)

    def _file(self, kind: str, batch_id: int) -> str:
        return os.path.join(self.path, f"{kind}-{batch_id:012d}")

    def last_done(self, before: int) -> dict | None:
        """The entry of the latest batch before ``before`` that was closed."""
        ids = [int(n[5:]) for n in self.files.names(self.path) if n.startswith("done-") and n[5:].isdigit()]
        ids = [i for i in ids if i < before]
        return json.loads(self.files.read(self._file("done", max(ids)))) if ids else None

    def open(self, batch_id: int, registry: ModelRegistry) -> dict:
        """The binding of a batch: made at its first try, read again by a retry."""
        path = self._file("open", batch_id)
        if not self.files.exists(path):
            seen = (self.last_done(batch_id) or {}).get("seen")
            self.files.create(path, json.dumps({"batch": batch_id, "version": registry.newest(), "seen": seen}))
        return json.loads(self.files.read(path))

    def close(self, batch_id: int, seen: str | None) -> None:
        self.files.create(self._file("done", batch_id), json.dumps({"batch": batch_id, "seen": seen}))
