"""Where models, panels and caches lie: one object, passed on instead of looked up."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession


def first_folder(spark: SparkSession, folders: Sequence[str], pattern: str) -> str | None:
    """The first of the folders with a file of the pattern, such as `*.npy`; None if none has one."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return folder
    return None


@dataclass(frozen=True)
class Places:
    """Folders below a root, which is HELIXFRAME_HOME or a folder in the home directory unless it is named."""

    root: str = ""

    @property
    def home(self) -> str:
        return self.root or os.environ.get("HELIXFRAME_HOME") or os.path.join(os.path.expanduser("~"), ".helixframe")

    def cache(self) -> str:
        return f"{self.home}/cache"

    def model(self, name: str = "classifier") -> str:
        return f"{self.home}/models/{name}"

    def panel(self, name: str = "reference") -> str:
        return f"{self.home}/panels/{name}"
