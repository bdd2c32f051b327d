"""The package on Python workers.

Functions that run on workers are pickled by reference, so workers must be able
to import this package, wherever the driver found it. It is shipped once a
session with Spark's own file distribution, which also serves executors that
join later.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

_SHIPPED: set[str] = set()


def on_workers(rows: DataFrame) -> DataFrame:
    """``rows``, once the workers of its session can import this package; to be called before Python functions are applied."""
    context = rows.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="gregaria-code-")  # of the driver only; Spark copies it from here
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}_code", "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)
    return rows
