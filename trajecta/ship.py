"""Hand the package to the executors, so that Python workers can import it anywhere."""

from __future__ import annotations

import os
import tempfile
import zipfile

_done: set[str] = set()


def ship(spark) -> None:
    """Once for each application: zip the package and add it to the Python path of all workers."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "trajecta_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
