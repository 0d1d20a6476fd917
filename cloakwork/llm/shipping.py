"""This package's code for the workers, wherever the driver has it from."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import cloakwork
from cloakwork.plans.stored import work_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give every worker of this application the package, once. It lies in the shared folder and is fetched from there.

    Nothing happens if the package has no folder of its own, which means that it was shipped already.
    """
    context, root = spark.sparkContext, Path(cloakwork.__file__).parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    from cloakwork.llm.files import written

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    uri = f"{work_folder(spark)}/cloakwork.zip"
    with written(uri) as out:
        out.write(packed.getvalue())
    context.addPyFile(uri)
    _shipped.add(context.applicationId)
