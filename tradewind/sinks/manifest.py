"""Which files were landed or taken up: a committed table of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradewind.operators.joins import new_rows
from tradewind.sinks.ledger import Ledger
from tradewind.sources import storage


def land_if_absent(files: DataFrame, root: str, token: str | None = None, manifest: str = "landed") -> int:
    """Add the files that the manifest does not list yet; returns their number.

    The manifest is a table below the root with the columns of `files`, `name` among them. A batch whose token was
    landed adds nothing, and of two batches at the same time the second one looks again.
    """
    spark = files.sparkSession
    storage.make_dirs(spark, f"{root}/{manifest}")

    def absent(listed: DataFrame) -> DataFrame:
        return new_rows(files.dropDuplicates(["name"]), listed, ["name"], unique=True)

    return Ledger(spark, root, manifest, schema=files.schema).add(absent, token=token)
