"""Small state beside a stream, as versions in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


class TokenStore:
    """Stored version tokens: the first table, and for each batch a new version under ``folder``."""

    def __init__(self, first: DataFrame, folder: str, parent: str = "playlist_id", token: str = "token"):
        self.first, self.folder, self.parent, self.token, self.at = first, folder, parent, token, None

    def read(self) -> DataFrame:
        spark = self.first.sparkSession
        return self.first if self.at is None else spark.read.schema(self.first.schema).parquet(f"{self.folder}/v={self.at}")

    def write(self, rows: DataFrame, number: int) -> None:
        """A version named by its batch, so that a batch delivered again writes the same one."""
        old = self.read().join(rows.select(self.parent), self.parent, "left_anti")
        old.select(self.parent, self.token).unionByName(rows.select(self.parent, self.token)).write.mode("overwrite").parquet(f"{self.folder}/v={number}")
        self.at = number
