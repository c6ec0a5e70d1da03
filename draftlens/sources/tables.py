"""The domain tables: stored Parquet when present, else derived from raw tables.

``Tables`` hands out DataFrames; nothing is read until a job runs, and Parquet
column pruning applies to each use on its own.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlens.operators.joins import dealt
from draftlens.session import tune
from draftlens.sources import files
from draftlens.sources.derive import DERIVED, derive_sql
from draftlens.sources.stored import SCHEMAS, reconcile


class Tables:
    """Lazily opened raw and domain tables of one data folder."""

    RAW = ("documents", "benchmark", "labels", "pages", "conversations", "events")

    def __init__(self, spark: SparkSession, path: str, spread: int | None = None):
        """``spread`` deals texts to so many tasks before columns that are bound by CPU.

        Off by default, since it moves the texts once; worth it for files of few row
        groups, which no scan can split. Taken from the session setting
        ``draftlens.spread`` where it is not given.
        """
        self.spark = tune(spark)
        self.parts = spread or int(spark.conf.get("draftlens.spread", "0"))
        self.path = path.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._raw[name]

    def spread(self, texts: DataFrame) -> DataFrame:
        return texts.repartition(self.parts) if self.parts else texts

    def _stored(self, name: str) -> DataFrame | None:
        path = f"{self.path}/{name}.parquet"
        if name in SCHEMAS and files.exists(self.spark, path):
            return reconcile(self.spark.read.parquet(files.literal(path)), name)

    def _derived(self, name: str, **given: DataFrame) -> DataFrame:
        """The stored table if the folder has one (logs are always derived), else the derived one.

        ``given`` stands in for raw tables: the same rows, laid out otherwise.
        """
        stored = self._stored(name)
        if stored is not None:
            return stored
        text, raw_names = derive_sql(name)
        return self.spark.sql(text, **{raw: given.get(raw, self.raw(raw)) for raw in raw_names})

    @cached_property
    def model(self) -> DataFrame:
        return self._derived("model")

    @cached_property
    def story(self) -> DataFrame:
        return self._derived("story")

    @cached_property
    def assignment(self) -> DataFrame:
        return self._derived("assignment")

    @cached_property
    def suggestion(self) -> DataFrame:
        return self._derived("suggestion")

    @cached_property
    def suggestion_by_id(self) -> DataFrame:
        """The suggestions, dealt to tasks by id.

        Texts move once and alone, before labels join them and before the published
        text is made; dealing suggestions moves both texts, and their join may have
        moved the first before.
        """
        size = lambda text: 2 * F.coalesce(F.octet_length(text), F.lit(0))
        stored = self._stored("suggestion")
        if stored is not None:
            return dealt(stored, size("generated"), "id")
        return self._derived("suggestion", documents=dealt(self.raw("documents"), size("text"), "doc_id"))

    @cached_property
    def feedback(self) -> DataFrame:
        return self._derived("feedback")

    @cached_property
    def upload_log(self) -> DataFrame:
        return self._derived("upload_log")

    @cached_property
    def request_log(self) -> DataFrame:
        return self._derived("request_log")

    @cached_property
    def status_log(self) -> DataFrame:
        return self._derived("status_log")

    @cached_property
    def finalize_log(self) -> DataFrame:
        return self._derived("finalize_log")

    @cached_property
    def feedback_log(self) -> DataFrame:
        return self._derived("feedback_log")

    @cached_property
    def preprocess_log(self) -> DataFrame:
        return self._derived("preprocess_log")


__all__ = ["Tables", "DERIVED"]
