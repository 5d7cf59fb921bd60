"""Source registry (SRC-4, SRC-5, SRC-6, SRC-8).

A source is a ``SourceSpec``: metadata, the extensions it selects, and a ``reader``
``(spark, files DataFrame) -> DataFrame`` that returns a staged read (lines and manifest, see
``bz2_reader``); the two here also take an ``Observation`` for its counters.  ``build_patterns`` turns a selection DataFrame
``(bucket, path)`` into one glob pair per path and extension.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


@dataclass(frozen=True)
class SourceSpec:
    id: str
    name: str
    extensions: list[str]
    compression: str
    content_type: str
    enabled: bool = True
    description: str = ""
    reader: Callable[[SparkSession, DataFrame], DataFrame] | None = field(default=None, compare=False)

    def build_patterns(self, sel: DataFrame) -> DataFrame:
        """SCL-7 for every extension (SRC-8): ``p/*ext`` and ``p/**/*ext`` per path."""
        arrays = [C.pattern_pair(F.col("bucket"), F.col("path"), ext) for ext in self.extensions]
        globs = F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]
        return sel.select("bucket", "path", F.posexplode(globs).alias("glob_no", "pattern"))

    def metadata(self) -> dict:
        return {
            "id": self.id,
            "name": self.name,
            "extensions": list(self.extensions),
            "compression": self.compression,
            "contentType": self.content_type,
            "enabled": self.enabled,
            "description": self.description,
        }


def _read_bz2(spark: SparkSession, files: DataFrame, observation: Observation | None = None) -> DataFrame:
    from .bz2_reader import read_files

    return read_files(files, observation=observation)


def _read_json(spark: SparkSession, files: DataFrame, observation: Observation | None = None) -> DataFrame:
    """SRC-6: ``.json`` / ``.json.gz`` documents, the elements of their arrays as lines."""
    from .json_reader import read_json_arrays

    return read_json_arrays(files, observation=observation)


# fixed values: the two registered sources and their metadata
_SOURCES = {
    "betfair": SourceSpec(
        id="betfair",
        name="Betfair",
        extensions=[".bz2"],
        compression="bz2",
        content_type="ndjson",
        enabled=True,
        description="Historical market data: bz2 files of NDJSON lines",
        reader=_read_bz2,
    ),
    "racing_api": SourceSpec(
        id="racing_api",
        name="The Racing API",
        extensions=[".json", ".json.gz"],
        compression="gzip",
        content_type="json",
        enabled=False,
        description="Race data: JSON documents, plain or gzip; not open yet",
        reader=_read_json,
    ),
}


class UnknownSource(ValueError):
    pass


def get_source(source_id: str) -> SourceSpec:
    """SRC-4: by id; unknown ids are an error."""
    try:
        return _SOURCES[source_id]
    except KeyError:
        raise UnknownSource(f"no source {source_id!r}; known: {sorted(_SOURCES)}") from None


class DisabledSource(ValueError):
    pass


def open_source(source_id: str) -> SourceSpec:
    """SRC-5: a source that a job may read; a disabled one is an error."""
    spec = get_source(source_id)
    if not spec.enabled or spec.reader is None:
        raise DisabledSource(f"source {source_id!r} is not enabled")
    return spec


def register_source(spec: SourceSpec) -> None:
    """SRC-4: add a source, or replace the one with its id."""
    _SOURCES[spec.id] = spec


def list_sources(spark: SparkSession) -> DataFrame:
    """SRC-4: metadata of every source as a DataFrame."""
    rows = [
        (s.id, s.name, s.extensions, s.compression, s.content_type, s.enabled, s.description)
        for s in _SOURCES.values()
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, extensions array<string>, compression string, content_type string, "
        "enabled boolean, description string",
    )
