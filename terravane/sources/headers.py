"""Format headers kept beside a store: one JSON document per format."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Header:
    """A format's name and its fields."""

    format: str
    fields: dict = field(default_factory=dict)

    @property
    def affine(self) -> list | None:
        return self.fields.get("affine")

    def to_dict(self) -> dict:
        return asdict(self)


#: Formats a header can be read for.
FORMATS = ("trk", "tck", "trx", "nifti", "swc", "las", "ply", "obj", "stl", "csv", "graph", "lines")


def header_from_dict(data: dict) -> Header:
    if data.get("format") not in FORMATS:
        raise ValueError(f"unknown header format {data.get('format')!r}")
    return Header(data["format"], dict(data.get("fields", {})))


class HeaderRegistry:
    """The headers of a store, by format."""

    def __init__(self, headers: dict[str, Header] | None = None):
        self._headers = dict(headers or {})

    @property
    def available_formats(self) -> list[str]:
        return sorted(self._headers)

    def has(self, name: str) -> bool:
        return name in self._headers

    def get(self, name: str) -> Header:
        if name not in self._headers:
            raise KeyError(name)
        return self._headers[name]

    def add(self, header: Header) -> None:
        self._headers[header.format] = header

    def remove(self, name: str) -> None:
        del self._headers[name]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(h.fields)) for k, h in sorted(self._headers.items())], "format string, json string")

    @classmethod
    def from_frame(cls, rows: DataFrame) -> HeaderRegistry:
        """Headers of a written table (one row per format)."""
        return cls({r["format"]: Header(r["format"], json.loads(r["json"])) for r in rows.collect()})
