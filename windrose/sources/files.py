"""The file systems that tasks reach without a JVM."""

from __future__ import annotations

#: Names that Hadoop has for stores, and Arrow's own.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gcs": "gs"}


def filesystem(uri: str):
    """Arrow's file system of a URI, as Spark or Arrow writes it, and the path within."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if not colon:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
