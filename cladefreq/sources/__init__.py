"""Readers for the input tables and writers for the result tables."""

from cladefreq.sources.readers import (
    header_names,
    read_arrays,
    read_class_lookup,
    read_entities,
    read_evidence,
    read_feature_lookup,
    read_text_table,
)
from cladefreq.sources.writers import (
    fingerprint,
    publish,
    published,
    read_published,
    shared_folder,
    write_csv,
    write_lines,
    written,
)

__all__ = [
    "fingerprint",
    "header_names",
    "publish",
    "published",
    "read_arrays",
    "read_class_lookup",
    "read_entities",
    "read_evidence",
    "read_feature_lookup",
    "read_published",
    "read_text_table",
    "shared_folder",
    "write_csv",
    "write_lines",
    "written",
]
