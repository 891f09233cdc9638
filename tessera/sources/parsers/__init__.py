"""Parsers of source and metadata files: one file in, records of nodes, edges, references and warnings out."""

from __future__ import annotations

from tessera.sources.parsers import apex, markup, metadata
from tessera.sources.parsers.records import Records

PARSERS = apex.PARSERS | markup.PARSERS | metadata.PARSERS


def parse(kind: str, path: str, parent: str | None, files: list[tuple[str, str]]) -> Records:
    """Records of one logical file: ``files`` has (name, text) of its parts, the main one first. A file that can't be
    parsed gives a warning and nothing else."""
    out = Records(path)
    try:
        PARSERS[kind](out, path, parent, files)
    except Exception as e:  # a broken file must not end the scan of the others
        out = Records(path)
        out.warn(f"{kind}: {type(e).__name__}: {e}")
    return out
