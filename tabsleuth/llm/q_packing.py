"""Query of the packing operator."""

from __future__ import annotations

from . import packing
from .common import table


def query(spark, sf_dir):
    p = packing.pack_documents(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
