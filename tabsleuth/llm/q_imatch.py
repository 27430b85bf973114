"""Query of the document fingerprints."""

from __future__ import annotations

from . import imatch
from .common import table


def query(spark, sf_dir):
    return imatch.fingerprints(table(spark, sf_dir, "documents"))
