"""Query of the language identification."""

from __future__ import annotations

from . import langid
from .common import held_out, table


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs.where(~held_out())))
