"""Import every query module so that each registers its queries."""

from . import q_actions, q_candidates, q_corpus, q_eval, q_evidence, q_io, q_parse, q_programs, q_retrieval  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
