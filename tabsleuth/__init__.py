"""tabsleuth: Spark-native table retrieval and table question answering.

Every table of a corpus is held as one long ``cells`` DataFrame; schema,
cell, row and column corpora are aggregations of it, and retrieval for all
questions x candidate tables x queries is one inverted-index join plus a
windowed top-k.  See README.md for the operator map.
"""

__version__ = "0.1.0"
