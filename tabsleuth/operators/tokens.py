"""Token counts by a real tokenizer (SC17) and guards on them.

A byte-level tokenizer cuts a text into pieces before it merges bytes, and merges never
cross pieces: a text's tokens are the sum of its pieces' tokens.  So the texts are cut by Spark,
each distinct piece is tokenised once into a dictionary of lengths, and counts are a join of pieces
with the dictionary and a sum.  Texts are keyed by 128 bits of themselves, so equal texts are
counted once; no text is shuffled before its pieces are counted in its own task.

The tokenizer is a file of the ``tokenizers`` library with the byte-level pattern ``PIECES``; its path is an
argument.  Null and empty texts have no tokens.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the public byte-level pattern that cuts a text before its merges.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _key(text_col: str):
    return F.xxhash64(text_col).alias("_h1"), F.xxhash64(F.lit("t"), F.col(text_col)).alias("_h2")


def _counted(df: DataFrame, text_col: str) -> DataFrame:
    """_h1, _h2, piece, n: the pieces of each distinct text."""
    texts = df.where(F.col(text_col).isNotNull()).select(*_key(text_col), F.regexp_extract_all(F.col(text_col), F.lit(PIECES), F.lit(0)).alias("_p"))
    # equal texts add up, as do their number of rows: the quotient is the count of one
    rows = texts.select("_h1", "_h2", F.explode(F.concat("_p", F.array(F.lit("")))).alias("piece"))
    return rows.groupBy("_h1", "_h2", "piece").agg(F.count(F.lit(1)).alias("n"))


def dictionary(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """piece, n_tokens of the distinct pieces."""
    loaded = {}

    @F.pandas_udf("int")
    def length(words: pd.Series) -> pd.Series:
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in loaded:
            loaded[tokenizer] = Tokenizer.from_file(tokenizer)
            loaded[tokenizer].encode_special_tokens = True          # their strings in a text are ordinary text
        return pd.Series([len(e.ids) for e in loaded[tokenizer].encode_batch_fast(words.tolist(), add_special_tokens=False)], dtype="int32")
    return pieces.select("piece").distinct().select("piece", length("piece").alias("n_tokens"))


def with_tokens(df: DataFrame, text_col: str, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text column."""
    from ..sources.store import materialize
    counted = materialize(_counted(df, text_col), "token-pieces")
    lengths = dictionary(counted.where("piece <> ''"), tokenizer)
    found = (counted.join(lengths, "piece", "left").groupBy("_h1", "_h2")
             .agg(F.sum(F.col("n") * F.col("n_tokens")).alias("_sum"), F.max(F.when(F.col("piece") == "", F.col("n"))).alias("_rows")))
    found = found.select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), F.call_function("div", F.coalesce("_sum", F.lit(0)), F.col("_rows")).alias("_tokens"))
    h1, h2 = _key(text_col)
    keyed = df.withColumn("_h1", h1).withColumn("_h2", h2)
    return (keyed.join(found, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left")
            .select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("_tokens", F.lit(0)).cast("long").alias(out)))


def guarded(df: DataFrame, text_col: str, limit: int, message: str, tokenizer: str, out: str = "n_tokens") -> DataFrame:
    """texts (prompts, observations, transcripts of a round) of more than ``limit`` tokens become ``message``."""
    counted = with_tokens(df, text_col, tokenizer, out)
    return counted.withColumn(text_col, F.when(F.col(out) > limit, F.lit(message)).otherwise(F.col(text_col)))
