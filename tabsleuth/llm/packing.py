"""Best-fit packing of tokenised documents with certified bin counts.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt by
hash into groups of bounded size, and every group is packed by best-fit
decreasing.  Dual-feasible functions give a lower bound of the group's bin
count: where the bound is reached, the group is certified and its sequences
are final.  From the other groups the full sequences are final as well; the
documents of the rest are exchanged between those groups (dealt anew with
another seed) and packed again, as long as that saves sequences.

Defined cases: a null text is empty and gives one piece, the end id; repeated
rows are packed one by one; an empty table gives no rows; other columns are
ignored.  Text is never shuffled: the tokeniser's output leaves a task as one
narrow row per piece.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
END_ID = 0
#: Pieces per group: thousands mix well enough that a group ends within a sequence of its bound.
GROUP_ROWS = 2000
#: Exchanges stop here at the latest; what is packed by then stands.
MAX_ROUNDS = 6
CACHE_WORDS = 800_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class WordIds:
    """Token ids of a text as little-endian uint32 bytes.

    The byte-level pre-tokeniser always cuts before a single space between
    two other characters, so the text can be cut there too and each part's
    ids be looked up.  Only parts that are not yet known are tokenised, many
    at a time: in a row of parts that each begin with their only space, a
    token that begins with a space begins a part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        #: Texts with one of these hold ids that no other text gives; they are encoded whole.
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.after: dict[str, bytes] = {}       # parts that follow a space, without it
        self.first: dict[str, bytes] = {}       # parts that begin a text
        vocab = self.tok.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True    # the space's byte symbol

    @staticmethod
    def parts(text: str) -> list[str]:
        plain = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text))
        return text.split(" ") if plain else _CUT.split(text)

    def _one(self, part: str) -> bytes:
        return np.asarray(self.tok.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        odd = [w for w in new if " " in w]
        for w in odd:
            self.after[w] = self._one(" " + w)
        some = [w for w in new if " " not in w] if odd else new
        rows = [some[i:i + 500] for i in range(0, len(some), 500)]
        for row, e in zip(rows, self.tok.encode_batch_fast(["".join([" " + w for w in row]) for row in rows], add_special_tokens=False)):
            ids = np.asarray(e.ids, dtype="<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(row) or at[0]:
                self.after.update((w, self._one(" " + w)) for w in row)
                continue
            raw, at = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
            for i, w in enumerate(row):
                self.after[w] = raw[at[i]:at[i + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i: np.asarray(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
                 for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        cut = [self.parts(t) if t and i not in whole else [] for i, t in enumerate(texts)]
        if len(self.after) > CACHE_WORDS:
            self.after = {}
        if len(self.first) > CACHE_WORDS:
            self.first = {}
        after, first, seen = self.after, self.first, set()
        self.tok.encode_special_tokens = True       # a part is plain text, whatever it looks like
        try:
            for p in cut:
                seen.update(p[1:])
                if p and p[0] not in first:
                    first[p[0]] = self._one(p[0])
            new = [w for w in seen if w not in after]
            if new:
                self._learn(new)
        finally:
            self.tok.encode_special_tokens = False
        known = after.__getitem__
        return [first[p[0]] + b"".join(map(known, p[1:])) if p else whole.get(i, b"") for i, p in enumerate(cut)]


_ENCODERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut
    into pieces of ``capacity`` only where they are more; the first piece is the shorter one."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _ENCODERS:
            _ENCODERS[path] = WordIds(path)
        enc = _ENCODERS[path]
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for b in batches:
            texts, ids = b["text"].fillna("").tolist(), b["doc_id"].tolist()
            for at in range(0, len(texts), 500):
                rows = []
                for doc, raw in zip(ids[at:at + 500], enc.encode(texts[at:at + 500])):
                    raw += end
                    n, pos, k = len(raw) // 4, 0, 0
                    size = n % capacity or capacity
                    while pos < n:
                        rows.append((doc, k, pos, size, zlib.crc32(raw[4 * pos:4 * (pos + size)])))
                        pos, k, size = pos + size, k + 1, capacity
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECE)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[x]`` pieces have length x (0..capacity).

    The larger of the bounds of two families of dual-feasible functions: one
    rounds lengths above capacity - t up and drops those below t, the other
    rounds (k + 1) * x / capacity down."""
    x = np.arange(capacity + 1)
    total = int((counts * x).sum())
    best = -(-total // capacity)
    below = np.concatenate([[0], np.cumsum(counts * x)])          # below[t]: sum of lengths < t
    many = np.concatenate([[0], np.cumsum(counts)])
    for t in range(1, capacity // 2 + 1):
        large = int(many[-1] - many[capacity - t + 1])
        middle = int(below[capacity - t + 1] - below[t])
        best = max(best, -(-(large * capacity + middle) // capacity))
    for k in range(1, 101):
        whole = ((k + 1) * x) % capacity == 0
        # Scaled by k * capacity: x * k where (k + 1) x / capacity is whole, else floor(...) * capacity.
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int):
    """Bin and offset of each length, and the room left in each bin; lengths fall.

    Bins are kept by the room left; a bit set of the rooms that occur finds
    the tightest one that holds a piece."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, free = 0, []
    for i, n in enumerate(lengths.tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        free[b] = left
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.asarray(free, np.int64)


def _pack_group(round_no: int, capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        group = int(pdf["g"].iloc[0])
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (round_no << 56) + (group << 20) + bins
        out["offset"] = offsets
        out["final"] = (free[bins] == 0) | (len(free) == bound)
        return out
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Pieces -> + sequence_id (unique, not gapless) and offset in the sequence."""
    done: list[DataFrame] = []
    todo, n, bins_before, kept = materialize(items, "pack-pieces"), None, None, None
    for r in range(max_rounds):
        n = todo.count() if n is None else n
        if not n:
            break
        groups = -(-n // group_rows)
        dealt = todo.withColumn("g", F.pmod(F.xxhash64(F.lit(r), "doc_id", "piece", "ids_crc32", "length"), F.lit(groups)))
        packed = dealt.groupBy("g").applyInPandas(_pack_group(r, capacity), PIECE + ", sequence_id long, offset long, final boolean")
        packed = materialize(packed, f"pack-{r}")
        found = packed.agg(F.count_if(~F.col("final")).alias("n"), F.count_if(F.col("offset") == 0).alias("bins"),
                           F.count_if(~F.col("final") & (F.col("offset") == 0)).alias("open")).first()
        if kept is not None and found["bins"] >= bins_before:
            done.append(kept)          # the exchange saved nothing: the former sequences stand
            n = 0
            break
        done.append(packed.where("final"))
        kept, n, bins_before = packed.where("not final"), found["n"], found["open"]
        todo = kept.drop("sequence_id", "offset", "final")
    if n and kept is not None:
        done.append(kept)
    if not done:
        return todo.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("final")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity)
