"""Packing token sequences by best-fit decreasing."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galvanite.llm.common import keyed, lists

#: Fixed value: the pre-split of byte-level BPE files of this kind.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_ranks(file: dict) -> bool:
    """Whether a tokenizer file is one that the faster encoder repeats: a
    byte-level BPE with the usual split, no normaliser, and merges in the
    order of the ids that they make."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") not in (None, "BPE") or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in file["added_tokens"]):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return made == sorted(made) and made[0] == 256 if made else False


@cache
def encoder(path: str) -> tiktoken.Encoding | None:
    """The byte-level BPE of a tokenizer file, one for each Python worker.

    In a file that ``plain_ranks`` accepts a token's id is its rank, so its
    vocabulary serves as ranks for the faster encoder; the ids are those of
    the file's own tokenizer, which gives a special token's string in a text
    that token's id (tests compare them). None for any other file."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    if not plain_ranks(file):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {token["content"]: token["id"] for token in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def own_tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def token_ids(path: str, text: str) -> list[int]:
    """The ids of the file's own tokenizer. The faster encoder gives up on
    very long runs of white space (about a million characters); such a text,
    and every text under a file of another kind, goes to the tokenizer."""
    fast = encoder(path)
    if fast is not None:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            pass
    return own_tokenizer(path).encode(text, add_special_tokens=False).ids


def _sizes(path: str, window: int, end: int):
    """Per document: its number of tokens and the CRC of each piece."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                totals, crcs, counts = [], [], []
                for text in part["text"].to_pylist():
                    raw = np.array([*token_ids(path, text or ""), end], dtype="<u4").tobytes()
                    own = [zlib.crc32(raw[i : i + 4 * window]) for i in range(0, len(raw), 4 * window)]
                    totals.append(len(raw) // 4)
                    counts.append(len(own))
                    crcs += own
                yield pa.RecordBatch.from_arrays([part["_row"], part["doc_id"], pa.array(totals, pa.int64()), lists(np.array(crcs, dtype=np.int64), np.array(counts), pa.int64())], names=["_row", "doc_id", "doc_tokens", "crcs"])

    return size


def padding(used: np.ndarray, window: int) -> np.ndarray:
    """Padding of sequences of these lengths: up to ``window``, none at a
    power of two."""
    return np.where(used & (used - 1), window - used, 0)


class Tightest:
    """A segment tree over remaining capacities 1 to ``window``: which open
    sequence has the least room that still fits."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.open[room].append(sequence)
            self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = self.base + room
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the smallest room of at least ``need``."""
        i, count = self.base + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.base
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, in best-fit decreasing order of
    length (ties: the order given), and the number of sequences."""
    tree, made = Tightest(window), 0
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room, s = tree.take(n) or (window, made)
        made += s == made
        sequence[i], offset[i] = s, window - room
        tree.put(room - n, s)
    return sequence, offset, made


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", window: int = 1024, end: int = 0, group: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and then ``end``. Full windows are cut
    off first and fill a sequence each; what is left goes to the open
    sequence with the least room that fits. A sequence is padded to
    ``window``, unless its length is a power of two, so one such needs none;
    no document is cut a second time to save the little padding that is left
    (see ``padding``). Documents are dealt by row key to
    groups of about ``group``, each packed by one task, so no task sees more
    than a group, whatever the table's size; a group leaves one sequence or
    so part-filled. A null or empty text has the one token ``end``. Equal
    ids and repeated rows are packed each on its own; an empty table gives
    an empty result. ``tokenizer`` is a path that every executor has."""
    groups = max(1, -(-docs.count() // group))
    source = keyed(docs, doc_id=F.col(key).cast("long"), text=F.col(text))
    sizes = source.mapInArrow(_sizes(tokenizer, window, end), "_row long, doc_id long, doc_tokens long, crcs array<long>")

    def pack(group_key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        total, base = table["doc_tokens"].to_numpy(), group_key[0].as_py() << 32
        left = total % window
        rest = np.flatnonzero(left)
        sequence, offset, made = best_fit(left[rest], window)
        pieces = -(-total // window)
        doc = np.repeat(np.arange(len(total)), pieces)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(window, total[doc] - part * window)
        full = length == window
        s, o = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
        s[full] = made + np.arange(full.sum())
        s[~full], o[~full] = sequence, offset
        crcs = table["crcs"].combine_chunks().flatten()
        return pa.table({"doc_id": table["doc_id"].take(pa.array(doc)), "start": part * window, "length": length, "ids_crc32": crcs, "doc_tokens": total[doc], "sequence_id": base + s, "offset": o})

    dealt = sizes.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(pack, _PIECES)
