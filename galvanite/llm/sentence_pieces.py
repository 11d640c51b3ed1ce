"""SentencePiece encoding and decoding with forward scores shared by prefix.

Distinct marked words (a word and the marks before it) are sorted, which lists
their trie depth first. One Viterbi pass runs down each path: a prefix keeps
its forward score, the best sum of piece scores that reaches it, and the last
piece of that best path, and words with a common prefix share both. In a model
of merges a piece may follow another only if the two stay as they are side by
side; steps between other pieces score minus infinity, which makes the best
path the model's own encoding.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galvanite.llm.common import lists

MARK = "▁"
_UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Pieces:
    """A model's pieces. Characters that are no piece become byte pieces."""

    def __init__(self, path: str, most: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.ids, self.score, self.text, byte = {}, {}, [b""] * size, {}
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.score[piece] = i, m.get_score(i)
                self.text[i] = piece.encode()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this model spans words")
        self.byte = byte
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.most = most
        self.stable: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[bytes, float]] = {}

    def merged(self, unit: str) -> list[str]:
        """Best merge first, leftmost among equals: the model's definition."""
        part = list(unit)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                both = part[i] + part[after[i]]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not part[i] or after[i] >= len(part) or part[i] + part[after[i]] != both:
                continue
            j = after[i]
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def pair(self, a: str, b: str) -> bool:
        """Whether a and b (a may be empty) stay as they are side by side."""
        found = self.stable.get((a, b))
        if found is None:
            found = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.stable) < 4 * self.most:
                self.stable[a, b] = found
        return found

    def units(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK) if text else ""
        if MARK + MARK in marked or "\0" in marked:
            return _UNIT.findall(marked)
        return [u for u in marked.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0") if u]

    def walk(self, units: list[str]) -> Iterator[tuple[str, list[str], float]]:
        """Sorted distinct units with their pieces and scores, by one pass
        down the trie. ``last`` and ``forward`` hold, for each prefix of the
        unit at hand, the length of the best path's last piece and its score;
        what a unit shares with the one before it stays."""
        last, forward = [0], [0.0]
        held, tails, ids, stable, score = "", self.tails, self.ids, self.stable.get, self.score.get
        for unit in units:
            shared, most = 0, min(len(unit), len(held))
            while shared < most and unit[shared] == held[shared]:
                shared += 1
            del last[shared + 1 :], forward[shared + 1 :]
            held = unit
            for end in range(shared + 1, len(unit) + 1):
                fits, size = [1], 2
                while size <= end and (tail := unit[end - size : end]) in tails:
                    if tail in ids:
                        fits.append(size)
                    size += 1
                best, step = -inf, 1
                for size in reversed(fits):
                    at = end - size
                    a, b = unit[at - last[at] : at], unit[at:end]
                    found = stable((a, b))
                    if self.pair(a, b) if found is None else found:
                        best, step = forward[at] + score(b, 0.0), size
                        break  # all other steps score minus infinity: a prefix has one encoding, so one last piece
                last.append(step)
                forward.append(best)
            out, end = [], len(unit)
            while end:
                out.append(unit[end - last[end] : end])
                end -= last[end]
            yield unit, out[::-1], forward[-1]

    def numbers(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.byte.get(b, 0) for b in p.encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[float]]:
        """Ids and score of each text."""
        found = [self.units(t) for t in texts]
        known = self.known
        new = {unit: (self.numbers(pieces), score) for unit, pieces, score in self.walk(sorted({u for x in found for u in x} - known.keys()))}
        for unit in itertools.islice(new, max(0, self.most - len(known))):
            known[unit] = new[unit]
        both = [[known[u] if u in known else new[u] for u in x] for x in found]
        return [np.frombuffer(b"".join([ids for ids, _ in x]), np.int32) for x in both], [sum(score for _, score in x) for x in both]

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        raw = b"".join([text[i] for i in ids.tolist()])
        out = raw.decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if out.startswith(" ") else out


@cache
def pieces(path: str) -> Pieces:
    """One for each Python worker, kept between its tasks."""
    return Pieces(path)


def _encoded(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 400):
                part = batch.slice(low, 400)
                texts = part["text"].to_pylist()
                ids, scores = model.encode([t or "" for t in texts])
                back = [model.decode(x) for x in ids]
                counts = np.array([len(x) for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts, pa.int64()), lists(np.concatenate(ids), counts, pa.int32()), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)]), pa.array(scores, pa.float64())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip", "score"],
                )

    return encode


def encode_documents(docs: DataFrame, model: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip, score for each row.

    ids are those of the model's own encoder for the whole text; decoding
    them gives the text back (round_trip), unless the text itself holds the
    space mark. score is the sum of the pieces' scores in the model (a
    character that is no piece counts 0, as its bytes do). Repeated rows are
    encoded each on its own. A null or empty text has no ids. Every row is encoded on its
    own, nothing is shuffled, and a worker keeps a bounded store of words.
    Texts may be of any length; an empty table gives an empty result; other
    columns are not read. ``model`` is a path that every executor has."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoded(model), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean, score double")
