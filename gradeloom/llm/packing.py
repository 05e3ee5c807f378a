"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each partition packs its own documents, in scan order, and never exchanges rows. A document's whole windows stand alone;
its remainder goes to the fill level for which the sum over levels of (number of partly filled windows)**2 gets least, as
tracked in a level array. Should more than `max_open` windows be open, the fullest is closed at a power of two, where a sequence
needs no padding, and what it held beyond is placed again. Only windows still open at a partition's end are cut anew into full
ones, with the last of them cut at powers of two.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# Fixed value: the public pre-tokenisation pattern of the byte-level vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes and ids of a byte-level vocabulary file, whose merges must be in the order of the ids they make; and its added tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], {t["content"]: t["id"] for t in file.get("added_tokens", ())}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError("the vocabulary's ids don't follow its merges")
    ranks = {bytes(shown[c] for c in token): i for token, i in vocabulary.items() if token not in added and (len(token) == 1 or made[0] <= i <= made[-1])}
    return ranks, added


class TextTokenizer:
    """Token ids of whole texts: those that the vocabulary file gives in its own library, where a text that holds an added token
    has that token's id.

    The merges run in a byte-pair engine several times as fast as that library's, from the same file; tests compare the two.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks, added = byte_ranks(path)
        self._engine = tiktoken.Encoding("vocabulary", pat_str=PIECE, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return self._engine.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_tokenizers: dict[str, TextTokenizer] = {}


def text_tokenizer(path: str) -> TextTokenizer:
    """One tokenizer for each path and worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = TextTokenizer(path)
    return _tokenizers[path]


class LevelPacker:
    """Windows of one partition. `put` and `flush` return finished pieces: (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, size: int, first_sequence: int, max_open: int = 2048):
        self.size, self.next, self.max_open = size, first_sequence, max_open
        self.count = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]
        self.open = 0

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _finish(self, pieces: list) -> list:
        sequence, at, out = self._sequence(), 0, []
        for doc, start, ids, total in pieces:
            out.append((doc, start, ids, total, sequence, at))
            at += len(ids) // 4
        return out

    def level_for(self, length: int) -> int:
        """The fill level to place `length` on; 0 opens a window. Ties go to the fullest."""
        size, n = self.size, self.count
        best, gain = 0, 2 * n[length] + 1
        levels = np.flatnonzero(n[1 : size - length + 1]) + 1
        if len(levels):
            change = 1 - 2 * n[levels] + np.where(levels + length < size, 2 * n[levels + length] + 1, 0)
            i = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= gain:
                best = int(levels[i])
        return best

    def put(self, doc, ids: bytes) -> list:
        total, step, out = len(ids) // 4, self.size * 4, []
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            out += self._finish([(doc, at // 4, ids[at : at + step], total)])
        if whole < len(ids):
            out += self._place((doc, whole // 4, ids[whole:], total))
        while self.open > self.max_open:
            out += self._close_fullest()
        return out

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _place(self, piece: tuple) -> list:
        length = len(piece[2]) // 4
        level = self.level_for(length)
        window = self._take(level) if level else []
        window.append(piece)
        if level + length == self.size:
            return self._finish(window)
        self._keep(level + length, window)
        return []

    def _close_fullest(self) -> list:
        """Close the fullest window at the greatest power of two within it and place what lies beyond again."""
        level = int(np.flatnonzero(self.count)[-1])
        room, kept, beyond = 1 << (level.bit_length() - 1), [], []
        for doc, start, ids, total in self._take(level):
            cut = ids[: room * 4]
            room -= len(cut) // 4
            kept += [(doc, start, cut, total)] if cut else []
            beyond += [(doc, start + len(cut) // 4, ids[len(cut) :], total)] if len(ids) > len(cut) else []
        out = self._finish(kept)
        for piece in beyond:
            out += self._place(piece)
        return out

    def _keep(self, level: int, window: list) -> None:
        self.windows[level].append(window)
        self.count[level] += 1
        self.open += 1

    def flush(self) -> list:
        """At the end: cut what the open windows hold into full ones, the last at powers of two."""
        held = [p for level in self.windows for window in level for p in window]
        self.windows = [[] for _ in range(self.size)]
        self.count[:] = 0
        self.open = 0
        total = sum(len(p[2]) // 4 for p in held)
        rest = total % self.size
        rooms = iter([self.size] * (total // self.size) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1])
        out, window = [], []
        room = next(rooms, 0)
        for doc, start, ids, length in held:
            while ids:
                cut = ids[: room * 4]
                window.append((doc, start, cut, length))
                start, ids, room = start + len(cut) // 4, ids[len(cut) :], room - len(cut) // 4
                if not room:
                    out += self._finish(window)
                    window, room = [], next(rooms, 0)
        return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", max_open: int = 2048) -> DataFrame:
    """One row per piece: id_col, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a vocabulary file, the same on every machine. Each id of each document, `end_id` after its
    text, lies in exactly one piece; `size` must be a power of two. A null or empty text gives its end id alone, or no row
    without an end id. A null id stays null; repeated rows are packed each. Texts of any length are encoded whole. Extra columns
    are not read, whatever their names. An empty table gives an empty one. A window is padded unless it is full or its length is a power of two, so no padding arises.
    """
    small_batches(docs.sparkSession)
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def table(pieces: list) -> pa.RecordBatch:
        doc, start, ids, total, sequence, at = zip(*pieces, strict=True)
        columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, sequence, at))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])

    def work(batches):
        encode = text_tokenizer(tokenizer)
        packer = LevelPacker(size, TaskContext.get().partitionId() << 36, max_open)
        done, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = packer.put(doc, encode(text or "") + end)
                done += new
                held += sum(len(x[2]) for x in new)
                if held > 4 << 20:
                    yield table(done)
                    done, held = [], 0
        done += packer.flush()
        if done:
            yield table(done)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, PIECES).withColumnRenamed("doc_id", id_col)
