"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece of text (a match of the vocabulary's pattern) is mapped byte by byte to
Latin-1, so that an Aho-Corasick automaton over the vocabulary finds every token
in it in one pass. From the left, the longest token at the position is tried; it
stays if it may stand beside the token before it, that is, if merging by rank
would leave just these two; otherwise a shorter prefix of it is tried, and where
none is left the position is marked dead and the token before it shortened. Each
position dies at most once, so time is linear in the piece, and the result is
that of the merges. Whether two tokens may be adjacent is memoised, as are
whole pieces of up to ``PIECE_BYTES`` bytes.

Executors build the tables once per Python worker from the rank file. Every row
is encoded alone, so a lost executor costs only its own tasks.

Defined results: a null text is the empty text, of no ids. Null ids, repeated
rows and extra columns pass through. An empty table gives an empty table.
"""

from __future__ import annotations

import array
import base64
import hashlib
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sidelight.llm.columns import read
from sidelight.llm.memory import sliced

MEMO = 200_000  # entries of each memo, which is emptied when full
LONG_TEXT = 1 << 17
PIECE_BYTES = 64
_BITS = 24  # of a token id; two of them are one number, which is a smaller key than a pair


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BacktrackingBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO) -> None:
        import ahocorasick
        import regex

        self.token_bytes = {i: t for t, i in ranks.items()}
        self._pattern, self._most = regex.compile(pattern), memo
        self._auto = ahocorasick.Automaton()
        for t, i in ranks.items():
            self._auto.add_word(t.decode("latin-1"), i)
        self._auto.make_automaton()
        self._size = {i: len(t) for t, i in ranks.items()}
        self._adjacent: dict[int, bool] = {}
        self._left: dict[int, int] = {}
        self._right: dict[int, int] = {}
        self._pair: dict[int, int] = {}
        self._shorter: dict[int, int] = {}
        self._learn_merges(ranks)
        self._memo: dict[str, bytes] = {}

    def _learn_merges(self, ranks: dict[bytes, int]) -> None:
        """By rank, the pair that each token is merged from, and the longest proper prefix that is a token."""
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._left[i] = self._right[i] = i
            cuts = [n for n in range(len(t) - 1, 0, -1) if t[:n] in ranks]
            if cuts:
                self._shorter[i] = ranks[t[: cuts[0]]]
            for n in cuts:
                a, b = ranks[t[:n]], ranks.get(t[n:])
                if b is not None and a < i and b < i and self._may_touch(a, b):
                    self._left[i], self._right[i] = a, b
                    self._pair[a << _BITS | b] = i
                    break
        self._adjacent.clear()

    def _may_touch(self, left: int, right: int) -> bool:
        """Takes the two tokens apart, later merge first; they may touch if no earlier
        merge would have joined the parts that face each other."""
        key = left << _BITS | right
        known = self._adjacent.get(key)
        if known is not None:
            return known
        bound, answer = sys.maxsize, None
        while answer is None:
            joined = self._pair.get(left << _BITS | right)
            if joined is not None and joined < bound:
                answer = False
                break
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self._right[left] != left:
                    bound, left = left, self._right[left]
                    break
                if side == "right" and self._left[right] != right:
                    # a merge of the same rank further left comes first
                    bound, right = right + 1, self._left[right]
                    break
            else:
                answer = True
        if len(self._adjacent) >= self._most:
            self._adjacent.clear()
        self._adjacent[key] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        size_of, shorter = self._size, self._shorter
        longest = [-1] * n
        for end, token in self._auto.iter(piece.decode("latin-1")):
            longest[end - size_of[token] + 1] = token  # ends come in order, so the last at a start is the longest
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + size_of[token]
            if alive[end] and (not out or self._may_touch(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif token in shorter:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= size_of[token]
        return out

    def _piece_ids(self, piece: str) -> bytes:
        found = self._memo.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            found = array.array("I", self.encode_piece(raw)).tobytes()
            if len(raw) <= PIECE_BYTES:
                if len(self._memo) >= self._most:
                    self._memo.clear()
                self._memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers in the machine's order (little-endian, asserted below)."""
        if len(text) < LONG_TEXT:
            return b"".join(map(self._piece_ids, self._pattern.findall(text)))
        return b"".join(self._piece_ids(m[0]) for m in self._pattern.finditer(text))  # without a list of all pieces

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I")))


assert sys.byteorder == "little" and array.array("I").itemsize == 4


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str, memo: int) -> BacktrackingBPE:
    return BacktrackingBPE(load_ranks(path), pattern, memo)


def with_tokens(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, ids: bool = False, memo: int = MEMO) -> DataFrame:
    """The columns in ``keep`` (all, if None) with ``n_tokens``, ``ids_sha256``, ``decoded_sha256``
    and, if asked for, ``ids`` (binary, little-endian unsigned 32-bit). Such columns of ``df`` are replaced.
    ``memo`` trades memory of a Python worker for time; results do not depend on it."""
    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "binary"} if ids else {})
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = df.select(*keep).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    text_at = len(keep)

    def encode(batches):
        bpe = _loaded(path, pattern, memo)
        for batch in sliced(batches, text_at):
            rows = []
            for text in batch.column(text_at):
                coded = bpe.encode(text.as_py() or "")
                rows.append((len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(bpe.decode(coded)).hexdigest(), coded))
            cols = list(zip(*rows)) or [()] * 4
            kinds = pa.int64(), pa.string(), pa.string(), pa.binary()
            new = [pa.array(c, k) for c, k in zip(cols, kinds)][: len(added)]
            yield pa.RecordBatch.from_arrays(batch.columns[:text_at] + new, names=keep + list(added))

    return df.select(*keep, df[text_col].alias("_bpe_text")).mapInArrow(encode, schema)


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    return with_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
