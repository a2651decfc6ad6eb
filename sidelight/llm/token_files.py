"""Token ids on disk: Re-Pair grammar compression by shard, with random access.

Documents are dealt out by ranges of their id, encoded in that order, and packed
into shards of about ``SHARD_TOKENS`` ids. A shard is numbered when it is written:
its range, its place in the range, and the tokens of the range before it. So the
reader needs one sum for each range to know where every document starts. In a shard, frequent pairs of adjacent
ids are replaced by nonterminals, again and again: each round counts all pairs and
takes the most frequent ones at once (where two of them overlap, the more frequent
goes first). It ends when no pair is used often enough to pay for its rule, when a
round saves less than ``MIN_GAIN`` of the sequence, or when the nonterminals that a
symbol's width leaves room for are used up. A shard stores its
rules, the expansion length of every nonterminal, the documents' ids and
lengths, and the remaining sequence; by the expansion lengths any range of
tokens is decoded without expanding what lies before it.

The file format is a Parquet dataset with one binary row a shard (``Shard``
reads and writes its layout), so that Spark's commit protocol makes the files
appear whole or not at all, on any file system, whichever executors are lost.

Encoding goes through the tokenizers library. A text is cut before spaces that
precede no white space, where its pattern always starts a new match, and what
lies between two cuts is encoded once and remembered; texts that hold other runs
of white space after a space, or the spelling of one of the tokenizer's added
tokens, are encoded as they are. Ids are those of the library as the file sets it
up: the spelling of a special token in a text gives that token's id.

Defined results: a null text is empty and holds its end id alone. Null ids sort
first. Rows with equal ids lie side by side in the order of a hash of their text,
then of the text, so that one id's rows may fill many ranges; equal rows are stored
each. A text of any length is one document of one shard, which is then as long. An
empty table gives no shard. Extra columns, whatever their names, are not stored.
"""

from __future__ import annotations

import array
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sidelight.llm.columns import read
from sidelight.workspace import Workspace

SHARD_TOKENS = 1 << 21
END_ID = 0
SLICE_BYTES = 12 << 20
MEMO_CHUNKS = 500_000  # entries; when it is full, new chunks are encoded and not kept
ROUND_RULES = 4096  # pairs that are replaced at once
MIN_GAIN = 0.01  # of a sequence, that a round must save to be followed by another
RULE_BYTES = 12  # a pair and its expansion length
TABLE_LENGTH = 64  # of what a nonterminal spells, in the table that decoding gathers from
_SLOT_BITS = 18
SHARD_SCHEMA = "part int, number int, before long, first_doc long, n_docs long, n_tokens long, payload binary"
_HEAD = struct.Struct("<4sIIIIIII")  # magic, range, number in it, first nonterminal, rules, documents, tokens, length of the sequence


# --- grammar ---------------------------------------------------------------------------------


def _frequent_pairs(codes: np.ndarray, least: int, most: int) -> np.ndarray:
    """The codes of the ``most`` most frequent pairs that occur ``least`` times, by falling count."""
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(counts >= least)
    return ordered[starts[often[np.argsort(-counts[often], kind="stable")[:most]]]]


def _slots(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint32:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOT_BITS)
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)


def compress(ids: np.ndarray, first: int, max_rules: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, rules)``; rule k is the pair that nonterminal ``first + k`` stands for."""
    wide = first + max_rules > 1 << 16
    kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    seq, rules = ids.astype(np.uint32), []
    none, least, most = np.int32(1 << 30), RULE_BYTES // (4 if wide else 2) + 1, ROUND_RULES
    while len(seq) > 1 and (room := max_rules - len(rules)) > 0:
        codes = (seq[:-1].astype(kind, copy=False) << kind(shift)) | seq[1:]
        pairs = _frequent_pairs(codes, least, min(room, most))
        if not len(pairs):
            break
        # a small table finds a code's rank; of two pairs in one slot the less frequent waits for a later round
        rank_at = np.full(1 << _SLOT_BITS, -1, np.int32)
        rank_at[_slots(pairs[::-1])] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        place = rank_at[_slots(codes)]
        at = np.flatnonzero(place >= 0)
        place = place[at]
        sure = pairs[place] == codes[at]
        at, place = at[sure], place[sure]
        # of overlapping pairs the better rank goes first; in a run of one pair, the leftmost
        follows = at[1:] == at[:-1] + 1
        take = np.ones(len(at), bool)
        take[1:] = place[1:] < np.where(follows, place[:-1], none)
        take[:-1] &= place[:-1] <= np.where(follows, place[1:], none)
        at, place = at[take], place[take]
        worth = np.bincount(place, minlength=len(pairs)) >= least
        if len(at) < MIN_GAIN * len(seq):
            break
        if not worth.any():  # pairs that overlap themselves may stand before others that pay
            if len(pairs) < most or most >= room:
                break
            most *= 4
            continue
        number = (np.cumsum(worth) - 1 + len(rules) + first).astype(np.uint32)
        chosen = pairs[worth]
        rules.extend(zip((chosen >> kind(shift)).tolist(), (chosen & kind((1 << shift) - 1)).tolist()))
        good = worth[place]
        at, place = at[good], place[good]
        seq[at] = number[place]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
    return seq, np.array(rules, np.uint32).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.uint32)


def _split_once(seq: np.ndarray, long: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """``seq`` with the marked nonterminals as the pairs they stand for."""
    end = np.cumsum(1 + long, dtype=np.int64)
    out = np.empty(int(end[-1]), np.uint32)
    out[end - 1 - long] = seq
    pair = rules[seq[long] - first]
    out[end[long] - 2], out[end[long] - 1] = pair[:, 0], pair[:, 1]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Undoes ``compress``: long nonterminals are taken apart, short ones gathered from a table of what they spell."""
    if not (seq >= first).any():
        return seq
    size = np.ones(first + len(rules), np.int32)
    size[first:] = expansion_lengths(rules, first) if lengths is None else lengths
    while (long := size[seq] > TABLE_LENGTH).any():
        seq = _split_once(seq, long, rules, first)
    short = np.flatnonzero(size[first:] <= TABLE_LENGTH) + first
    begin = np.arange(first + len(rules), dtype=np.int32)
    begin[short] = first + np.cumsum(size[short], dtype=np.int32) - size[short]
    spelt = short.astype(np.uint32)
    while (inner := spelt >= first).any():
        spelt = _split_once(spelt, inner, rules, first)
    table = np.concatenate((np.arange(first, dtype=np.uint32), spelt))  # it begins with every terminal as itself
    length = size[seq]
    end = np.cumsum(length, dtype=np.int32)
    where = np.repeat(begin[seq] - end + length, length)
    where += np.arange(len(where), dtype=np.int32)
    return table[where]


class Shard:
    """One shard's bytes: header, rules, expansion lengths, document ids (and which are null), their lengths, sequence."""

    def __init__(self, payload: bytes) -> None:
        magic, self.part, self.number, self.first, n_rules, n_docs, self.n_tokens, n_seq = _HEAD.unpack_from(payload)
        if magic != b"RPR2":
            raise ValueError("not a token shard")
        at = _HEAD.size
        narrow = self.first + n_rules <= 1 << 16

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = part("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = part("<u4", n_rules)
        self.doc_ids, self.doc_null = part("<i8", n_docs), part("u1", n_docs)
        self.doc_tokens = part("<u4", n_docs)
        self.seq = part("<u2" if narrow else "<u4", n_seq).astype(np.uint32)

    @staticmethod
    def pack(doc_ids: list, parts: list[np.ndarray], first: int, part: int = 0, number: int = 0) -> bytes:
        ids = np.concatenate(parts)
        room = (1 << 16) - first if first < 1 << 16 else 1 << 16
        seq, rules = compress(ids, first, room)
        narrow = first + len(rules) <= 1 << 16
        return b"".join((
            _HEAD.pack(b"RPR2", part, number, first, len(rules), len(doc_ids), len(ids), len(seq)),
            rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(p) for p in parts], "<u4").tobytes(), seq.astype("<u2" if narrow else "<u4").tobytes(),
        ))

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens ``start`` to ``stop`` of the shard; expands the symbols that cover them alone."""
        stop = self.n_tokens if stop is None else min(stop, self.n_tokens)
        if start >= stop:
            return np.empty(0, np.uint32)
        size = np.ones(len(self.seq), np.int64)
        inner = self.seq >= self.first
        size[inner] = self.lengths[self.seq[inner] - self.first]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        before = int(ends[a] - size[a])
        return expand(self.seq[a : b + 1], self.rules, self.first, self.lengths)[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        ends = np.cumsum(self.doc_tokens, dtype=np.int64)
        return self.tokens(int(ends[k] - self.doc_tokens[k]), int(ends[k]))


# --- encoding --------------------------------------------------------------------------------


class ChunkedEncoder:
    """Ids of whole texts, by the tokenizers library and a memo of chunks.

    Texts of a slice are cut and their chunks numbered by Arrow; a chunk that is new
    goes through the library with many others in one string, whose ids fall back to
    their chunks by the bytes that each id stands for; then all ids are one gather.
    """

    # white space or the end after a space; more than the pattern's own white space does no harm
    _other_white = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core is one task's
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # the library looks for added tokens before anything else, whatever stands around them
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._odd = "|".join([self._other_white, *added])
        vocabulary = self._tokenizer.get_vocab()
        self.vocabulary = len(vocabulary)
        self._bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in vocabulary.items():
            self._bytes_of[i] = len(token)  # the vocabulary writes a byte as a character
        self._memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (a null one is empty), slice by slice of about ``SLICE_BYTES``."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._slice(texts.slice(at, stop - at))
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = pc.match_substring_regex(texts, self._odd).to_numpy(zero_copy_only=False)
        alone = iter(self._ids(texts.filter(pa.array(odd)).to_pylist()))
        even = self._cut(texts.filter(pa.array(~odd)))
        for o in odd.tolist():
            yield np.frombuffer(next(alone), np.uint32) if o else next(even)

    def _cut(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not len(texts):
            return
        cut = pc.split_pattern(texts, " ")
        begins = cut.offsets.to_numpy().astype(np.int64)
        begins = begins - begins[0]
        chunks = cut.flatten()
        coded = chunks.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).copy()
        names = coded.dictionary.to_pylist()
        ids = list(map(self._memo.get, names))
        new = [i for i, x in enumerate(ids) if x is None]
        for k in range(0, len(new), 2000):
            self._learn(new[k : k + 2000], names, ids)
        # no space stands before a text's first chunk
        code[begins[:-1]] = len(names) + np.arange(len(texts), dtype=code.dtype)
        ids += self._ids(chunks.take(pa.array(begins[:-1])).to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        place = np.cumsum(size, dtype=np.int32) - size
        flat = np.frombuffer(b"".join(ids), np.uint32)
        length = size[code]
        ahead = np.cumsum(length, dtype=np.int64)
        out = flat[np.repeat((place[code] - ahead + length).astype(np.int32), length) + np.arange(int(ahead[-1]), dtype=np.int32)]
        last = 0
        for end in ahead[begins[1:] - 1].tolist():
            yield out[last:end]
            last = end

    def _learn(self, new: list[int], names: list[str], ids: list) -> None:
        whole = self._ids([" " + " ".join(names[i] for i in new)])[0]
        ends = np.cumsum(self._bytes_of[np.frombuffer(whole, np.uint32)])
        sizes = np.cumsum([len(names[i].encode()) + 1 for i in new])
        last, room = 0, MEMO_CHUNKS - len(self._memo)
        for i, end in zip(new, (4 * np.searchsorted(ends, sizes, "right")).tolist()):
            ids[i], last = whole[last:end], end
            if room > 0:
                self._memo[names[i]] = ids[i]
                room -= 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkedEncoder:
    return ChunkedEncoder(path)


# --- write and read --------------------------------------------------------------------------


def write_token_files(df: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each with ``END_ID`` after it, in ascending order of ``id_col``."""

    def shards(batches):
        coder = _encoder(tokenizer)
        part = TaskContext.get().partitionId()  # ranges are numbered in their order
        docs: list = []
        parts: list = []
        held = before = number = 0

        def packed():
            row = part, number, before, docs[0], len(docs), held, Shard.pack(docs, parts, coder.vocabulary, part, number)
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, kinds)], names=["part", "number", "before", "first_doc", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc, coded in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                docs.append(doc)
                parts.append(np.append(coded, np.uint32(END_ID)))
                held += len(coded) + 1
                if held >= SHARD_TOKENS:
                    yield packed()
                    before, number = before + held, number + 1
                    docs, parts, held = [], [], 0
        if docs:
            yield packed()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = F.col("id").asc_nulls_first(), F.xxhash64("text")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ranged.mapInArrow(shards, SHARD_SCHEMA).write.parquet(out)


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids`` (binary, unsigned 32-bit little-endian)."""

    def decode(batches):
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(payload.as_py())
                ids = expand(shard.seq, shard.rules, shard.first, shard.lengths).astype("<u4", copy=False)
                ends = np.cumsum(shard.doc_tokens, dtype=np.int64)
                begins = ends - shard.doc_tokens
                cut = [ids[a:b].tobytes() for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_null.astype(bool)), pa.array(begins + start), pa.array(shard.doc_tokens.astype(np.int64)), pa.array(cut, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # a row for each range, of which there are no more than the partitions of the write
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    placed = files.select("part", "before", "payload").join(F.broadcast(ranges), "part").select(F.col("ahead") + F.col("before"), "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark, sf_dir):
    import public_tokenizers

    ws = Workspace(spark, "tokens")
    path = f"{ws.root}/ids"
    write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    back = read_token_files(spark, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
