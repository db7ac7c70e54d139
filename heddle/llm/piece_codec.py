"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Text is cut into words, each a run of word marks with what follows it; no piece of the model goes on past a character
that comes before a mark, so words merge alone. The distinct words of a slice are laid out as one flat array of symbols. In a round
each pair of neighbours looks its merged piece up, a segmented minimum gives each word its best rank, the leftmost pair
of that rank merges in all words at once, and the array is compacted, until no pair is left. Further pairs of that rank
in the same word merge in the same round if no pair with the merged piece outranks it, since then the library, too,
would take them next.

Models with an identity normaliser, a dummy prefix, byte fallback and no pieces with a mark inside are supported; others
raise ValueError. Null texts count as empty and give the begin and end ids alone. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb

from .common import fresh, held, mapped, ragged, slices, utf8
from .spans import SpanTable

MARK = "▁"
_MARK = MARK.encode()
_NONE = np.int32(2**31 - 1)


class PieceCodec:
    def __init__(self, path: str, most: int = 200_000):
        proto = model_pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces]
        kinds = np.array([p.type for p in proto.pieces])
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("unsupported normaliser or model type")
        if any(MARK in p.lstrip(MARK) for p in normal) or set(kinds) - {1, 2, 3, 6}:
            raise ValueError("unsupported pieces")
        self.bos, self.eos = pieces.index("<s>"), pieces.index("</s>")
        self.byte = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        #: id of a single character, or -1
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        _, rank = np.unique([-p.score for p in proto.pieces], return_inverse=True)
        self.rank = rank.astype(np.int32)
        pairs = [(normal[p[:j]], normal[p[j:]], i) for p, i in normal.items() for j in range(1, len(p)) if p[:j] in normal and p[j:] in normal]
        left, right, made = np.array(pairs, np.int64).T
        order = np.argsort(left << 32 | right)
        self.bits = 1
        while True:  # a table without clashes beyond a few probes
            self.size = 1 << (len(pairs).bit_length() + self.bits)
            if self._fill((left << 32 | right)[order], made[order].astype(np.int32)):
                break
            self.bits += 1
        same = np.bincount(self.rank[list(normal.values())], minlength=len(pieces))
        #: after merging such a piece no pair with it comes before other pairs of its rank
        self.calm = same[self.rank] == 1
        for side in (left, right):
            self.calm[side[self.rank[made] <= self.rank[side]]] = False
        texts = [bytes([int(p[3:5], 16)]) if kinds[i] == 6 else b"" if kinds[i] == 3 else b" \xe2\x81\x87 " if kinds[i] == 2 else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.width = np.array([len(t) for t in texts])
        self.place = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.marked = np.array([kinds[i] == 1 and p.startswith(MARK) for i, p in enumerate(pieces)])
        self.table = SpanTable(self._learn, np.int32, most)

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def _fill(self, keys: np.ndarray, made: np.ndarray, probes: int = 12) -> bool:
        self.keys, self.made = np.full(self.size + probes, -1, np.int64), np.full(self.size + probes, -1, np.int32)
        at, self.probes = self._hash(keys), 0
        left = np.arange(len(keys))
        while len(left):
            if self.probes == probes:
                return False
            p = at[left] + self.probes
            free = left[self.keys[p] == -1]
            self.keys[at[free] + self.probes] = keys[free]
            won = self.keys[at[left] + self.probes] == keys[left]
            self.made[at[left[won]] + self.probes] = made[left[won]]
            left = left[~won]
            self.probes += 1
        return True

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = self._hash(key)
        out = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for j in range(self.probes):
            k = self.keys[at[open_] + j]
            hit = k == key[open_]
            out[open_[hit]] = self.made[at[open_[hit]] + j]
            open_ = open_[~hit & (k != -1)]
            if not len(open_):
                break
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds of merges over words (runs of symbols; below 0: a character without a piece). Flat pieces and their count for each word."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = None
        while len(symbols):
            near = np.flatnonzero((word[1:] == word[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0))
            made = np.full(len(symbols), -1, np.int32)
            made[near] = self.merged(symbols[near], symbols[near + 1])
            rank = np.where(made >= 0, self.rank[made], _NONE)
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(begin, len(word)))
            best = np.minimum.reduceat(rank, begin)
            still = best < _NONE
            if not still.all():  # words without a pair are ready
                over = np.repeat(~still, size)
                done.append((word[over], symbols[over]))
                on = ~over
                word, symbols, made, rank, best, size = word[on], symbols[on], made[on], rank[on], best[still], size[still]
                if not len(symbols):
                    break
                begin = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(best, size))
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            run = np.cumsum(np.concatenate([[True], (at[1:] != at[:-1] + 1) | first[1:]])) - 1
            start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            even = (np.arange(len(at)) - start[run]) % 2 == 0
            at = at[first | (even & self.calm[made[at]])]
            symbols = symbols.copy()
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(sizes))

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = ends - starts
        flat = data[ragged(starts, lengths)]
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = (flat & 0xC0) != 0x80
        own = np.repeat(np.arange(len(starts)), lengths)[lead]
        ids = self.char[points]
        pieces, counts = self.merge(np.where(ids >= 0, ids, ~points.astype(np.int32)), np.bincount(own, minlength=len(starts)))
        odd = np.flatnonzero(pieces < 0)
        if len(odd):  # bytes stand for characters that have no piece
            spread = np.ones(len(pieces), np.int64)
            codes = [chr(~p).encode() for p in pieces[odd].tolist()]
            spread[odd] = [len(c) for c in codes]
            out = np.repeat(pieces, spread)
            out[out < 0] = self.byte[np.frombuffer(b"".join(codes), np.uint8)]
            word = np.repeat(np.arange(len(counts)), counts)
            return out, np.bincount(word, spread, len(counts)).astype(np.int64)
        return pieces, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end ids, and len + 1 offsets, of UTF-8 texts that lie end to end."""
        n = len(offsets) - 1
        full = np.diff(offsets) > 0
        # a mark stands for each space and before each text that isn't empty
        sizes = np.ones(len(data), np.int64)
        sizes[data == 32] = 3
        ahead = np.zeros(len(data) + 1, np.int64)
        ahead[offsets[:-1][full]] = 3
        end = np.cumsum(sizes + ahead[:-1])
        raw = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        plain = sizes == 1
        raw[end[plain] - 1] = data[plain]
        mark = np.frombuffer(_MARK, np.uint8)
        begin = np.concatenate([end[~plain] - 3, (end - sizes)[offsets[:-1][full]] - 3])
        for j in range(3):
            raw[begin + j] = mark[j]
        text = np.concatenate([[0], end])[offsets]
        # words begin at a mark that doesn't follow one, and at each text
        head = np.zeros(len(raw) + 1, bool)
        if len(raw):
            marks = np.flatnonzero((raw[:-2] == mark[0]) & (raw[1:-1] == mark[1]) & (raw[2:] == mark[2]))
            head[marks] = True
            head[np.intersect1d(marks, marks + 3, assume_unique=True)] = False
            head[text[:-1][full]] = True
            head[len(raw)] = False
        starts = np.flatnonzero(head)
        ids, counts = self.table(raw, starts, np.append(starts[1:], len(raw))) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, text)]
        out_at = at + 2 * np.arange(n + 1)
        out = np.empty(len(ids) + 2 * n, np.int32)
        out[np.arange(len(ids)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = ids
        out[out_at[:-1]], out[out_at[1:] - 1] = self.bos, self.eos
        return out, out_at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of id runs, and len + 1 offsets; the dummy prefix before the first piece goes."""
        counts = self.width[ids]
        data = self.bytes[ragged(self.place[ids], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = ends[offsets]
        lead = offsets[:-1] + (np.append(ids, -1)[offsets[:-1]] == self.bos)
        lead = lead[(lead < offsets[1:]) & self.marked[ids[np.minimum(lead, len(ids) - 1)]]] if len(ids) else lead[:0]
        keep = np.ones(len(data), bool)
        keep[ends[lead]] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return data[keep], at - gone[at]


def held_as(path: str) -> tuple[str, str]:
    return "pieces", path


def loaded(path: str) -> PieceCodec:
    """One per Python worker and stage."""
    return held(held_as(path), lambda: PieceCodec(path))


def encode_ids(df: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each whole text (array<int>, begin and end ids included); renamed if df has such a column."""
    schema = T.StructType([*df.schema.fields, T.StructField(fresh(df, out), T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        for batch in slices(batches, text):
            ids, at = codec.encode(*utf8(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=schema.names)

    return mapped(df, run, schema, held_as(model))


def decode_ids(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each id list; null counts as an empty list."""
    schema = T.StructType([*df.schema.fields, T.StructField(fresh(df, out), T.StringType())])
    where = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        for batch in batches:
            lists = batch.column(where).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            data, ends = codec.decode(np.array([i for x in lists for i in x or ()], np.int64), at)
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return mapped(df, run, schema, held_as(model))


def digests(df: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each whole text: encoded, and decoded again from the ids, slice by slice."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(model)
        sha = lambda data, at: [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for batch in slices(batches, "text"):
            ids, at = codec.encode(*utf8(batch.column(1)))
            data, ends = codec.decode(ids, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(sha(memoryview(ids.astype("<u4").tobytes()), 4 * at)), pa.array(sha(memoryview(data.tobytes()), ends))], names=schema.names)

    return mapped(df.select(df[id_col], df[text].alias("text")), run, schema, held_as(model))
