"""Offset-preserving encoding and decoding with a SentencePiece BPE model.

Normalisation looks up the longest prefix in the model's compiled character map
(a double-array trie) and records, for every normalised byte, the source byte it
came from; pieces found in the normalised text are projected through that record
to spans of original bytes.  A model whose map is empty rewrites nothing but spaces:
its record is made for many texts at once (``Tiled``), by array operations.

Merges never join what no piece of the vocabulary spans.  If no piece has a space
mark after another character, the normalised text falls apart before each run of marks
into segments that can be encoded alone, so every different segment is encoded once
per worker and bounded cache, and a long text is encoded part by part.

Defined results: a null text counts as empty, whose encoding is the begin and end ids;
rows with equal keys each keep theirs; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, prefix_hash, span_hash, spread

MARK = "▁"
MARK_BYTES = MARK.encode()
SPACE, LINE = 0x20, 0x0A
#: bytes of segments, and of their ids, that a worker keeps; the cache is emptied when either is full
CACHE_BYTES = 16 << 20
#: bytes of text that are encoded together
TOGETHER = 1 << 18
LISTS = {"ids": "ids", "begins": "begin", "ends": "end"}


class Encoding(NamedTuple):
    ids: np.ndarray  # uint32, with begin and end ids
    begin: np.ndarray  # uint32 source byte offsets, one for each id
    end: np.ndarray


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.held, self.n = np.empty(1024, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.held):
            more = np.empty(max(2 * len(self.held), self.n + len(x)), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(x)] = x
        self.n += len(x)

    def all(self) -> np.ndarray:
        return self.held[: self.n]


class SegmentCache:
    """Ids of segments by hash; what is found is compared byte by byte with what was asked."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hash, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.text, self.text_at = Growing(np.uint8), Growing(np.int64)
        self.ids, self.ids_at = Growing(np.uint32), Growing(np.int64)
        self.text_at.add(np.zeros(1, np.int64))
        self.ids_at.add(np.zeros(1, np.int64))

    def _flat(self, norm: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode([norm[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist())])
        many = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(many.sum())), many

    def find(self, norm: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each segment) of the segments that begin at ``begin`` and fill ``norm``."""
        if not len(begin):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.text.n > CACHE_BYTES or 4 * self.ids.n > CACHE_BYTES or 16 * len(self.hash) > CACHE_BYTES:
            self.clear()
        end = np.append(begin[1:], len(norm))
        key, first, which = np.unique(span_hash(prefix_hash(norm), begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, key)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == key[known]
        new = np.flatnonzero(~known)
        if len(new):
            b, e = begin[first[new]], end[first[new]]
            ids, many = self._flat(norm, b, e)
            slots = self.text_at.n - 1 + np.arange(len(new))
            self.text_at.add(self.text.n + np.cumsum(e - b))
            self.text.add(norm[spread(b, e - b)])
            self.ids_at.add(self.ids.n + np.cumsum(many))
            self.ids.add(ids)
            self.hash, self.slot = np.insert(self.hash, at[new], key[new]), np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.hash, key)
        slot = self.slot[at][which]
        t, i = self.text_at.all(), self.ids_at.all()
        size = t[slot + 1] - t[slot]
        if (size != end - begin).any() or (self.text.all()[spread(t[slot], size)] != norm).any():
            return self._flat(norm, begin, end)  # two segments of one hash
        many = i[slot + 1] - i[slot]
        return self.ids.all()[spread(i[slot], many)], many


class Tiled(NamedTuple):
    """Texts encoded together: their ids, and what of the source and of the decoded text each id has."""

    ids: np.ndarray
    first: np.ndarray  # the first id of each text, one entry more than texts
    begin: np.ndarray
    end: np.ndarray
    decoded: np.ndarray  # bytes
    decoded_at: np.ndarray  # where each text's begins


class CharsMap:
    """The compiled character map: longest-prefix rewriting of UTF-8 bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


def _char_length(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.chars = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.unk = kinds.index(2)
        self.whole = kinds.count(6) == 256  # no character is unknown
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        self.unk_surface = proto.trainer_spec.unk_surface
        self.own = sorted((p.encode() for p, k in zip(pieces, kinds) if k == 4), key=len, reverse=True)
        self.surface = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.encode() for p, k in zip(pieces, kinds)]
        splits = all(MARK not in p.lstrip(MARK) for p in pieces) and not proto.trainer_spec.treat_whitespace_as_suffix
        self.lines = all("\n" not in p for p in pieces)  # lines fall apart too
        # texts can be tiled: nothing but spaces is rewritten, segments are independent, no character is unknown
        self.tiles = not self.chars.units and not self.own and not self.squeeze and spec.escape_whitespaces and splits and self.whole
        # text that is normalised already: only the segmentation is left to the library
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.bpe = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        spaced = [s.replace(MARK_BYTES, b" ") for s in self.surface]
        self.size = np.array([len(s) for s in self.surface], np.int64)
        self.spaced_at = np.concatenate([[0], np.cumsum([len(s) for s in spaced])]).astype(np.int64)
        self.spaced = np.frombuffer(b"".join(spaced), np.uint8)
        self.cache = SegmentCache(lambda texts: self.bpe.encode(texts, num_threads=1))

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, the source offset."""
        out, align, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(data) and (step := self._step(data, at))[1] == b" ":
                at += step[0]
        if at == len(data):
            return b"", np.zeros(1, np.uint32)
        if self.dummy:
            out += MARK_BYTES
            align += [at] * 3
        spaced = self.squeeze
        while at < len(data):
            used, text = self._step(data, at)
            while spaced and text.startswith(b" "):
                text = text[1:]
            if text:
                text, own = text.replace(b" ", MARK_BYTES), text
                out += text
                align += [at] * len(text)
                spaced = self.squeeze and own.endswith(b" ")
            at += used
        end = at
        if self.squeeze:
            while out.endswith(MARK_BYTES):
                end = align[-3]
                del out[-3:], align[-3:]
        return bytes(out), np.array([*align, end], np.uint32)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        for x in self.own:
            if data.startswith(x, at):
                return len(x), x
        if found := self.chars.longest(data, at):
            return found
        n = _char_length(data[at])
        return n, data[at : at + n]

    def tile(self, buf: np.ndarray, off: np.ndarray, starts: bool = True) -> Tiled:
        """Texts of one buffer; ``starts`` is False for the later parts of a text."""
        size = np.diff(off)
        marked = np.flatnonzero((size > 0) & (self.dummy & starts))
        # normalised bytes and the source byte that each came from
        source = np.arange(len(buf)) - np.repeat(off[:-1], size)
        text, source = np.insert(buf, off[marked], SPACE), np.insert(source, off[marked], 0)
        off = off + np.concatenate([[0], np.cumsum(np.bincount(marked, minlength=len(size)))])
        space = text == SPACE
        wide = np.where(space, 3, 1)
        at = np.concatenate([[0], np.cumsum(wide)])
        norm, align = np.repeat(text, wide), np.append(np.repeat(source, wide), 0)
        for k, b in enumerate(MARK_BYTES):
            norm[at[:-1][space] + k] = b
        off = at[off]
        # segments begin with texts, with runs of marks, and with and after line ends
        mark = np.zeros(len(norm) + 3, bool)
        mark[3 : len(norm) + 1] = (norm[:-2] == MARK_BYTES[0]) & (norm[1:-1] == MARK_BYTES[1]) & (norm[2:] == MARK_BYTES[2])
        edge = np.zeros(len(norm) + 1, bool)
        edge[:-1] = mark[3:] & ~mark[:-3]
        if self.lines:
            line = norm == LINE
            edge[:-1] |= line
            edge[1:] |= line
        edge[off[:-1][off[:-1] < off[1:]]] = True
        begin = np.flatnonzero(edge[:-1])
        ids, many = self.cache.find(norm, begin)
        made = np.concatenate([[0], np.cumsum(many)])
        first = made[np.searchsorted(begin, off)]
        # pieces fill the normalised text; their ends are projected to the source
        cut = np.concatenate([[0], np.cumsum(self.size[ids])])
        begins, ends = align[cut[:-1]], align[cut[1:]]
        has = first[1:] > first[:-1]
        ends[first[1:][has] - 1] = size[has]
        length = self.spaced_at[ids + 1] - self.spaced_at[ids]
        decoded = self.spaced[spread(self.spaced_at[ids], length)]
        decoded_at = np.concatenate([[0], np.cumsum(length)])[first]
        return Tiled(ids, first, begins.astype(np.uint32), ends.astype(np.uint32), decoded, decoded_at)

    def parts(self, raw: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of a text, cut where its segments begin."""
        at = 0
        while at < len(raw):
            to = at + TOGETHER
            while to < len(raw):
                here = raw[to - TOGETHER : to]
                ends = np.flatnonzero((here[3:] == SPACE) & (here[2:-1] != SPACE) & (here[2:-1] != MARK_BYTES[2]))
                if len(ends) and to - TOGETHER + 3 + int(ends[-1]) > at:
                    to = to - TOGETHER + 3 + int(ends[-1])
                    break
                to += TOGETHER - 3
            to = min(to, len(raw))
            yield at, to
            at = to

    def encode_all(self, col: pa.Array) -> Iterator[tuple[Encoding, bytes]]:
        """The encoding and the decoded text of each row, in order."""
        bos, eos, zero = np.array([self.bos], "<u4"), np.array([self.eos], "<u4"), np.zeros(1, "<u4")

        def whole(ids, begin, end, n):
            last = np.array([n], "<u4")
            return Encoding(np.concatenate([bos, ids, eos]).astype("<u4"), np.concatenate([zero, begin, last]).astype("<u4"), np.concatenate([zero, end, last]).astype("<u4"))

        for c in chunks(col, TOGETHER):
            if not self.tiles:
                for i in range(c.n):
                    ids, begin, end, decoded = self._encode_one(c.buf[c.off[i] : c.off[i + 1]].tobytes())
                    yield whole(ids, begin, end, end[-1] if len(end) else c.off[i + 1] - c.off[i]), decoded
            elif len(c.buf) > 2 * TOGETHER:  # one long text
                made = [(a, self.tile(c.buf[a:b], np.array([0, b - a]), a == 0)) for a, b in self.parts(c.buf)]
                ids, begin, end = np.concatenate([t.ids for _, t in made]), np.concatenate([t.begin + np.uint32(a) for a, t in made]), np.concatenate([t.end + np.uint32(a) for a, t in made])
                yield whole(ids, begin, end, len(c.buf)), b"".join(t.decoded.tobytes() for _, t in made)[int(self.dummy) :]
            else:
                t = self.tile(c.buf, c.off)
                for i in range(c.n):
                    a, b, n = t.first[i], t.first[i + 1], c.off[i + 1] - c.off[i]
                    yield whole(t.ids[a:b], t.begin[a:b], t.end[a:b], n), t.decoded[t.decoded_at[i] + (self.dummy and n > 0) : t.decoded_at[i + 1]].tobytes()

    def _encode_one(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Ids, source spans and decoded text by the character map, step by step."""
        norm, align = self.normalise(raw)
        ids = np.array(self.bpe.encode(norm.decode()) if norm else [], np.uint32)
        at, cuts = 0, [0]
        for i in ids:
            at += len(self.surface[i]) if i != self.unk else self._unknown(norm, at)
            cuts.append(at)
        spans = align[np.minimum(cuts, len(align) - 1)] if len(ids) else np.zeros(1, np.uint32)
        return ids, spans[:-1], spans[1:], self.decode(ids).encode()

    def encode(self, text: str | None) -> tuple[Encoding, str]:
        """The encoding of a text (null: empty), and its decoding."""
        e, decoded = next(self.encode_all(pa.array([text], pa.string())))
        return e, decoded.decode("utf-8", "replace")

    def _unknown(self, norm: bytes, at: int) -> int:
        """The bytes of an unknown id: the character that it stands for."""
        return _char_length(norm[at])

    def decode(self, ids: np.ndarray) -> str:
        parts, leading = [], self.dummy or self.squeeze
        for i in ids:
            s = self.unk_surface.encode() if i == self.unk else self.surface[i]
            if leading and s:
                if i != self.unk and s.startswith(MARK_BYTES):
                    s = s[3:]
                    if not self.squeeze:
                        leading = False
                else:
                    leading = False
                leading = leading and not s
            parts.append(s.replace(MARK_BYTES, b" "))
        return b"".join(parts).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", ids: bool = True, spans: bool = True) -> DataFrame:
    """One row for each row of ``docs``: key, n_tokens, digests, n_source_bytes and, as asked, the
    ids (with begin and end ids), the decoded text, and the source byte span of each id."""
    kind = docs.schema[key].dataType.simpleString()
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string()), ("n_source_bytes", pa.int64())]
    lists = ["ids"] * ids + ["begins", "ends"] * spans
    schema = f"{key} {kind}, " + ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in fields) + ", decoded string" * ids + "".join(f", {n} array<int>" for n in lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            rows, decoded, flat, held, sent = [], [], {n: [] for n in lists}, 0, 0

            def out() -> pa.RecordBatch:
                cols = [batch.column(0).slice(sent, len(rows)), *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)]]
                if ids:
                    cols.append(pa.array(decoded, pa.binary()).cast(pa.string()))
                cuts = pa.array(np.concatenate([[0], np.cumsum([r[0] for r in rows])]).astype(np.int32))
                cols += [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(flat[n]).astype(np.int32), pa.int32())) for n in lists]
                return pa.RecordBatch.from_arrays(cols, names=[key, *[n for n, _ in fields], *["decoded"] * ids, *lists])

            for e, d in model.encode_all(batch.column(1)):
                rows.append((len(e.ids), hashlib.sha256(e.ids).hexdigest(), hashlib.sha256(d).hexdigest(), hashlib.sha256(e.begin.tobytes() + e.end.tobytes()).hexdigest(), int(e.end[-1])))
                for n in lists:
                    flat[n].append(getattr(e, LISTS[n]))
                if ids:
                    decoded.append(d)
                held += len(e.ids)
                if held > TOGETHER:  # ids take more room than their text
                    yield out()
                    sent += len(rows)
                    rows, decoded, flat, held = [], [], {n: [] for n in lists}, 0
            if rows:
                yield out()

    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)


@lru_cache(maxsize=1)
def load(path: str) -> PieceModel:
    return PieceModel(path)
