"""Operator 7: SentencePiece encoding and decoding with byte spans.

The text is normalised by longest-prefix matches through the model's compiled
character map (a double-array trie); each normalised unit remembers which bytes
of the text it came from.  The normalised text is cut where no piece of the
vocabulary can reach across (before a run of space marks), every distinct cut
is segmented once per worker, and the pieces are projected back through the
alignment to spans of the original bytes.  A model without a map that keeps all
spaces has its alignment filled by a rule over arrays.

Ids, counts and decoded texts all come from the projected pieces.

Null text is empty: no ids, empty spans.  An empty table gives an empty result;
a null id stays null; rows are encoded one by one, so ties and repeated rows
give repeated results; extra columns are ignored.  Decoding follows the library
on any list of ids: each byte that is no UTF-8 becomes one replacement
character, control ids nothing, an unknown id the model's surface.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow, release, schema

SPACE = "▁"
# One replacement character for each byte that is no part of a character.
codecs.register_error("lectern-each", lambda e: ("\ufffd" * (e.end - e.start), e.end))
CACHE_ENTRIES = 150_000
CACHE_LENGTH = 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """Longest-prefix replacement by a compiled map: 4 bytes of trie size, the
    double-array trie, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.texts = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes matched, place of the replacement), or (0, -1)."""
        if not len(self.units):
            return 0, -1
        found = (0, -1)
        unit = int(self.units[0])
        node = self._offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = int(self.units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                found = (i - at + 1, int(self.units[node]) & 0x7FFFFFFF)
        return found

    def replacement(self, at: int) -> bytes:
        return self.texts[at : self.texts.index(b"\0", at)]


def _width(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Encoder:
    """One model: normalise, segment, project, decode."""

    def __init__(self, path: str):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.identity = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
        self.prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or not self.escape:
            raise ValueError("only models with a leading space mark are supported")
        # The segmenter gets text that is normalised already.
        rules.name, rules.precompiled_charsmap = "identity", b""
        rules.add_dummy_prefix, rules.remove_extra_whitespaces = False, False
        self.segmenter = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in proto.pieces]
        self.byte = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN}
        self.surface = proto.trainer_spec.unk_surface
        self.first, self.strip = True, self.prefix or self.squeeze
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED))
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not inner else r"[\s\S]+")
        # Of each cut: number of ids, ids joined by commas, text, ids and sizes as 32-bit numbers.
        self.cache: dict[str, tuple[int, str, str, bytes, bytes]] = {}

    # -- normalisation -----------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its UTF-8 bytes and its end, the byte of the text it stands at."""
        return self._aligned(text) if self.identity else self._walk(text)

    def _aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The same without a map: spaces become marks, and each byte stands at the first one of its character."""
        if not text:
            return "", np.zeros(1, np.int64)
        data = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(data))
        if not text.isascii():
            at = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, at, 0))
        mark = len(SPACE.encode())
        at = np.repeat(at, np.where(data == 32, mark, 1))
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return marked, np.concatenate([np.zeros(mark * self.prefix, np.int64), at, [len(data)]])

    def _walk(self, text: str) -> tuple[str, np.ndarray]:
        data = text.encode()
        out, source = bytearray(), []
        at, end = 0, len(data)
        space = SPACE.encode()

        def unit(i: int) -> tuple[bytes, int]:
            n, where = self.map.longest(data, i)
            if n:
                return self.map.replacement(where), n
            w = _width(data[i])
            return data[i : i + w], w

        if self.squeeze:
            while at < end:
                got, n = unit(at)
                if got.strip(b" "):
                    break
                at += n
        if at >= end:
            return "", np.zeros(1, np.int64)
        if self.prefix:
            out += space
            source += [at] * len(space)
        was_space = self.squeeze
        while at < end:
            got, n = unit(at)
            if self.squeeze:
                while was_space and got[:1] == b" ":
                    got = got[1:]
            for b in got:
                piece = space if b == 32 else bytes((b,))
                out += piece
                source += [at] * len(piece)
            if got:
                was_space = self.squeeze and got[-1:] == b" "
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = source[-len(space)]
                del source[-len(space) :]
        source.append(at)
        return out.decode(), np.asarray(source, np.int64)

    # -- segmentation ------------------------------------------------------

    def _entry(self, cut: str, ids: list[int]) -> tuple[int, str, str, bytes, bytes]:
        if self.unknown.isdisjoint(ids):
            sizes = [1 if i in self.byte else len(self.pieces[i].encode()) for i in ids]
        else:
            # An unknown piece is as long as what it stands for.
            sizes = [len(p.surface.encode()) for p in self.segmenter.encode(cut, return_type="proto").pieces]
        return len(ids), ",".join(map(str, ids)), self._surface(ids), array("i", ids).tobytes(), array("I", sizes).tobytes()

    def _surface(self, ids, start: bool = False) -> str:
        """Text of the ids; at the start of a text a space mark is dropped as encoding put it there."""
        out, run, text = [], bytearray(), False
        for i in ids:
            if i in self.byte:
                run.append(self.byte[i])
                text = True
                continue
            if run:
                out.append(run.decode(errors="lectern-each"))
                run.clear()
            if i in self.control:
                continue
            if i in self.unknown:
                out.append(self.surface)
            else:
                piece = self.pieces[i]
                if start and not text and self.strip and piece.startswith(SPACE):
                    # Only the mark of the first piece, or those of all pieces where runs of spaces are squeezed.
                    piece, text = piece[len(SPACE) :], not self.squeeze
                out.append(piece.replace(SPACE, " "))
            text = text or bool(out[-1])
        if run:
            out.append(run.decode(errors="lectern-each"))
        return "".join(out)

    def cuts(self, normalised: list[str]) -> list[list[tuple[int, str, str, bytes, bytes]]]:
        """Segmented cuts of each normalised text; distinct cuts are segmented once."""
        parts = [self.cut.findall(x) for x in normalised]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = set().union(*parts).difference(self.cache) if parts else set()
        own = {}
        if new:
            new = list(new)
            for cut, ids in zip(new, self.segmenter.encode(new, num_threads=1), strict=True):
                (self.cache if len(cut) <= CACHE_LENGTH else own)[cut] = self._entry(cut, ids)
        if own:
            return [[self.cache[x] if x in self.cache else own[x] for x in p] for p in parts]
        get = self.cache.__getitem__
        return [list(map(get, p)) for p in parts]

    def encode(self, text: str | None) -> list[int]:
        return [i for i, _, _ in self.spans(text)]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first byte, byte after the last) of each piece, in bytes of the text."""
        normalised, source = self.normalise(text or "")
        entries = self.cuts([normalised])[0]
        starts, ends = self._project(entries, source)
        return list(zip(self._ids(entries).tolist(), starts.tolist(), ends.tolist(), strict=True))

    def forget(self) -> None:
        """Drop the cuts kept so far, as a worker keeps its encoder while other operators run."""
        self.cache = {}
        release()

    @staticmethod
    def _ids(entries) -> np.ndarray:
        return np.frombuffer(b"".join([e[3] for e in entries]), np.int32)

    @staticmethod
    def _project(entries, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and byte after the last of each piece of the segmented cuts, in bytes of the text."""
        sizes = np.frombuffer(b"".join([e[4] for e in entries]), np.uint32)
        at = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        if at[-1] != len(source) - 1:
            raise AssertionError("the pieces do not cover the normalised text")
        at = source[at]
        return at[:-1], at[1:]

    def decode(self, ids) -> str:
        ids = list(ids)
        if any(not 0 <= i < len(self.pieces) for i in ids):
            raise IndexError("an id outside the vocabulary")
        return self._surface(ids, start=True)

    def digests(self, texts: list[str]):
        """(number of ids, ids joined by commas, decoded text, first bytes, bytes after the last, ids) of each text."""
        found = [self.normalise(x) for x in texts]
        for entries, (_, source) in zip(self.cuts([x for x, _ in found]), found, strict=True):
            starts, ends = self._project(entries, source)
            # Cuts end where characters do, so only the first one is decoded in its place.
            decoded = "".join([self._surface(self._ids(entries[:1]).tolist(), start=True), *[e[2] for e in entries[1:]]]) if entries else ""
            yield len(starts), ",".join([e[1] for e in entries]), decoded, starts, ends, self._ids(entries)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ids array<int>, starts and ends array<long> in bytes of the text."""
    path = path or default_model()
    arrow(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = encoder(path)
        for b in batches:
            found = [model.spans(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([[p[j] for p in f] for f in found], pa.list_(t)) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["key", "ids", "starts", "ends"])
        model.forget()

    return df.select(df[key], df[text]).mapInArrow(run, f"key {kind}, ids array<int>, starts array<bigint>, ends array<bigint>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: key and text; null ids give a null text."""
    path = path or default_model()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        model = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["key", "text"]
            )

    return df.select(df[key], df[ids]).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digest(df: DataFrame, path: str | None = None, ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns `keep`, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of all starts, then all
    ends, as little-endian 64-bit numbers) and, if asked for, ids array<int>."""
    path = path or default_model()
    arrow(df.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    lead = ["doc_id", *keep]
    place = lead.index("text") if "text" in lead else len(lead)

    def run(batches):
        model = encoder(path)
        for b in batches:
            n, told, back, where, flat, ends = [], [], [], [], [], [0]
            texts = [x or "" for x in b.column(place).to_pylist()]
            for lo in range(0, len(texts), 64):
                for count, joined, decoded, first, last, own in model.digests(texts[lo : lo + 64]):
                    n.append(count)
                    told.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                    where.append(hashlib.sha256(first.astype("<i8").tobytes() + last.astype("<i8").tobytes()).hexdigest())
                    if ids:
                        flat.append(own)
                        ends.append(ends[-1] + count)
            cols = [*b.columns[: len(lead)], pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (told, back, where))]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(cols, [*lead, *names, *(["ids"] if ids else [])])
        model.forget()

    extra = ", ids array<int>" if ids else ""
    rows = df.select(*[df[c] for c in lead], *([] if "text" in lead else [df["text"]]))
    return rows.mapInArrow(run, schema(df, lead, f"n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string{extra}"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
