"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model protobuf."""

from __future__ import annotations

import codecs
import os
import struct
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers

from tessera.llm.common import bound_batches, raw, slices

MARK = "▁"
#: Fixed values of the protobuf: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown piece is decoded to, also a fixed value.
UNKNOWN_TEXT = " \u2047 "

codecs.register_error("tessera_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """What a SentencePiece model file says, and a tokenizer rebuilt from it."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(fields(f.read()))
        rows = [dict(fields(v)) for k, v in top if k == 1]
        trainer, norm = (dict(fields(dict(top).get(k, b""))) for k in (2, 3))
        self.pieces = [r[1].decode() for r in rows]
        self.scores = [struct.unpack("<f", r.get(2, b"\0\0\0\0"))[0] for r in rows]
        self.types = [r.get(3, NORMAL) for r in rows]
        self.kind, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.charsmap = norm.get(2, b"")
        plain = [p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER)]
        # Where no piece goes on after a mark that follows other letters, or holds a line end, these never merge.
        # Without byte fallback, unknown characters in a row make one id, and may lie on both sides.
        self.apart = self.byte_fallback and all(MARK not in p.lstrip(MARK) and "\n" not in p for p in plain)
        self.steps = []
        if self.charsmap:
            self.steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            # Only blanks go, tabs and line ends stay; a mark at the end counts as a blank.
            self.steps += [normalizers.Replace(Regex(r"\A +|[ ▁]+\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(self.steps) if self.steps else None
        self.tokenizer = Tokenizer(self.unigram() if self.kind == UNIGRAM else self.merging())
        self.bytes = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]

    def unigram(self) -> models.Unigram:
        """A unigram model. Only normal and user pieces occur in texts; all others get names that no text has.

        Unknown characters cost ten more than the worst piece, so the others take the best score. A user piece
        gets the best score for each of its bytes. Byte fallback is in ids(), for a text may hold the name of a byte piece.
        """
        best = max((s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL), default=0.0)
        rows = []
        for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types, strict=True)):
            if t == NORMAL:
                rows.append((p, s))
            elif t == USER:
                rows.append((p, len(p.encode()) * best - 0.1))
            else:
                rows.append((f"\0 {i}", best))
        return models.Unigram(rows, self.unknown, False)

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalised texts, encoded as a batch."""
        if self.kind != UNIGRAM or not self.byte_fallback:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            if self.unknown not in e.ids:
                out.append(e.ids)
                continue
            ids = []
            for i, (a, z) in zip(e.ids, e.offsets, strict=True):
                ids += [self.byte_ids[b] for b in text[a:z].encode()] if i == self.unknown else [i]
            out.append(ids)
        return out

    def merging(self) -> models.BPE:
        """A BPE model: every split of a piece into two pieces is a merge, best scores first."""
        number = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        merges = []
        for p, i in number.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    merges.append((-self.scores[i], i, number[p[:k]], number[p[k:]], (p[:k], p[k:])))
        merges = [m[-1] for m in sorted(merges, key=lambda m: m[:-1])]
        return models.BPE({p: i for i, p in enumerate(self.pieces)}, merges, unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)

    def normalised(self, text: str) -> str:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if not text:
            return text
        if self.prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class PieceEncoder:
    """Encodes and decodes texts; chunks that can't merge with one another are encoded once and kept.

    The cache is emptied at `most` chunks. Where chunks can merge, texts are encoded whole and nothing is kept.
    The library's threads stay off: every core of an executor has such a process, and they cost CPU time while they wait.
    """

    CHUNK = regex.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
    #: So many new chunks of a BPE model are encoded as one text.
    JOINED = 64

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.most, self.cache = PieceModel(path), most, {}
        self.line = self.model.byte_ids.get(ord("\n")) if self.model.apart and self.model.kind != UNIGRAM else None
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.values = np.array(self.model.bytes, object)
        self.numbers = [i.to_bytes(4, "little") for i in range(len(self.model.pieces))]

    def chunks(self, form: str) -> list[str]:
        """A normalised text in chunks: line ends one by one, runs of marks with what follows them."""
        if not self.model.apart:
            return [form] if form else []
        out = []
        for i, line in enumerate(form.split("\n")):
            if i:
                out.append("\n")
            if MARK + MARK in line or line.endswith(MARK):
                out += self.CHUNK.findall(line)
            elif line:
                words = line.replace(MARK, " " + MARK).split(" ") if self.model.escape else self.CHUNK.findall(line)
                out += words if words[0] else words[1:]
        return out

    def new_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, as chunks() cuts them: none is empty or has a line end among other letters.

        A text for each chunk costs more than its merges, so a BPE model gets many in one, and their ids are parted at those
        of the line ends in between, which nothing merges with. Scores of a unigram model would add up to other roundings.
        """
        if self.line is None:
            return [b"".join([self.numbers[i] for i in ids]) for ids in self.model.ids(chunks)]
        plain = [x for x in chunks if x != "\n"]
        out = []
        for ids in self.model.ids(["\n".join(plain[i : i + self.JOINED]) for i in range(0, len(plain), self.JOINED)]):
            ids = np.array(ids, "<u4")
            ends, whole = (np.flatnonzero(ids == self.line) * 4).tolist(), ids.tobytes()
            out += [whole[a:z] for a, z in zip([0, *[x + 4 for x in ends]], [*ends, len(whole)], strict=True)]
        if len(plain) < len(chunks):
            out.insert(chunks.index("\n"), self.numbers[self.line])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        return self.encode_forms([self.model.normalised(x) for x in texts])

    def encode_forms(self, forms: list[str]) -> list[bytes]:
        """The same for texts that are normalised already."""
        parts = [self.chunks(x) for x in forms]
        cache = self.cache
        if len(cache) > self.most or not self.model.apart:
            cache.clear()
        new = list(set(chain.from_iterable(parts)).difference(cache))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            cache.update(zip(some, self.new_ids(some), strict=True))
        return [b"".join(map(cache.__getitem__, x)) for x in parts]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; the blank that encoding puts in front is taken off again."""
        out = b"".join(self.values[np.frombuffer(ids, "<u4")].tolist())
        return out[1:] if self.model.prefix and out[:1] == b" " else out

    def text(self, ids: Sequence[int]) -> str:
        """The text of any ids, as the SentencePiece library decodes them; ids must be numbers of pieces.

        Control pieces have no text, unknown ones UNKNOWN_TEXT. Bytes that make no UTF-8 character give U+FFFD each.
        The mark in front that encoding adds is taken off; where blanks are squeezed, those of all leading pieces that are a mark alone.
        """
        model, out, fresh = self.model, [[]], True
        for i in ids:
            kind = model.types[i]
            if kind == CONTROL:
                out.append([])  # bytes on both sides of it make no character together
                continue
            piece = UNKNOWN_TEXT.encode() if kind == UNKNOWN else model.bytes[i]
            if fresh and kind != BYTE and kind != UNKNOWN and (model.prefix or model.squeeze) and model.pieces[i].startswith(MARK):
                piece = piece[1:]
                fresh = model.squeeze and not piece
            elif piece:
                fresh = False
            out[-1].append(piece)
        return "".join(b"".join(x).decode("utf-8", "tessera_each_byte") for x in out)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, ids (array, only with_ids), n_tokens, ids_crc32, parity, round_trip.

    parity: the ids are those of the SentencePiece library for the whole text. round_trip: decoding gives the
    normalised text again. Null text counts as empty and has no ids. Ids may be null or repeat. Other
    columns aren't read. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches):
            texts = [x.decode("utf-8", "replace") for x in raw(part.column("text"))]
            normal = [enc.model.normalised(x) for x in texts]
            ids = enc.encode_forms(normal)
            peers = enc.peer.encode(texts, num_threads=1)
            same = [array("I", p).tobytes() == x for p, x in zip(peers, ids, strict=True)]
            forms = [x.replace(MARK, " ")[enc.model.prefix :].encode() for x in normal]
            trip = [enc.decode(x) == y for x, y in zip(ids, forms, strict=True)]
            cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same), pa.array(trip)]
            names = ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, parity boolean, round_trip boolean" + (", ids array<int>" if with_ids else ""))


def decode_pieces(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text (of the ids), parity (the SentencePiece library decodes them to the same).

    Null arrays count as empty and have empty text; null ids are left out, numbers that no piece has count as unknown.
    Ids of rows may be null or repeat. Other columns aren't read. An empty table gives no rows.
    """
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<bigint>").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        size, unknown = len(enc.model.pieces), enc.model.unknown
        for part in batches:
            ids = [[i if 0 <= i < size else unknown for i in x or () if i is not None] for x in part.column("ids").to_pylist()]
            texts = [enc.text(x) for x in ids]
            same = [x == y for x, y in zip(texts, enc.peer.decode(ids) if ids else [], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "text", "parity"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, text string, parity boolean")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, held against the SentencePiece library, and decoded."""
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
