"""SentencePiece encoding that keeps every piece's place in the original bytes, and decoding.

Text is normalised by longest prefix through the model's compiled character map, noting for each
normalised byte the source byte it came from. Pieces tile the normalised text, so each projects
straight to a span of original bytes. Where no piece of the vocabulary reaches across a space or a
line end, those are safe places to cut the normalised text: each distinct chunk is then encoded once per
worker and kept in a bounded cache, and a text is the concatenation of its chunks. Other models encode
whole texts. The spans come from the normaliser's alignment either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import WordCache

MARK = "▁"  # stands for a space
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")


class CharsMap:
    """The compiled character map: a double-array trie of prefixes, then their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix of data[at:]."""
        units, best = self.units, None
        if not units:
            return None
        node = self._child(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                best = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return best and (best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])])

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    """Longest-prefix normalisation with source alignment, by a model's normaliser settings."""

    def __init__(self, spec):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    @property
    def identity(self) -> bool:
        return not self.map.units and not self.squeeze and self.escape and self.prefix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and per normalised byte (and its end) the source byte it starts at."""
        data, at = text.encode(), 0
        if self.identity:  # a map without prefixes leaves every byte in its place; only spaces are rewritten
            put = MARK * bool(data)
            width = np.where(np.frombuffer(data, np.uint8) == 0x20, len(MARK.encode()), 1)
            return put + text.replace(" ", MARK), np.concatenate([np.zeros(len(put.encode()), np.int32), np.repeat(np.arange(len(data), dtype=np.int32), width), np.array([len(data)], np.int32)])
        parts: list[tuple[bytes, int, int]] = []  # replacement, source start, source end
        while at < len(data):
            found = self.map.longest(data, at)
            n, to = found or (self._char(data[at]), b"")
            parts.append((to if found else data[at : at + n], at, at + n))
            at += n
        if self.squeeze:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
            while parts and parts[-1][0].strip(b" ") == b"":
                parts.pop()
        space = MARK.encode() if self.escape else b" "
        out, align = [], []
        if self.prefix and parts:
            out.append(space)
            align += [parts[0][1]] * len(space)
        after_space, end = self.squeeze, 0
        for to, start, end in parts:
            if self.squeeze and after_space:
                to = to.lstrip(b" ")
            if to:
                after_space = to.endswith(b" ")
                to = to.replace(b" ", space)
                out.append(to)
                align += [start] * len(to)
        return b"".join(out).decode(), np.array([*align, end], np.int32)

    @staticmethod
    def _char(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceCodec:
    """Encodes texts to ids and source spans with a model file; one per worker."""

    def __init__(self, model_path: str, cache: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model_path, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.normalise = Normaliser(proto.normalizer_spec)
        pieces = [p.piece for p in proto.pieces]
        self.cuttable = self.normalise.identity and proto.trainer_spec.byte_fallback and not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces) and not any(p.type == 4 for p in proto.pieces)
        self.sizes = np.array([1 if proto.trainer_spec.byte_fallback and BYTE_PIECE.fullmatch(p) else len(p.encode()) for p in pieces], np.int32)
        self.chunks = WordCache(self._chunk, cache)

    def _chunk(self, chunk: str) -> np.ndarray:
        """Ids of a chunk. A line end before it keeps the prefix mark off; both are taken away again."""
        return np.array(self.processor.encode("\n" + chunk.replace(MARK, " "))[2:], np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the start and end of each piece in the UTF-8 bytes of the text."""
        if not text:
            none = np.empty(0, np.int32)
            return none, none, none
        normal, align = self.normalise(text)
        if self.cuttable:
            ids = np.concatenate(list(map(self.chunks.__getitem__, CHUNK.findall(normal))))
            sizes = self.sizes[ids]
        else:
            ids, names = np.array(self.processor.encode(text), np.int32), self.processor.encode(text, out_type=str)
            sizes = [1 if BYTE_PIECE.fullmatch(p) and self.processor.is_byte(i) else len(p.encode()) for i, p in zip(ids.tolist(), names, strict=True)]
        ends = np.cumsum(sizes)
        return ids, align[np.concatenate([[0], ends[:-1]])] if len(ids) else align[:0], align[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


def encode_pieces(docs: DataFrame, model_path: str, batch_rows: int = 500) -> DataFrame:
    """doc_id, ids, starts, ends (array<int>; source bytes of each piece) and decoded (decode(ids)).

    Null and empty texts have no pieces and decode to "". One row per row, repeated or not; a null
    doc_id is kept; other columns are ignored. Work is by row: no shuffle, nothing kept between rows
    but the bounded chunk cache.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path)

        def lists(values: list[np.ndarray], offsets: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), pa.int32()))

        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                found = [codec.encode(x.as_py() or "") for x in batch.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in found])])
                decoded = pa.array([codec.decode(x[0]) if len(x[0]) else "" for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(lists([x[k] for x in found], offsets) for k in range(3)), decoded], names=["doc_id", "ids", "starts", "ends", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>, decoded string")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of ids; a null or empty list gives ""."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([processor.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def piece_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and source_bytes (the end of the last span)."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("source_bytes"),
    )
