"""Packing documents into fixed-length token sequences by first-fit decreasing.

Documents are tokenised where they lie, cut at multiples of the sequence length, and only the pieces'
sizes and checksums are shuffled. Documents are dealt at random (by a hash of their place) into groups of
bounded expected size; each group is packed on its own by first-fit decreasing, where a tournament tree
over the bins' free room finds the first bin that fits in log time. Full pieces take a sequence each in
any group, so a document of any length is no burden to its group.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewall.llm.common import FEW_BYTES, WordCache, kept_by_worker, release_memory, slices, stored, trim_memory

PIECES = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


class BinTree:
    """A tournament tree over bins' free room: each node holds the largest room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1
        while self.size < bins:
            self.size *= 2
        self.tree = [room] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with room for `need`, which is taken from it."""
        tree, k = self.tree, 1
        while k < self.size:
            k *= 2
            if tree[k] < need:
                k += 1
        at = k - self.size
        tree[k] -= need
        k //= 2
        while k:
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k //= 2
        return at


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each item; items are taken by falling length, ties in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, used = BinTree(max(1, len(lengths)), room), [0] * max(1, len(lengths))
    for i in order.tolist():
        need = int(lengths[i])
        at = tree.place(need)
        bins[i], offsets[i] = at, used[at]
        used[at] += need
    return bins, offsets


#: Bytes of texts that are encoded together.
TOGETHER = FEW_BYTES
#: ASCII marks: one class to the rules below, which never split a run of them.
MARKS = b".,!?;:%*#$&|"
DOT_ABOVE = "\u0307"
#: Words of a to z and of Latin-1's lower-case letters stay as they are and in one piece under the rules below.
plain_letters = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Byte-level vocabularies write a byte as the character of its number; these, not to be printed, as one from 256 on.
HIDDEN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: The rules of word vocabularies whose words can be encoded one by one: composition, white space as one
#: space, lower case; then runs of letters, single digits and runs of anything else, never across white space.
NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_by_word(tokenizer) -> bool:
    """Whether a tokenizer's rules are those above, so that a text's ids are its words' ids in a row."""
    rules = json.loads(tokenizer.to_str())
    normal, splits = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    steps = splits.get("pretokenizers", [])
    by_pattern = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"] == {"Regex": WORD_PATTERN} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    bytewise = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    specials = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["normalized"] and not re.search(r"\s", t["content"]) for t in rules["added_tokens"])
    return tuple(normal.get("normalizers", ())) == NORMALISERS and by_pattern and bytewise and specials


class WordEncoder:
    """A text's ids, as bytes of 32-bit numbers; caches of bounded size keep words' ids for the tasks of a stage.

    A word of letters with marks after it is put together from the two, so that all such words with one
    core are encoded once; the tokenizer itself is asked whether it cuts the marks off that core. Plain letters
    are one piece, which goes to the tokenizer's model at once. Where the tokenizer's rules are not those above,
    whole texts are encoded.
    """

    def __init__(self, tokenizer_path: str, cache: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.by_word = encodes_by_word(self.tokenizer)
        self.parts = WordCache(self._part, cache)
        self.firm = WordCache(self._cuts_marks, cache // 8)
        self.words = WordCache(self._word, cache // 2)

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: bytes) -> bytes:
        if plain_letters(part):
            return array("I", [t.id for t in self.model.tokenize(part.decode("latin-1").translate(HIDDEN))]).tobytes()
        return self.encoded(part.decode())

    def _cuts_marks(self, core: bytes) -> bool:
        if plain_letters(core):
            return True
        text = core.decode()
        if not text.isalpha():
            return False
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text + ","))
        return pieces[-1][0] == ","

    def _word(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if core and len(core) < len(word) and (core.isalpha() if core.isascii() else self.firm[core]):
            return self.parts[core] + self.parts[word[len(core) :]]
        return self.parts[word]

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of many texts, null as an empty one; each distinct word of them is looked up once."""
        if not self.by_word:
            return [self.encoded(t or "") for t in texts.to_pylist()]
        texts = pc.fill_null(texts, "")
        # special tokens are not lowered, and I with a dot composes first
        as_is = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, DOT_ABOVE))
        words = pc.ascii_split_whitespace(pc.if_else(as_is, texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        ids = pa.array(map(self.words.__getitem__, map(str.encode, coded.dictionary.to_pylist())), pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, np.int64, len(ids) + 1)[words.offsets.to_numpy()].tolist() if places else [0] * (len(texts) + 1)
        return [data[a:b].to_pybytes() if a < b else b"" for a, b in itertools.pairwise(ends)]

    def __call__(self, text: str) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0]


@kept_by_worker
def _encoder(tokenizer_path: str, cache: int) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(tokenizer_path, cache)


def token_pieces(docs: DataFrame, tokenizer_path: str, groups: int = 1, seed: int = 17, end_id: int = 1, room: int = 2048, cache: int = 300_000) -> DataFrame:
    """Every document's token ids plus `end_id`, cut at multiples of `room`: one row per piece, with its group.

    Null and empty texts are the end id alone. Groups are drawn by a hash of the row's place in the table,
    so that rows that repeat are spread too: one draw for a document's last piece, the one with room left,
    and one for each full piece. A stored table has one order, so a task that runs again draws the same.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(keep=_encoder)
        encode, schema, seen = _encoder(tokenizer_path, cache), None, 0
        task = TaskContext.get().partitionId()
        for batch in slices(batches, 1, TOGETHER):
            rows, starts, lengths, sums, totals, dealt = [], [], [], [], [], []
            for i, ids in enumerate(encode.texts(batch.column(1))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, room):
                    piece = ids[4 * start : 4 * (start + room)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(n)
                    dealt.append(xxhash.xxh3_64_intdigest(b"%d %d %d" % (task, seen + i, start), seed) % groups)
            seen += batch.num_rows
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            columns = [keys, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, dealt))]
            schema = schema or pa.schema([pa.field("doc_id", keys.type), *(pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "_group"))])
            trim_memory()
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES.format(kind=kind) + ", _group long")


def pack_pieces(pieces: DataFrame, room: int = 2048) -> DataFrame:
    """Adds sequence_id and offset: each group is packed on its own."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), room)
        return group.drop(columns="_group").assign(sequence_id=(group["_group"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets)

    return pieces.groupBy("_group").applyInPandas(pack, PIECES.format(kind=kind) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, room: int = 2048, group_pieces: int = 8192, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A group is expected to hold at most group_pieces pieces: a text has at most a piece for each `room`
    bytes, and one more. Rows that repeat are packed each on their own; a null doc_id is a document like
    any other; an empty table gives no rows; other columns are ignored. Sequence ids are unique but not
    consecutive. The pieces' sizes are stored while the frame is built, so that texts go to Python a few MB at a time.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    groups = max(1, -(-(n + size // room) // group_pieces))
    pieces = stored(token_pieces(docs, tokenizer_path, groups, seed, end_id, room), "pieces", batch_bytes=TOGETHER)
    return pack_pieces(pieces, room)
