"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by the model's compiled character map: at each place the longest key of the map that fits gives way to
its value, and every byte of the normalised text remembers the byte of the original that it came from. The pieces that the
model cuts the normalised text into are then projected back: each has its span of bytes in the original.

Where the model allows it, a text is cut before its spaces, as no piece reaches across such a place. A batch's distinct units
are normalised, encoded and projected once each, and laid out by their places.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import named, table, text_batches
from lodestack.llm.tokens import as_list, laid_out, lists

MODEL = "piece_bpe_32k.model"
#: Units of one generation that a worker remembers, and the longest of them in characters.
KNOWN_UNITS, KNOWN_CHARS = 100_000, 64
SPACE, MARK = b" ", "▁".encode()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
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
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a model: a double-array trie of byte strings whose leaves point to their values."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.trie = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]

    @staticmethod
    def step(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def value(self, leaf: int) -> bytes:
        at = leaf & 0x7FFFFFFF
        return self.values[at : self.values.index(0, at)]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest key that data has at this place, and its value."""
        if not self.trie:
            return None
        found, node = None, self.step(self.trie[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.trie) or (unit := self.trie[node]) & 0x800000FF != data[i]:
                break
            node ^= self.step(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.trie[node]
        return found and (found[0], self.value(found[1]))

    def items(self) -> Iterator[tuple[bytes, bytes]]:
        """All keys with their values."""
        trie, labels = np.array(self.trie, np.int64), np.arange(1, 256)
        waiting = [(b"", self.step(self.trie[0]))] if self.trie else []
        while waiting:
            key, node = waiting.pop()
            places = node ^ labels
            real = places < len(trie)
            for label in labels[real][trie[places[real]] & 0x800000FF == labels[real]].tolist():
                unit = self.trie[node ^ label]
                inner = node ^ label ^ self.step(unit)
                if unit >> 8 & 1:
                    yield key + bytes([label]), self.value(self.trie[inner])
                waiting.append((key + bytes([label]), inner))


def width(lead: int) -> int:
    """Bytes of the UTF-8 character that starts with this one; 1 for a byte that starts none."""
    return 1 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceModel:
    """A model file: the library's processor, and what projecting its pieces needs to know of it."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces, trainer, spec = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                spec |= dict(fields(value))
        #: The format's defaults of what the message leaves out, and its numbers of kinds of pieces.
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        kinds = np.array([p.get(3, 1) for p in pieces])
        unknown, own, byte = 2, 4, 6
        self.map = CharacterMap(spec.get(2, b""))
        texts = [p[1] for p in pieces]
        self.sizes = [len(t) for t in texts]
        self.bytes = {i: int(texts[i][3:5], 16) for i in np.flatnonzero(kinds == byte).tolist()}
        self.unknown = set(np.flatnonzero(kinds == unknown).tolist())
        self.end = self.processor.eos_id()
        #: Sizes of the pieces that are as long as the text they stand for, with 0 for the others.
        self.direct = np.array([0 if k in (unknown, byte) else len(t) for k, t in zip(kinds.tolist(), texts, strict=True)], np.int32)
        #: Bytes after which a space may begin a unit: the normalised text before it is sure to end in no space there.
        keys = list(self.map.items())
        self.after = np.ones(256, bool)
        self.after[[SPACE[0], MARK[-1], *(k[-1] for k, v in keys if not v or v.endswith((SPACE, MARK)))]] = False
        whole = self.squeeze or self.suffix or not self.escape or (kinds == own).any() or any(SPACE in k for k, _ in keys)
        if whole or any("▁" in t.decode().lstrip("▁") for t in texts):
            self.after[:] = False

    def normalise(self, data: bytes, prefix: bool = True) -> tuple[bytes, list[int]]:
        """data normalised, and for each of its bytes (and its end) the byte of data that it came from.

        Every byte of a value is put down to the first byte of its key. prefix says whether data begins a text.
        """
        out, origin, at = bytearray(), [], 0
        space = MARK if self.escape else SPACE

        def following() -> tuple[int, bytes]:
            return self.map.longest(data, at) or (n := width(data[at]), data[at : at + n])

        if self.squeeze:
            while at < len(data) and (step := following())[1] == SPACE:
                at += step[0]
        if at == len(data):
            return b"", [at]
        if prefix and self.prefix and not self.suffix:
            out += space
            origin += [at] * len(space)
        if not self.map.trie and not self.squeeze:  # all bytes but spaces stand for themselves
            out += data.replace(SPACE, space)
            origin += range(len(data)) if SPACE not in data else (i for i, c in enumerate(data) for _ in range(len(space) if c == SPACE[0] else 1))
            at = len(data)
        after_space = self.squeeze
        while at < len(data):
            size, value = following()
            if after_space:
                value = value.lstrip(SPACE)
            if value:
                after_space = self.squeeze and value.endswith(SPACE)
                value = value.replace(SPACE, space)
                out += value
                origin += [at] * len(value)
            at += size
        if self.squeeze:
            while out.endswith(space):
                at = origin[len(out) - len(space)]
                del out[-len(space) :], origin[-len(space) :]
        if prefix and self.prefix and self.suffix:
            out += space
            origin += [at] * len(space)
        return bytes(out), [*origin, at]

    def project(self, unit: str, ids: list[int], first: bool) -> tuple[bytes, bytes, bytes]:
        """The ids of a unit with the starts and ends of their spans in its bytes, all as 32-bit integers.

        A character that is spelled in bytes has its whole span at the last of them; the others have empty ones, as in the library.
        """
        if not ids:
            return b"", b"", b""
        plain, origin = self.normalise(unit.encode("utf-8", "surrogatepass"), first)
        if self.unknown.isdisjoint(ids):
            sizes = [self.sizes[i] for i in ids]
        else:  # an unknown piece is as long as the text it stands for
            sizes = [len(p.piece.encode()) for p in self.processor.encode(unit if first or not self.prefix else unit[1:], return_type="proto").pieces]
        starts, ends, at, left = [], [], 0, 0
        for i, size in zip(ids, sizes, strict=True):
            starts.append(origin[at])
            if i in self.bytes:
                left = (left or width(plain[at])) - 1
                at += 0 if left else width(plain[at])
            else:
                at += size
            ends.append(origin[at])
        if at != len(plain):
            raise ValueError("pieces don't cover the normalised text")
        return np.array(ids, "<i4").tobytes(), np.array(starts, "<i4").tobytes(), np.array(ends, "<i4").tobytes()


    def project_all(self, units: list[str], found: list[list[int]], first: bool) -> list[tuple[bytes, bytes, bytes]]:
        """project() of many units. Without a map, spans are running sums where a unit has no space but its first and no bytes."""
        if self.map.trie or self.squeeze or not self.prefix or not self.escape or not units:
            return [self.project(u, ids, first) for u, ids in zip(units, found, strict=True)]
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        sizes = self.direct[ids]
        stops = np.cumsum(counts)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ends = (ends[1:] - np.repeat(ends[stops - counts], counts) - len(MARK) + (0 if first else len(SPACE))).astype(np.int32)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int32) if len(ends) else ends
        starts[(stops - counts)[counts > 0]] = 0
        odd = np.concatenate(([0], np.cumsum(sizes == 0)))
        odd = (odd[stops] > odd[stops - counts]).tolist()
        data = [x.tobytes() for x in (ids, starts, ends)]
        return [
            self.project(u, own, first) if bad or " " in (u if first else u[1:]) else (data[0][a:b], data[1][a:b], data[2][a:b])
            for u, own, bad, a, b in zip(units, found, odd, (4 * (stops - counts)).tolist(), (4 * stops).tolist(), strict=True)
        ]


class PieceEncoder:
    """Encodes and decodes batches of texts. The memory of units has two generations: the younger, once full, becomes the older."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[tuple[str, bool], tuple[bytes, bytes, bytes]] = {}
        self.older: dict[tuple[str, bool], tuple[bytes, bytes, bytes]] = {}

    def units(self, units: list[str], first: bool) -> list[tuple[bytes, bytes, bytes]]:
        """Ids and spans of distinct units; first ones begin a text, the others begin with a space that stands for the prefix."""
        found = [self.known.get((u, first)) or self.older.get((u, first)) for u in units]
        gaps = [i for i, x in enumerate(found) if x is None]
        texts = [units[i] if first or not self.model.prefix else units[i][1:] for i in gaps]
        for i, x in zip(gaps, self.model.project_all([units[i] for i in gaps], self.model.processor.encode(texts, num_threads=1), first), strict=True):
            found[i] = x
        self.known.update({(u, first): x for u, x in zip(units, found, strict=True) if len(u) <= KNOWN_CHARS})
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends of all pieces, each text closed by the end id, and where each text's start (and the last's end)."""
        if len(self.known) > KNOWN_UNITS:
            self.older, self.known = self.known, {}
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == SPACE[0]) & self.model.after[data[:-1]]
        cut[: bounds[0]] = False
        real = bounds[1:] > bounds[:-1]
        cut[bounds[1:][real] - 1] = False  # a last space alone is no text that the library encodes
        begins = bounds[:-1][real]
        cut[begins] = True
        places = np.flatnonzero(cut)
        first = np.zeros(len(data), bool)
        first[begins] = True
        first = first[places]
        coded = pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(np.append(places, bounds[-1]).astype(np.int64)), texts.buffers()[2] or pa.py_buffer(b"")]).dictionary_encode()
        index, words = coded.indices.to_numpy(), as_list(coded.dictionary)
        # A row of the table for each distinct unit that begins a text, each distinct other one, and the end of a text.
        row, rows = np.zeros((2, len(words)), np.int64), []
        for kind in (False, True):
            used = np.zeros(len(words), bool)
            used[index[first == kind]] = True
            used = np.flatnonzero(used)
            row[int(kind), used] = np.arange(len(used)) + len(rows)
            rows += self.units([words[i] for i in used.tolist()], kind)
        nothing = np.zeros(1, "<i4").tobytes()
        rows.append((np.array([self.model.end], "<i4").tobytes(), nothing, nothing))
        counts = np.searchsorted(places, bounds)  # units before each text's first byte
        order = np.insert(row[first.astype(np.int64), index], counts[1:], len(rows) - 1)
        text_of = np.repeat(np.arange(len(texts)), np.diff(counts) + 1)
        base = np.insert(places, counts[1:], bounds[1:]) - bounds[text_of]
        (ids, ends_of), (starts, _), (ends, _) = (laid_out(lists([r[k] for r in rows]), order) for k in range(3))
        base = np.repeat(base, np.diff(ends_of)).astype(np.int32)
        return ids, starts + base, ends + base, ends_of[np.concatenate(([0], np.cumsum(np.diff(counts) + 1)))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids between neighbouring bounds, as the library decodes it."""
        flat, bounds = ids.tolist(), bounds.tolist()
        return self.model.processor.decode([flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], num_threads=1)


@cache
def encoder(name: str) -> PieceEncoder:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return PieceEncoder(PieceModel(file.read()))


PIECES = "ids array<int>, starts array<int>, ends array<int>"


def encode_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, decoded: bool = False) -> DataFrame:
    """(key, ids, starts, ends) of every row of docs, and decoded, the ids' text, if asked for.

    ids are those of the whole text with an end id; starts and ends are each piece's span of bytes in the text (the end id's is
    empty, at the end). Null texts count as empty and have the end id alone; an empty table gives an empty result; rows that
    repeat are each answered; further columns are not read, whatever their names. A text is held whole by its task, with some
    hundred bytes of memory for each of its own.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            worker = encoder(model)
            ids, starts, ends, bounds = worker.encode(batch.column(1))
            offsets = pa.array(bounds, pa.int32())
            out = [batch.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, starts, ends))]
            if decoded:
                out.append(pa.array(worker.decode(ids, bounds), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["key", "ids", "starts", "ends", "decoded"][: len(out)])

    picked = named(docs, key, text)
    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, {PIECES}" + ", decoded string" * decoded).withColumnRenamed("key", key)


def decode_pieces(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) of every row of rows: the text that the library decodes from the row's ids; of a null list a null text.

    Ids outside the vocabulary, and nulls in a list, fail the job.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            column = batch.column(1)
            bounds = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            texts = pa.array(encoder(model).decode(column.flatten().to_numpy(zero_copy_only=False), bounds), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(column.is_valid(), texts, None)], names=["key", "text"])

    picked = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, f"key {picked.schema[0].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def op13_sentencepiece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_pieces(table(spark, sf_dir, "documents"), decoded=True)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
