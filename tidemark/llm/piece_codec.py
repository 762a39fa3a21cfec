"""SentencePiece (BPE) encoding through a table of each prefix's last token, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

MARK = "▁"
NORMAL, BYTE = 1, 6
# What a Python worker remembers at most, some 100 MB; further units are encoded each time.
CACHED_UNITS = 250_000
CACHED_LENGTH = 64
CACHED_PAIRS = 400_000


class Remembered(dict):
    """What ``make`` gives for short keys, remembered up to a bounded number."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < CACHED_UNITS and len(key) <= CACHED_LENGTH:
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one model file of merge type.

    The last token of a prefix is unique: among the pieces that end there it is the
    one that merging leaves next to the last token of what precedes it. Pieces come
    from an automaton over the vocabulary, and two tokens are neighbours in an
    encoding if merging their joined text gives them back.
    """

    def __init__(self, model: bytes):
        spec = model_pb.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or norm.precompiled_charsmap:
            raise ValueError("a model of merge type without text normalisation is needed")
        if norm.remove_extra_whitespaces or not norm.escape_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("white space must be kept and escaped, with bytes for unknown characters")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in spec.pieces]
        self.size = [len(p) for p in self.pieces]
        if len(self.pieces) > 1 << 16:
            raise ValueError("at most 65,536 pieces")
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.end = spec.trainer_spec.eos_id
        self.surface = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.surface |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, self.ids[piece])
        self.automaton.make_automaton()
        # No merge crosses the left edge of a mark after another character if no
        # piece does; nor the edges of a line end that is in no longer piece.
        long = [p for p in self.ids if len(p) > 1]
        end = "" if any("\n" in p for p in long) else "\n"
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in long)
        inner = f"{MARK}+[^{MARK}{end}]*|[^{MARK}{end}]+"
        self.unit = re.compile("(?s).+" if whole else f"{end}|{inner}" if end else inner)
        self.splits = bool(end) and not whole and bool(self.prefix)
        self.units, self.words = Remembered(self.unit_ids), Remembered(self.word_ids)
        blob = [self.surface.get(i, b"") for i in range(len(self.pieces))]
        self.blob = np.frombuffer(b"".join(blob) + b"\0", np.uint8)
        self.width = np.array([len(b) for b in blob], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Merge characters by score, the leftmost of equal ones first, until no piece is left to form."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, token: int) -> str:
        return self.pieces[token] if token >= 0 else chr(-token - 1)

    def compatible(self, left: int | None, right: int) -> bool:
        """Whether merging the texts of two tokens, or of a single one, gives them back."""
        parts = [self._text(t) for t in (left, right) if t is not None]
        return self.merge("".join(parts)) == parts

    def tokens(self, unit: str) -> list[int]:
        """Fill the table of last tokens from left to right, then walk it backwards.

        Tokens are piece ids; a character that is no piece is -1 - its code point.
        """
        last: list[int] = []
        size, pairs = self.size, self.pairs
        for at, token in self.automaton.iter(unit):
            while len(last) < at:
                last.append(-1 - ord(unit[len(last)]))
            if len(last) > at:
                continue
            start = at + 1 - size[token]
            key = last[start - 1] << 16 | token if start else token - (1 << 60)
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) >= CACHED_PAIRS:
                    pairs.clear()
                fits = pairs[key] = self.compatible(last[start - 1] if start else None, token)
            if fits:
                last.append(token)
        while len(last) < len(unit):
            last.append(-1 - ord(unit[len(last)]))
        found, at = [], len(unit) - 1
        while at >= 0:
            token = last[at]
            found.append(token)
            at -= size[token] if token >= 0 else 1
        return found[::-1]

    def unit_ids(self, unit: str) -> bytes:
        """The ids of a stretch of text that no merge leaves, as 32-bit numbers."""
        out: list[int] = []
        for token in self.tokens(unit):
            out += [token] if token >= 0 else [self.bytes[b] for b in chr(-token - 1).encode()]
        return np.array(out, np.int32).tobytes()

    def word_ids(self, word: str) -> bytes:
        if word[:1] == "\n":
            return self.unit_ids("\n") + (self.unit_ids(word[1:]) if len(word) > 1 else b"")
        return self.unit_ids(MARK + word)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, the end id last."""
        end = np.array([self.end], np.int32).tobytes()
        if not text:
            parts = []
        elif self.splits and "  " not in text and text[0] != " " and MARK not in text:
            # With single blanks every blank begins a unit, and so does a line end.
            known = self.words
            parts = [known[word] for word in text.replace("\n", " \n").split(" ")]
        else:
            known = self.units
            parts = [known[unit] for unit in self.unit.findall(self.prefix + text.replace(" ", MARK))]
        parts.append(end)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of some runs of ids, given where each ends."""
        width = self.width[ids]
        to = np.cumsum(width)
        data = self.blob[np.arange(width.sum()) + np.repeat(self.place[ids] - to + width, width)].tobytes()
        cuts = np.concatenate([[0], to])[ends].tolist()
        texts = [data[a:b] for a, b in zip([0, *cuts], cuts)]
        # The mark before the text is not part of it.
        return [t.removeprefix(b" " if self.prefix else b"").decode("utf-8", "replace") for t in texts]

    def decode(self, ids) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(1)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def encode_decode(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (array of int, the end id last) and ``decoded`` to the documents.

    ``model`` is the content of a model file (about 0.5 MB, which bounds the broadcast). Whole
    texts are encoded, without a shuffle; null counts as empty and gives the end id
    alone and an empty text. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                found = [codec.encode(text.as_py() or "") for text in part.column(part.num_columns - 1)]
                ends = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                decoded = codec.decode_all(flat, ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array(decoded, pa.string()),
                    ],
                    [*part.schema.names[:-1], "ids", "decoded"],
                )

    kept = docs.select(*[docs[c] for c in docs.columns if c not in ("ids", "decoded")])
    held = kept.select(F.struct(*kept.columns).alias("row"), docs[text_col].cast("string").alias("text"))
    coded = held.mapInArrow(run, f"row {kept.schema.simpleString()}, ids array<int>, decoded string")
    return coded.select("row.*", "ids", "decoded")


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def model_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
