"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

Each byte string of the vocabulary becomes a piece of printable characters (one
for each byte), its score the negative rank; normalisation is the identity and
white space is left alone. A pre-token, byte-mapped, is then encoded by
sentencepiece's best-score merges, which are the lowest-rank merges. A pre-token
that is itself an entry is that entry. Ids decode by the inverse mapping.

Defined results: null and empty texts have no ids and decode to nothing; extra
columns are ignored; repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from tallyforge.llm.common import chunks, tidy

#: Pre-tokens whose ids one task remembers; beyond that it forgets all and goes on.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 prints one, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each rank of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for word, rank in pairs:
        out[int(rank)] = base64.b64decode(word)
    return out


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary; piece i is entry i, and the unknown piece comes last."""
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.unk_id = len(vocabulary)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    shown = byte_characters()
    for rank, word in enumerate(vocabulary):
        model.pieces.add(piece="".join(shown[b] for b in word), score=-float(rank))
    model.pieces.add(piece="<unk>", score=-float(len(vocabulary)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    return model.SerializeToString()


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.vocabulary))
        self.whole = {word: rank for rank, word in enumerate(self.vocabulary)}
        self.shown = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.known: dict[str, tuple[int, ...]] = {}

    def _ids(self, pretoken: str) -> tuple[int, ...]:
        raw = pretoken.encode()
        if (rank := self.whole.get(raw)) is not None:
            return (rank,)
        return tuple(self.model.encode(raw.decode("latin-1").translate(self.shown)))

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for pretoken in self.split(text):
            ids = known.get(pretoken)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self._ids(pretoken)
                if len(pretoken) < 64:
                    known[pretoken] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        vocabulary = self.vocabulary
        return b"".join([vocabulary[i] for i in ids])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text's ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in chunks(batches, "text"):
            ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            raw = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (of the decoded bytes)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in chunks(batches, "text"):
            n, of_ids, of_raw = [], [], []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                of_raw.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
