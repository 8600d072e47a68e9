"""Encoding of whole texts with a public byte-level BPE vocabulary, by a sentencepiece model made from it.

The vocabulary file's path is a parameter; no tokenizer is trained. The pieces are the vocabulary's byte-mapped
tokens, scored by negative rank, with identity normalisation: sentencepiece then merges the pair of the lowest rank
first, as byte-level BPE does. Texts are cut into pre-tokens by the vocabulary's pattern, and each distinct
pre-token is encoded once per worker.

Defined results: null and empty texts give an empty list; special tokens are ordinary text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie, and the one of this project.
TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: The published pattern of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens a worker remembers before it starts anew.
REMEMBER = 500_000


def byte_map() -> list[str]:
    """The letter that stands for each byte: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def sentencepiece_model(vocabulary_path: str) -> bytes:
    """A serialised sentencepiece BPE model whose ids are those of the vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(vocabulary_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = dict(spec["model"]["vocab"])
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    model = pb.ModelProto()
    for piece, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
        if piece in special:
            continue
        if rank != len(model.pieces):
            raise ValueError("the vocabulary's ids are not consecutive")
        model.pieces.add(piece=piece, score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = model.trainer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(model.pieces), len(model.pieces) - 1, -1, -1, -1
    n = model.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Encoder:
    """Encodes and decodes by a serialised model; remembers the ids of pre-tokens."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        letters = byte_map()
        self.letters = {b: c for b, c in enumerate(letters)}
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBER:
            self.known = {}
        new = [*{x for p in parts for x in p if x not in self.known}]
        mapped = [x.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for x in new]
        self.known.update(zip(new, self.sp.encode(mapped, num_threads=1) if mapped else []))
        known = self.known
        return [[i for x in p for i in known[x]] for p in parts]

    def decode(self, ids: list[int]) -> str:
        return bytes(self.bytes[c] for i in ids for c in self.sp.id_to_piece(int(i))).decode("utf-8")


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _model(spark: SparkSession, path: str | None):
    """The model as a broadcast; its size is that of the vocabulary, whatever the corpus."""
    return spark.sparkContext.broadcast(sentencepiece_model(path or os.path.join(TOKENIZERS, VOCABULARY)))


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """The list of token ids of a text."""
    model = _model(spark, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model.value)
        for s in batches:
            yield pd.Series(encoder.encode(s.tolist()), dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """The number of tokens of a text."""
    model = _model(spark, path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model.value)
        for s in batches:
            yield pd.Series([len(x) for x in encoder.encode(s.tolist())], dtype="int64")

    return count(F.coalesce(text, F.lit("")))
