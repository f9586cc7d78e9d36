"""Encoding of a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised directly from the vocabulary: every byte sequence becomes a
piece of byte-mapped characters, its score is the negative rank, and normalisation is the identity.
Merging the best-scored adjacent pair is then the same as merging the pair of lowest rank. Texts are
cut into pre-tokens by the vocabulary's pattern, each pre-token is encoded by the model, and ids
decode by the inverse mapping. The model (a function of the vocabulary alone, about 1 MB) is sent to
the executors once; texts stream through Arrow batches and never leave their partition.

Defined results: null and empty texts have no ids (an empty list, zero tokens); blank, garbled and
very long texts are encoded whole; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = os.environ.get("METHYLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that cuts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OFFSET = 0x100  # byte b is the character 0x100 + b: no white space, no control characters
_BYTES = {b: chr(_OFFSET + b) for b in range(256)}
_CACHED_CHARS, _CACHED_PIECES = 48, 400_000  # what a worker remembers; it forgets, never skips


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens by id from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ids of ``tokens``; the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=token.decode("latin-1").translate(_BYTES), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=-float(len(tokens)), type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Encoder(dict):
    """Pre-token to ids; holds what it has encoded, and encodes what is missing."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        super().__init__()
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self._model.encode(piece.encode("utf-8").decode("latin-1").translate(_BYTES)))
        if len(piece) <= _CACHED_CHARS:
            if len(self) >= _CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, self._find(text))) if text else iter(())


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _schema(df: DataFrame, keep: list[str], extra: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), extra])


def encode(df: DataFrame, text: str, keep: list[str], out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the ids of ``text`` as a list of integers."""
    model = df.sparkSession.sparkContext.broadcast(serialise(read_vocabulary(vocabulary)))

    def run(batches):
        encoder = _encoder(model.value)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for value in batch.column(len(keep)):
                ids.extend(encoder.encode(value.as_py()))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists], names=[*keep, out])

    return df.select(*(f"`{c}`" for c in keep), f"`{text}`").mapInArrow(run, _schema(df, keep, f"`{out}` array<int>"))


def count_tokens(df: DataFrame, text: str, keep: list[str], out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the number of ids of ``text``."""
    model = df.sparkSession.sparkContext.broadcast(serialise(read_vocabulary(vocabulary)))

    def run(batches):
        encoder = _encoder(model.value)
        for batch in batches:
            sizes = [sum(1 for _ in encoder.encode(value.as_py())) for value in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, out])

    return df.select(*(f"`{c}`" for c in keep), f"`{text}`").mapInArrow(run, _schema(df, keep, f"`{out}` long"))


def decode(df: DataFrame, ids: str, keep: list[str], out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and the text of ``ids``: the inverse of ``encode`` (null and empty texts come back empty)."""
    tokens = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches):
        token = tokens.value.__getitem__
        for batch in batches:
            texts = [b"".join(map(token, x.as_py() or ())).decode("utf-8", "replace") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, out])

    return df.select(*(f"`{c}`" for c in keep), f"`{ids}`").mapInArrow(run, _schema(df, keep, f"`{out}` string"))
