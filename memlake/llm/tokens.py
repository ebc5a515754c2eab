"""Encoding of the whole corpus with a public tokenizer, and decoding.

Texts travel as Arrow batches. A byte-level tokenizer works on each pre-token by itself, so a batch is split into pre-tokens
and the tokenizers library encodes only those that the worker hasn't met lately, each once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.batches import small

FOLDER = "/opt/tokenizers"
#: Pre-tokens that a worker remembers; beyond that it starts afresh.
REMEMBERED = 1 << 17
# The public pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # strings that look like special tokens are ordinary text
    return found


@lru_cache(maxsize=4)
def byte_level(path: str) -> bool:
    """Whether a file of the tokenizers library is a byte-level BPE that pre-tokenises by PATTERN and changes nothing before."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


def _require_byte_level(path: str) -> None:
    if not path.endswith(".json") or not byte_level(path):
        raise ValueError(f"{path} is no byte-level BPE with the pre-tokens of this module: its ids have no place in the text's bytes")


@lru_cache(maxsize=4)
def _whole(path: str):  # noqa: ANN202
    """A function from texts to lists of ids, for files whose texts are encoded as a whole."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        found = SentencePieceProcessor(model_file=path)
        return lambda texts: found.encode(texts, num_threads=1)
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts]
    return lambda texts: [e.ids for e in _tokenizer(path).encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=1)
def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others, in order, for the characters from 256 on.
    """
    own = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    t, table = _tokenizer(path), byte_characters()
    added = t.get_added_tokens_decoder()
    return [added[i].content.encode() if i in added else bytes(table[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]


_met: dict[str, dict[str, list[int]]] = {}


def _pieces(path: str, pieces: list[list[str]]) -> dict[str, list[int]]:
    """ids of all pre-tokens of a batch."""
    met = _met.setdefault(path, {})
    new = list(set(chain.from_iterable(pieces)).difference(met))
    if len(met) + len(new) > REMEMBERED:
        met.clear()
        new = list(set(chain.from_iterable(pieces)))
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        for piece, found in zip(part, _tokenizer(path).encode_batch(part, add_special_tokens=False)):
            met[piece] = found.ids
    return met


def _split(texts: list[str]) -> list[list[str]]:
    import regex

    find = regex.compile(PATTERN).findall
    return [find(t) for t in texts]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """(key, ids) of every row: the ids of the whole text, without special tokens.

    A null text and an empty one have no ids, an empty list. Repeated rows are encoded each; other columns don't matter.
    `tokenizer` is a file of the tokenizers library (.json), of tiktoken's ranks (.tiktoken) or of sentencepiece (.model). For a byte-level BPE
    that pre-tokenises by PATTERN each different pre-token is encoded once; all others encode whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = tokenizer.endswith(".json") and byte_level(tokenizer)
        for batch in small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if once:
                pieces = _split(texts)
                met = _pieces(tokenizer, pieces)
                ids = [list(chain.from_iterable(map(met.__getitem__, p))) for p in pieces]
            else:
                ids = [x if t else [] for t, x in zip(texts, _whole(tokenizer)(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def encode_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """(key, ids, byte_starts, char_starts): where each token begins in the text's UTF-8 bytes and among its characters.

    A token that begins inside a character has that character's place. Nulls and empty texts have empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _require_byte_level(tokenizer)
        size = [len(b) for b in _token_bytes(tokenizer)]
        for batch in small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            pieces = _split(texts)
            met = _pieces(tokenizer, pieces)
            ids, starts, chars = [], [], []
            for t, p in zip(texts, pieces):
                own = list(chain.from_iterable(map(met.__getitem__, p)))
                at = np.cumsum([0, *(size[i] for i in own)])[: len(own)]
                lead = (np.frombuffer(t.encode(), np.uint8) & 0xC0) != 0x80  # bytes that begin a character
                ids.append(own)
                starts.append(at)
                chars.append((np.cumsum(lead) - 1)[at] if len(own) else at)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, kind), pa.array([a.astype(np.int32) for a in starts], kind), pa.array([c.astype(np.int32) for c in chars], kind)], names=["key", "ids", "byte_starts", "char_starts"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, byte_starts array<int>, char_starts array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = f"{FOLDER}/byte_bpe_50k.json") -> DataFrame:
    """(key, text) of lists of ids; characters that tokens split are put together again, incomplete ones become U+FFFD.

    Null ids give a null text, empty ones an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _require_byte_level(tokenizer)
        table = _token_bytes(tokenizer)
        for batch in small(batches):
            texts = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
