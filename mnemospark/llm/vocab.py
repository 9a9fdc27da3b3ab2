"""Tokenizers by the path of their vocabulary file; loaded once in a worker, never trained."""

from __future__ import annotations

import base64
import functools
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Regex, Tokenizer, decoders
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from mnemospark.llm.bulk import BulkEncoder, byte_characters

#: Fixed value: the pattern that cuts a text into pieces before byte-level merges (published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def from_json(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # a special token's string in a text is ordinary text
    return tokenizer


@functools.lru_cache(4)
def greatest_id(path: str) -> int:
    return max(from_json(path).get_vocab().values())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def from_ranks(ranks: dict[bytes, int]) -> Tokenizer:
    """A byte-level BPE of the tokenizers library that merges as the ranks say.

    Every way to put a token together from two tokens is a merge of that token's rank, and a piece that is
    itself a token stays whole.
    """
    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                merges.append((rank, left, right, name[token[:k]], name[token[k:]]))
    merges.sort()
    tokenizer = Tokenizer(BPE({name[t]: r for t, r in ranks.items()}, [m[3:] for m in merges], ignore_merges=True))
    tokenizer.pre_tokenizer = Sequence([Split(Regex(PATTERN), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer


@functools.lru_cache(4)
def json_encoder(path: str, drops_space: bool) -> BulkEncoder:
    return BulkEncoder(from_json(path), drops_space)


@functools.lru_cache(2)
def rank_encoder(path: str) -> tuple[BulkEncoder, list[bytes]]:
    """The encoder, and each id's bytes."""
    ranks = read_ranks(path)
    table = [b""] * (1 + max(ranks.values(), default=-1))
    for token, rank in ranks.items():
        table[rank] = token
    return BulkEncoder(from_ranks(ranks), False), table
