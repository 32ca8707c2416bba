"""Public tokenizer files: read once on the driver, carried to tasks, built once per worker."""

from __future__ import annotations

import base64
import os

import tiktoken
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from tokenizers import Tokenizer

TOKENIZERS = "/opt/tokenizers"
#: A vocabulary is broadcast; larger files than this are refused.
MAX_BYTES = 16 << 20
# Fixed value: the public byte-level pre-tokenisation pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_built: dict = {}


def broadcast_file(context: SparkContext, name: str, folder: str = TOKENIZERS) -> Broadcast:
    """Broadcast a vocabulary file of the driver, so that executors need no copy of their own."""
    path = os.path.join(folder, name)
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError(f"{path} is larger than {MAX_BYTES} bytes")
    with open(path, "rb") as f:
        return context.broadcast(f.read())


def tiktoken_encoding(file: Broadcast) -> tiktoken.Encoding:
    """The encoding of a broadcast ``.tiktoken`` file."""
    key = ("tiktoken", hash(file.value))
    if key not in _built:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.value.splitlines())}
        _built[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _built[key]


def json_tokenizer(file: Broadcast) -> Tokenizer:
    """The tokenizer of a broadcast ``.json`` file, without truncation or padding; offsets are untrimmed."""
    key = ("json", hash(file.value))
    if key not in _built:
        tokenizer = Tokenizer.from_buffer(file.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _built[key] = tokenizer
    return _built[key]
