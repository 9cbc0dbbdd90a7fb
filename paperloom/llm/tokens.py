"""Token ids of texts by a public byte-level BPE vocabulary file, and flat token files.

The vocabulary comes from a ``tokenizers`` JSON file whose path is a parameter. The ids are
those that the library's ``encode(text, add_special_tokens=False)`` gives: the string of an
added token, wherever it stands in a text, is that token. Merges run in ``tiktoken`` with
the ids as ranks, which gives the same ids (tests compare them) several times faster.
"""

from __future__ import annotations

import functools
import json

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(4)
def encoder(path: str):
    """The encoder, and the added tokens by their strings."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: int(t["id"]) for t in spec.get("added_tokens", ())}
    if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take in their neighbourhood are not known here")
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), frozenset(added)


def encode(path: str, text: str | None) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    code, added = encoder(path)
    plain = not any(x in text for x in added)
    return np.array(code.encode_ordinary(text) if plain else code.encode(text, allowed_special="all"), np.uint32)


def largest_id(path: str) -> int:
    return encoder(path)[0].max_token_value


def qualified(spark, path: str) -> str:
    """The path with its file system's scheme, as Python file systems want it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = str(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString())
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file:///") else out


def store(uri: str):
    """A Python file system of a folder's URI, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
