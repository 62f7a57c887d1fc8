"""Encoders of public tokenizer files; the files' places are parameters."""

from __future__ import annotations

import base64
import hashlib
import os
import re

#: Text outside these code points, or with a special token, goes to the slower library itself.
_PLAIN = re.compile("[^\\t-\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u017f\\u2013-\\u201e]")

_loaded: dict[str, object] = {}


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    with open(path, "rb") as f:
        body = f.read()
    lib = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(path)[1], "tiktoken")
    return hashlib.sha256(lib.encode() + b"\0" + hashlib.sha256(body).digest()).hexdigest()


class Counter:
    """Token counts as the file's own library gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.counts = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


class Ids:
    """Ids as the .json file's library gives them.

    Where a file of the same vocabulary as ranks lies beside it, texts of code points on which both
    libraries split alike, and without special strings, take the faster library; others don't.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        twin = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(twin):
            import public_tokenizers
            import tiktoken

            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast and not _PLAIN.search(text) and not (self.special and self.special.search(text)):
            return self.fast(text)
        return self.own.encode(text, add_special_tokens=False).ids


def load(kind: type, path: str):
    """One encoder per worker process."""
    key = f"{kind.__name__}:{path}"
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]
