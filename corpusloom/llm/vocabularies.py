"""Token ids from the files of public tokenizers; the path is the caller's."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of many strings: ``.json`` (tokenizers), ``.model`` (sentencepiece), ``.tiktoken`` (ranks)."""
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return lambda texts: [encoding.encode_ordinary(text) for text in texts]


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> frozenset[int]:
    """Ids that stand for a single byte the vocabulary has no piece for; none but in ``.model`` files."""
    if not path.endswith(".model"):
        return frozenset()
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return frozenset(i for i in range(model.get_piece_size()) if model.is_byte(i))
