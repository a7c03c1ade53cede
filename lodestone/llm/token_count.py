"""Token counts by the whole-token shortcut.

The tokenizer is a sentencepiece BPE model whose text form puts a mark for every space, plus one
at the start. If no piece of the vocabulary has a mark after another character, no merge can
cross from a word to the next one's mark, so a text's count is the sum over its space-delimited
pre-tokens. That is proved from the vocabulary when a model is loaded, as is the shortcut: the
vocabulary strings that encode alone as one token count 1 without merging. All other pre-tokens
are merged by the library, once for each different one in a task's memory.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import inner, packed, parts, row_udf, table, unpacked

MARK = "▁"
#: A single space between other characters: there a text's pre-tokens can be cut in two.
BORDER = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
#: Counts of different pre-tokens that a Python worker keeps; beyond that it starts over.
CACHED_WORDS = 400_000


class PreTokenCounts(dict):
    """Tokens by pre-token, filled as pre-tokens come up. The key is the pre-token without its first mark."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("pre-tokens are only proved independent for models that leave the text as it is, with a mark in front")
        pieces = [p.piece for p in spec.pieces]
        if any(MARK in p.lstrip(MARK) for p in pieces) or any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("a piece goes from one word into the next")
        spoken = [p.piece[1:].replace(MARK, " ") for p in spec.pieces if p.type == p.NORMAL and p.piece.startswith(MARK)]
        spoken = [s for s in spoken if s]
        self.proved = {s for s, ids in zip(spoken, self.model.encode(spoken), strict=True) if len(ids) == 1}
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.proved, 1))

    def learn(self, words: set[str]) -> None:
        """Merge the pre-tokens that are not known yet, all at once."""
        new = [w for w in words if w not in self]
        # The library puts no mark before an empty text, but a lone mark is a token.
        self.update((w, len(ids) if w else 1) for w, ids in zip(new, self.model.encode(new, num_threads=1), strict=True))

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        out = [0] * len(texts)
        group: list[tuple[int, list[str]]] = []
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            for part in parts(text, BORDER):
                group.append((i, pre_tokens(part)))
                fresh.update(group[-1][1])
                if len(fresh) > CACHED_WORDS // 4 or len(part) < len(text):
                    self._flush(out, group, fresh)
                    group, fresh = [], set()
        self._flush(out, group, fresh)
        return out

    def _flush(self, out: list[int], group: list[tuple[int, list[str]]], fresh: set[str]) -> None:
        if len(self) > CACHED_WORDS:
            self.restart()
        self.learn(fresh)
        for i, row in group:
            out[i] += sum(map(self.__getitem__, row))


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first mark. Of k spaces, k - 1 start the next one."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for word in words:
        if word:
            out.append(" " * spaces + word)
            spaces = 0
        else:
            spaces += 1
    return out + [" " * (spaces - 1)] if spaces else out


@lru_cache(1)
def counts_of(model: str) -> PreTokenCounts:
    return PreTokenCounts(resolve(model))


def resolve(name: str) -> str:
    """A path as it is; a bare file name among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def n_tokens(text: Column, model: str) -> Column:
    """Tokens of a text (null: 0) under ``model``."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(counts_of(model).count_batch(texts.to_pylist()), pa.int64())

    return row_udf(count, "long")(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens; long texts are counted in pieces. Rows are judged one by one, so repeated rows
    and null ids matter to nothing; columns of the input with the three names are replaced.
    """
    text = F.col(inner(docs, text_col))
    out = packed(docs, text_col, text_col).withColumn("n", n_tokens(text, model))
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return unpacked(out, docs.columns, n_bytes=n_bytes, n_tokens=F.col("n"), over_limit=F.col("n") > limit)


def op6_token_counts(spark, sf_dir):
    """Token counts of every document."""
    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
