"""BPE encoding and decoding by speculate and verify.

A word's tokens are proposed by greedy longest match. A sequence of tokens is what merging
would give exactly if every token alone, and every adjacent pair, is what merging its own
string gives; both are checked for all new words of a batch at once, on arrays. Only words
that fail are merged step by step.

Texts go through chunks between ASCII white space, which no token crosses: each different
chunk is normalised, split into words and encoded once, and kept in the worker's memory.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import inner, packed, parts, row_udf, table, unpacked
from lodestone.llm.token_count import resolve

#: Different chunks that a Python worker keeps; beyond that it starts over.
CACHED_CHUNKS = 100_000
#: White space, at which a text's chunks can be cut in two.
BORDER = re.compile("[ \t\n\x0b\x0c\r]")
#: Stands for the end-of-word suffix in proposals; no byte letter.
END = "\ue000"
NONE = np.iinfo(np.int64).max


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


def lower(text: str) -> str:
    """Lower case of each character by itself: a final sigma is not special."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class WordBpe:
    """A BPE vocabulary with an end-of-word suffix, read from a tokenizers file.

    The file must normalise by NFC, white space and lower case, split by a pattern whose
    matches stay, and map bytes to letters; others are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]], [p["type"] for p in split]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or split[0]["behavior"] != "Removed" or not split[0]["invert"] or model["dropout"] or model["unk_token"]:
            raise ValueError("this tokenizer's normalizer, pre-tokenizer or model isn't supported")
        # Chunks are split many at once, with a line feed between, which no word holds.
        self.words = regex.compile(split[0]["pattern"]["Regex"] + "|\n")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.end = model["end_of_word_suffix"] or ""
        self.letters = dict(enumerate(byte_letters())) | {10: "\n"}
        self.vocab: dict[str, int] = model["vocab"]
        # For proposals the suffix is one letter. Every letter is a token, so leftmost-longest
        # matching leaves no gap, but perhaps the suffix alone; such a word fails.
        self.longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.vocab.items():
            stem = t.removesuffix(self.end) if self.end else t
            self.longest.add_word(stem + END * (stem != t), i)
        self.longest.make_automaton()
        # The library's model merges words that fail; it takes words in byte letters.
        self.exact = tokenizers.Tokenizer.from_file(path).model
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = strings_of(path)
        self.size = size
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[a + b]))
        self.split = {t: (a, b, r) for (a, b), (r, t) in reversed(self.rank.items())}
        codes = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(codes)
        self.merge_codes, self.merge_ranks = codes[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.right, self.left = self._edges(1), self._edges(0)
        #: -1 unknown, else whether merging the token's string gives the token.
        self.alone = np.full(size, -1, np.int8)
        self.chunks: dict[str, bytes] = {}

    def _edges(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token, the tokens that stood at one of its edges while it was merged, from itself to a
        letter, and the rank at which the next merge took each away; padded with -1."""
        chains: list[list[tuple[int, int]]] = []
        for t in range(self.size):
            chain = [(t, NONE)]
            while chain[-1][0] in self.split:
                split = self.split[chain[-1][0]]
                chain.append((split[side], split[2]))
            chains.append(chain)
        tokens = np.full((self.size, max(map(len, chains))), -1, np.int64)
        until = np.full_like(tokens, -1)
        for t, chain in enumerate(chains):
            tokens[t, : len(chain)], until[t, : len(chain)] = zip(*chain, strict=True)
        return tokens, until

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of tokens stay apart: no merge across their border comes before what each side
        merges there itself. Of equal merges the leftmost goes first, so the left side wins a tie."""
        (left_token, left_until), (right_token, right_until) = self.right, self.left
        apart = np.ones(len(a), bool)
        for i in range(left_token.shape[1]):
            own = np.flatnonzero(left_token[a, i] >= 0)
            if not len(own):
                break
            for j in range(right_token.shape[1]):
                own = own[right_token[b[own], j] >= 0]
                if not len(own):
                    break
                codes = left_token[a[own], i] * self.size + right_token[b[own], j]
                at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
                rank = np.where(self.merge_codes[at] == codes, self.merge_ranks[at], NONE)
                apart[own[(rank < left_until[a[own], i]) & (rank < NONE) & (rank <= right_until[b[own], j])]] = False
        return apart

    def symbols(self, string: str) -> list[int]:
        """The single letters of a vocabulary string; the last one carries the suffix if the string has it."""
        if self.end and string.endswith(self.end):
            body = string[: -len(self.end)]
            return [self.vocab[c] for c in body[:-1]] + [self.vocab[body[-1] + self.end]]
        return [self.vocab[c] for c in string]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        ids = list(ids)
        while len(ids) > 1:
            best = min((self.rank.get(p, (NONE, 0))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == NONE:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def _verify(self, flat: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
        """Which words are right as proposed: every token alone, and every adjacent pair of a word, must stand."""
        for t in np.unique(flat[self.alone[flat] < 0]).tolist():
            self.alone[t] = self.merge(self.symbols(self.strings[t])) == [t]
        inside = np.flatnonzero(word[1:] == word[:-1])
        codes, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        right = np.ones(n_words, bool)
        right[word[self.alone[flat] == 0]] = False
        right[word[inside[~self.compatible(*np.divmod(codes, self.size))[which]]]] = False
        return right

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids, as 32-bit integers, of different words in byte letters, none of them empty."""
        if not words:
            return []
        found = np.fromiter(chain.from_iterable(self.longest.iter_long(END.join(words) + END)), np.int64).reshape(-1, 2)
        ends, flat = found[:, 0], found[:, 1]
        stops = np.cumsum([len(w) + 1 for w in words])
        word = np.searchsorted(stops, ends, side="right")
        right = self._verify(flat, word, len(words))
        cuts = np.searchsorted(word, np.arange(len(words) + 1))
        # The last token must reach the suffix.
        right &= ends[np.maximum(cuts[1:] - 1, 0)] == stops - 1
        raw, at = flat.astype("<u4").tobytes(), (cuts * 4).tolist()
        out = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.flatnonzero(~right).tolist():
            out[i] = as_bytes([t.id for t in self.exact.tokenize(words[i])])
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not known yet."""
        chunks = [c for c in chunks if c not in self.chunks]
        if not chunks:
            return
        # Most chunks are a word of plain letters; the others are normalised and split.
        plain = [c for c in chunks if c.isascii() and c.isalpha()]
        odd = [c for c in chunks if not (c.isascii() and c.isalpha())]
        found = self.words.findall(lower(unicodedata.normalize("NFC", "\n".join(odd)))) if odd else []
        lowered = [c.lower() for c in plain]
        words = dict.fromkeys(lowered)
        words.update(dict.fromkeys(found))
        words.pop("\n", None)
        lettered = "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n") if words else []
        ids = dict(zip(words, self.encode_words(lettered), strict=True)) | {"\n": None}
        self.chunks.update(zip(plain, map(ids.__getitem__, lowered), strict=True))
        own: list[bytes] = []
        rest = iter(odd)
        for item in map(ids.__getitem__, found):
            if item is None:
                self.chunks[next(rest)] = b"".join(own)
                own = []
            else:
                own.append(item)
        if odd:
            self.chunks[next(rest)] = b"".join(own)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        fresh: set[str] = set()
        for i, text in enumerate(texts):
            for piece in parts(text, BORDER):
                cut = self.cut.split(piece) if self.cut and any(s in piece for s in self.special) else [piece]
                row: list[str] = []
                for k, part in enumerate(cut):
                    # Special strings are tokens of their own; None marks the next item as one.
                    if k % 2:
                        row += [None, part]
                    else:
                        row += split_ascii(part)
                group.append((i, row))
                fresh.update(row)
                if len(fresh) > CACHED_CHUNKS // 4 or len(piece) < len(text):
                    self._flush(out, group, fresh)
                    group, fresh = [], set()
        self._flush(out, group, fresh)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _flush(self, out: list[list[bytes]], group: list[tuple[int, list[str]]], fresh: set[str]) -> None:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
        fresh.discard(None)
        self.learn(fresh)
        for i, row in group:
            if None in row:
                items, made = iter(row), []
                for item in items:
                    made.append(as_bytes([self.special[next(items)]]) if item is None else self.chunks[item])
                out[i].append(b"".join(made))
            else:
                out[i].append(b"".join(map(self.chunks.__getitem__, row)))


def split_ascii(text: str) -> list[str]:
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


@lru_cache(1)
def bpe_of(path: str) -> WordBpe:
    made = WordBpe(resolve(path))
    # The tables stay for the worker's life; the collector needn't walk them again and again.
    gc.collect()
    gc.freeze()
    return made


@lru_cache(1)
def strings_of(path: str) -> list[str]:
    """The string of each token id."""
    with open(resolve(path), encoding="utf-8") as f:
        spec = json.load(f)
    found = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
    return [found.get(i, "") for i in range(max(found) + 1)]


@lru_cache(1)
def string_array(path: str) -> pa.StringArray:
    return pa.array(strings_of(path), pa.string())


def join_tokens(strings: pa.StringArray, ids: pa.ListArray) -> pa.Array:
    """The tokens' strings with a space between: what the file, which names no decoder, stands for."""
    tokens = strings.take(ids.flatten())
    ends = np.cumsum([0, *pc.list_value_length(ids).to_pylist()])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")


def _id_lists(raw: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the token ids of the whole text, without special tokens added.

    Null and empty texts have no ids; long texts are encoded in pieces cut at white space. Rows are
    encoded one by one, so repeated rows and null ids matter to nothing; a column of the input
    named ``ids_col`` is replaced.
    """

    def encoded(texts: pa.Array) -> pa.Array:
        return _id_lists(bpe_of(tokenizer).encode_batch(texts.to_pylist()))

    text = F.coalesce(F.col(inner(docs, text_col)), F.lit(""))
    return unpacked(packed(docs, text_col, text_col).withColumn("encoded", row_udf(encoded, "array<int>")(text)), docs.columns, **{ids_col: F.col("encoded")})


def decode(rows: DataFrame, tokenizer: str = "word_bpe_49k.json", ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col``: the text of ``ids_col``, special tokens included. Null and empty ids give the empty text."""

    def decoded(ids: pa.Array) -> pa.Array:
        return join_tokens(string_array(tokenizer), ids)

    return rows.withColumn(text_col, row_udf(decoded, "string")(F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text_col: str = "text", ids_col: str = "ids", digest_col: str = "ids_sha256", decoded_col: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids in one pass, so that a task has one Python worker.

    ``digest_col``: SHA-256 of the ids as little-endian unsigned 32-bit integers. Odd rows as in
    :func:`encode`; columns of the input with the three names are replaced.
    """

    def both(texts: pa.Array) -> pa.Array:
        raw = bpe_of(tokenizer).encode_batch(texts.to_pylist())
        ids = _id_lists(raw)
        digests = pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())
        return pa.StructArray.from_arrays([ids, digests, join_tokens(string_array(tokenizer), ids)], names=["ids", "digest", "decoded"])

    text = F.coalesce(F.col(inner(docs, text_col)), F.lit(""))
    out = packed(docs, text_col, text_col).withColumn("made", row_udf(both, "ids array<int>, digest string, decoded string")(text))
    return unpacked(out, docs.columns, **{ids_col: F.col("made.ids"), digest_col: F.col("made.digest"), decoded_col: F.col("made.decoded")})


def op2_bpe(spark, sf_dir):
    """Every document encoded and decoded."""
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
