"""BPE encoding and decoding by prefix-sharing trie traversal.

A prefix's encoding is fixed by its last token: it is the encoding of what stands before that token,
and then the token. The last token of a prefix is the one among the vocabulary's tokens that end there
which may follow the last token of the prefix before it, that is, the pair of both encodes to itself.
So the distinct words of a batch go into a trie, whose nodes are prefixes; a depth-first walk hands
each node the last tokens of its ancestors, and a prefix that many words share is worked out once.
Words sorted by their bytes are visited in that order, and the path's states are a stack.

The walk runs in Arrow batches on the executors; a worker keeps the first ``CACHED_WORDS`` words that it has encoded,
from task to task, and others for a batch only, so its memory is bounded.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import regex
from pyspark.sql import Column, DataFrame, SparkSession

from .scratch import bound_batches

#: Words whose encodings a worker keeps.
CACHED_WORDS = 200_000
#: Pairs of tokens of which a worker keeps whether they encode to themselves.
CACHED_PAIRS = 300_000
#: Texts whose tokens are handed over at once, and characters whose words are encoded at once.
HANDED, AT_ONCE = 256, 1_000_000
#: Longer words are encoded but not kept.
CACHED_LENGTH = 64
NEVER = 1 << 60
OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
# Fixed value: the byte-level split into words of this vocabulary. Words of letters come first: no other kind begins as they do.
WORD = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of these characters only: printable Latin ones up to U+024F, in which letters are ranges, and common dashes and quotes.
_LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_TEXT = f"[\\t\\n\\r\\x20-\\x7e{_LATIN}\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*"
LATIN_WORD = rf" ?[{_LATIN}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class State:
    """Where a walk over bytes is in the tokens: the tokens (length, id) that end here, longest first, and known next states by byte."""

    __slots__ = ("ending", "next", "suffix")

    def __init__(self, suffix: bytes, ending: list[tuple[int, int]]) -> None:
        self.suffix, self.ending = suffix, ending
        self.next: dict[int, State] = {}


class Vocabulary:
    """A byte-level BPE vocabulary: tokens as bytes, merge ranks, special tokens."""

    def __init__(self, text: str) -> None:
        """text: the JSON of a tokenizer file with a ByteLevel pre-tokenizer and a BPE model without options."""
        told = json.loads(text)
        model, letters = told["model"], _byte_letters()
        if told.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or told["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("this kind of tokenizer file is not supported")
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.follows: dict[tuple[int, int], bool] = {}
        #: Of a token that is made by merging its own bytes: the two tokens merged last, and their rank.
        self.parts: dict[int, tuple[int, int, int]] = {}
        #: Tokens that merges don't make from their own bytes never stand in an encoding.
        self.made = {b: i for b, i in self.ids.items() if len(b) == 1 or self._makes(b, i)}
        #: Bytes that some token begins with; a state is the longest of them that a prefix ends with, and tells the tokens there.
        self.begins = {b[:i] for b in self.made for i in range(1, len(b) + 1)}
        self.states: dict[bytes, State] = {}
        self.root = State(b"", [])
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})

    def _makes(self, token: bytes, i: int) -> bool:
        """Whether merging a token's bytes makes it: the pair of least rank is merged, leftmost first, again and again."""
        out = [self.ids[token[k : k + 1]] for k in range(len(token))]
        while len(out) > 1:
            rank, at = min((self.merges.get(p, (NEVER, 0))[0], k) for k, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == NEVER:
                return False
            pair = out[at], out[at + 1]
            out[at : at + 2] = [self.merges[pair][1]]
        self.parts[i] = *pair, rank
        return out == [i]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at a token's left (0) or right (1) end while it is made, from a byte to itself, each with the rank at which it is merged on."""
        edge = self.edges[side].get(token)
        if edge is None:
            edge, at = [(token, NEVER)], token
            while at in self.parts:
                part = self.parts[at]
                at = part[side]
                edge.append((at, part[2]))
            edge.reverse()
            self.edges[side][token] = edge
        return edge

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the pair of tokens encodes to itself: no merge across their border ever comes before those within them.

        At each moment one token stands at each side of the border. Of equal ranks the merge further left comes first.
        """
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= CACHED_PAIRS:
                self.follows.clear()
            a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
            while True:
                (x, until_x), (y, until_y) = a[i], b[j]
                across = self.merges.get((x, y))
                if across is not None and across[0] < until_x and across[0] <= until_y:
                    known = False
                    break
                if until_x == until_y == NEVER:
                    known = True
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            self.follows[left, right] = known
        return known

    def _step(self, state: State, byte: int) -> State:
        """The state after a byte; states are made when first met, as many as the tokens have beginnings at most."""
        suffix = state.suffix + bytes((byte,))
        while suffix not in self.begins:
            suffix = suffix[1:]
        found = self.states.get(suffix)
        if found is None:
            ending = [(len(suffix) - i, self.made[suffix[i:]]) for i in range(len(suffix)) if suffix[i:] in self.made]
            found = self.states[suffix] = State(suffix, ending)
        state.next[byte] = found
        return found

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word with its token ids, in the order of a depth-first walk over the words' trie."""
        follows, may_follow, step = self.follows, self.may_follow, self._step
        last: list[int] = []  # of each prefix on the path: its last token,
        size: list[int] = []  # that token's length,
        states = [self.root]  # and, of the empty one too, the state
        before = b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            del last[shared:], size[shared:], states[shared + 1 :]
            state = states[-1]
            for byte in word[shared:]:
                state = state.next.get(byte) or step(state, byte)
                end = len(states)
                for n, token in state.ending:  # one only may follow; long ones are likelier
                    if n == end:
                        break
                    pair = last[end - n - 1], token
                    known = follows.get(pair)
                    if may_follow(*pair) if known is None else known:
                        break
                states.append(state)
                last.append(token)
                size.append(n)
            ids, at = [], len(word)
            while at:
                ids.append(last[at - 1])
                at -= size[at - 1]
            ids.reverse()
            before = word
            yield word, ids


class Encoder:
    """Encodes and decodes texts with a vocabulary, keeping words that it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.words: dict[str, str] = {}  # word to ids in decimal, joined by commas
        self.bytes = {str(i): b for i, b in vocabulary.bytes.items()}
        self.any_word, self.latin_word, self.latin = regex.compile(WORD).findall, re.compile(LATIN_WORD).findall, re.compile(LATIN_TEXT).fullmatch

    def find(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        return self.latin_word(text) if self.latin(text) else self.any_word(text)

    def _parts(self, text: str) -> list[list[str]]:
        """Words between special tokens; a special token is a part of its own, in a list of two with a mark."""
        v = self.vocabulary
        if v.specials is None or not any(s in text for s in v.special):
            return [self.find(text)]
        parts: list[list[str]] = []
        at = 0
        for m in v.specials.finditer(text):
            parts += [self.find(text[at : m.start()]), ["", m[0]]]
            at = m.end()
        return [*parts, self.find(text[at:])]

    def learn(self, words: set[str]) -> dict[str, str]:
        """Encodes the words that aren't known; returns those that are not kept."""
        known = self.words
        new = [w.encode("utf-8", "surrogatepass") for w in words.difference(known)]
        extra: dict[str, str] = {}
        for word, ids in self.vocabulary.encode_words(new):
            key = word.decode("utf-8", "surrogatepass")
            (known if len(key) <= CACHED_LENGTH and len(known) < CACHED_WORDS else extra)[key] = ",".join(map(str, ids))
        return extra

    def decoded(self, ids: str) -> str:
        """The text of ids in decimal joined by commas; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
        for ids, n in self.encoded(texts):
            yield n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(self.decoded(ids).encode("utf-8")).hexdigest()

    def encoded(self, texts: list[str]) -> Iterator[tuple[str, int]]:
        """For each text: ids in decimal joined by commas, and their number."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[str, int]]:
        split = [self._parts(t) for t in texts]
        extra = self.learn(set().union(*(words for parts in split for words in parts if not (len(words) == 2 and not words[0]))))
        known, special = self.words, self.vocabulary.special
        for parts in split:
            ids = []
            for words in parts:
                if len(words) == 2 and not words[0]:
                    ids.append(str(special[words[1]]))
                elif words:
                    ids.append(",".join([known.get(w) or extra[w] for w in words] if extra else map(known.__getitem__, words)))
            joined = ",".join(ids)
            yield joined, joined.count(",") + 1 if joined else 0


_kept: dict[str, Encoder] = {}


def _encoder(digest: str, text: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    if digest not in _kept:
        _kept.clear()
        _kept[digest] = Encoder(Vocabulary(text))
    return _kept[digest]


def _pieces(parts: Iterator[pd.Series]) -> Iterator[list[str]]:
    """The texts of Arrow batches in smaller lists, so that no batch's tokens are held together."""
    for part in parts:
        texts = part.tolist()
        for i in range(0, len(texts), HANDED):
            yield texts[i : i + HANDED]


def tokenizer_path() -> str:
    """Where the production vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _broadcast(spark: SparkSession, path: str | None) -> tuple[str, object]:
    """The vocabulary file's text (1.5 MB, fixed) for the executors."""
    bound_batches(spark)
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        text = f.read()
    return hashlib.md5(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)


def token_digests(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """A struct of ``OUT`` for a text column; null and empty texts have no tokens and decode to the empty text."""
    digest, held = _broadcast(spark, path)

    @F.pandas_udf(OUT)
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(digest, held.value)
        for piece in _pieces(parts):
            yield pd.DataFrame(list(encoder.digests(piece)), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def encode(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """Token ids of a text column, as an array; null and empty texts have none."""
    digest, held = _broadcast(spark, path)

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(digest, held.value)
        for piece in _pieces(parts):
            yield pd.Series([[int(i) for i in x.split(",")] if x else [] for x, _ in encoder.encoded(piece)], dtype=object)

    return ids(text)


def tokenized(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """A struct of ids (array), n_tokens and decoded_sha256 for a text column; null and empty texts have no tokens."""
    digest, held = _broadcast(spark, path)

    @F.pandas_udf("ids array<int>, n_tokens long, decoded_sha256 string")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(digest, held.value)
        for piece in _pieces(parts):
            yield pd.DataFrame(
                [(np.fromstring(ids, dtype=np.int32, sep=","), n, hashlib.sha256(encoder.decoded(ids).encode("utf-8")).hexdigest()) for ids, n in encoder.encoded(piece)],
                columns=["ids", "n_tokens", "decoded_sha256"],
            )

    return tokens(text)


def decode(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """Text of an array of token ids (null: null), special ones included; bytes that are not UTF-8 become U+FFFD. Unknown ids raise."""
    digest, held = _broadcast(spark, path)

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _encoder(digest, held.value).vocabulary.bytes
        for part in parts:
            yield pd.Series([None if x is None else b"".join(table[int(i)] for i in x).decode("utf-8", "replace") for x in part], dtype=object)

    return texts(ids)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of ``documents``, one row per row; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", token_digests(spark, F.col("text")).alias("t")).select("doc_id", "t.*")
