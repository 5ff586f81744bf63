"""SentencePiece encoding and decoding (models of the merge type) by a table of each prefix's last token.

Merging takes the adjacent pair whose joint piece has the best score, the leftmost of equals, until none is left. No merge
crosses the border between two tokens of the result, so the encoding of a prefix that ends with a token is the encoding of what
stands before that token, and then the token; and a row of tokens is an encoding if each neighbouring pair is one. So each
prefix has one last token: the piece that ends there (an automaton tells all of them) which makes itself and which may follow
the last token of the prefix before it. The table is filled from left to right, and the ids are read from it backwards. It takes
time in proportion to the text, whatever its length.

Where no piece holds a space mark after another character, no merge crosses such a border either, and words are encoded apart:
distinct words of a batch once. A worker keeps the first ``CACHED_WORDS`` words from task to task, so its memory is bounded.
Nothing is shuffled; the vocabulary (1 MB) is broadcast.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import ahocorasick
import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import regex
from pyspark.sql import Column, DataFrame, SparkSession

from .scratch import bound_batches

#: Stands for a blank in pieces.
MARK = "▁"
#: Words and pairs of tokens that a worker keeps; longer words are encoded but not kept.
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH = 400_000, 500_000, 64
#: Texts whose tokens are handed over at once, and characters whose words are encoded at once.
HANDED, AT_ONCE = 256, 1_000_000
OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = float("inf")
# Kinds of pieces and the model's kind in the file format.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2

#: Letters, or what isn't one, after marks.
FINER = regex.compile(rf"{MARK}*\p{{L}}+|{MARK}*[^\p{{L}}{MARK}]+|{MARK}+")

codecs.register_error("each byte apart", lambda e: ("�" * (e.end - e.start), e.end))


# --- model files


def _fields(message: bytes) -> dict[int, list]:
    """Fields of a protocol buffer's message: numbers, and bytes for what has a length."""
    found: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        elif kind == 2:
            size = number()
            value, at = message[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        else:
            raise ValueError("this isn't a model file")
        found.setdefault(key >> 3, []).append(value)
    return found


def read_model(path: str) -> str:
    """What a model file says, as JSON: pieces as (text, score, kind), begin and end ids. Models of other kinds are an error."""
    with open(path, "rb") as f:
        model = _fields(f.read())
    trainer, normalizer = _fields(model[2][0]), _fields(model.get(3, [b""])[0])
    pieces = []
    for x in map(_fields, model[1]):
        pieces.append((x[1][0].decode(), struct.unpack("<f", x[2][0])[0] if 2 in x else 0.0, x.get(3, [NORMAL])[0]))
    plain = normalizer.get(2, [b""])[0] == b"" and normalizer.get(3, [1])[0] == 1 and normalizer.get(4, [1])[0] == 0 and normalizer.get(5, [1])[0] == 1
    known = {NORMAL, UNKNOWN, CONTROL, BYTE} >= {k for _, _, k in pieces} and sum(k == BYTE for _, _, k in pieces) == 256
    if trainer.get(3, [1])[0] != MERGES or trainer.get(24, [0])[0] or not trainer.get(35, [0])[0] or not plain or not known:
        raise ValueError("only models of merges with byte fallback, a blank put before the text and no other normalisation are supported")
    control = {p: i for i, (p, _, k) in enumerate(pieces) if k == CONTROL}
    begin, end = (trainer.get(n, [default])[0].decode() for n, default in ((46, b"<s>"), (47, b"</s>")))
    return json.dumps({"pieces": pieces, "begin": control[begin], "end": control[end], "unknown": trainer.get(44, [" ⁇ ".encode()])[0].decode()})


# --- merging


@dataclass(frozen=True, slots=True)
class Made:
    """How a token makes itself of its characters: the ranks of the merges in their order, and the outer symbols before each of them and at last."""

    ranks: list[float]
    left: list[str]
    right: list[str]


class Vocabulary:
    """Pieces with their ranks, the automaton over them, and what is known of pairs of tokens."""

    def __init__(self, told: str) -> None:
        """told: what ``read_model`` gives."""
        model = json.loads(told)
        self.begin, self.end = model["begin"], model["end"]
        ids = {p: i for i, (p, _, k) in enumerate(model["pieces"]) if k == NORMAL}
        self.rank = {p: -score for p, score, k in model["pieces"] if k == NORMAL}
        byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model["pieces"]) if k == BYTE}
        #: Ids of a character's bytes, as those of a token.
        self.spelled = lambda c: b"".join(struct.pack("<I", byte_ids[b]) for b in c.encode("utf-8"))
        #: Tokens: pieces that merging makes of their own characters, and characters of pieces that can be merged though they aren't pieces.
        self.letters = set().union(*ids) if ids else set()
        self.tokens = [p for p in sorted({*ids, *self.letters}) if self._made(p) is not None]
        self.made = [self._made(p) for p in self.tokens]
        self.written = [struct.pack("<I", ids[p]) if p in ids else self.spelled(p) for p in self.tokens]
        self.sizes = [len(p) for p in self.tokens]
        self.longest = max(self.sizes, default=1)
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.tokens):
            self.automaton.add_word(piece, (len(piece), number))
        self.automaton.make_automaton()
        #: By pair of tokens, as left * number of tokens + right.
        self.follows: dict[int, bool] = {}
        #: Whether words are encoded apart, and whether letters and the rest of a word are: no piece joins them.
        self.apart = not any(MARK in p.lstrip(MARK) for p in ids)
        self.finer = self.apart and all(FINER.fullmatch(p) for p in ids)
        kinds = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: model["unknown"].encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes((int(p[3:5], 16),))}
        spelled = [kinds[k](p) for p, _, k in model["pieces"]]
        #: Bytes of all ids, one after the other, with where each begins and how many there are.
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(b) for b in spelled])
        self.start = np.cumsum(self.length) - self.length
        self.control = np.array([k == CONTROL for _, _, k in model["pieces"]])
        #: Whose leading blank is dropped at the start of a text.
        self.marked = {i for p, i in ids.items() if p.startswith(MARK)}

    def _made(self, token: str) -> Made | None:
        """How merging makes a token of its own characters, None if it doesn't."""
        symbols = list(token)
        ranks, left, right = [], [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            rank, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            ranks.append(rank)
            left.append(symbols[0])
            right.append(symbols[-1])
        return Made([*ranks, NEVER], left, right)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are: no merge across their border ever comes first.

        The merges within both are done in order of rank, the left one's first of equals. Across the border stand two
        symbols; their merge comes after the left token's of equal rank and before the right one's.
        """
        a, b, i, j = self.made[left], self.made[right], 0, 0
        while True:
            across = self.rank.get(a.right[i] + b.left[j], NEVER)
            if across < a.ranks[i] and across <= b.ranks[j]:
                found = False
                break
            if a.ranks[i] == b.ranks[j] == NEVER:
                found = True
                break
            if a.ranks[i] <= b.ranks[j]:
                i += 1
            else:
                j += 1
        if len(self.follows) >= CACHED_PAIRS:
            self.follows.clear()
        self.follows[left * len(self.tokens) + right] = found
        return found

    def encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each marked word with its ids as little-endian unsigned 32-bit integers; of words in order, a prefix shared with the word before isn't worked out again."""
        follows, count, sizes, written = self.follows, len(self.tokens), self.sizes, self.written
        before, last = "", []  # of each prefix of the word the last token; -1 where the last character stands in no piece
        for word in words:
            shared = len(commonprefix((before, word)))
            del last[shared:]
            last += [-1] * (len(word) - shared)
            done = shared - 1
            for end, (size, token) in self.automaton.iter(word, max(0, shared - self.longest + 1)):
                if end <= done:  # one only may stand here
                    continue
                if end >= size:
                    left = last[end - size]
                    if left >= 0:
                        found = follows.get(left * count + token)
                        if not (self.may_follow(left, token) if found is None else found):
                            continue
                last[end] = token
                done = end
            out = []
            at = len(word) - 1
            while at >= 0:
                token = last[at]
                if token >= 0:
                    out.append(written[token])
                    at -= sizes[token]
                elif word[at] in self.letters:
                    raise RuntimeError(f"no token ends at character {at}")
                else:
                    out.append(self.spelled(word[at]))
                    at -= 1
            out.reverse()
            before = word
            yield word, b"".join(out)

    def _text(self, ids: np.ndarray) -> str:
        """The text of ids without control ones, leading blank included; U+FFFD for each byte that isn't UTF-8 together with bytes beside it."""
        lengths = self.length[ids]
        at = np.repeat(self.start[ids] - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        return self.bytes[at].tobytes().decode("utf-8", "each byte apart")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: blanks for marks but one before the text, nothing for control ids."""
        cuts = [-1, *np.flatnonzero(self.control[ids]).tolist(), len(ids)]
        runs = [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1]
        texts = [self._text(run) for run in runs]
        if runs and int(runs[0][0]) in self.marked:
            texts[0] = texts[0][1:]
        return "".join(texts)


class Encoder:
    """Encodes and decodes texts with a vocabulary, keeping words that it has met."""

    def __init__(self, vocabulary: Vocabulary, begin: bool = True, end: bool = True) -> None:
        self.vocabulary = vocabulary
        self.words: dict[str, bytes] = {}
        self.before = struct.pack("<I", vocabulary.begin) if begin else b""
        self.after = struct.pack("<I", vocabulary.end) if end else b""
        self.split = re.compile(f"{MARK}+[^{MARK}]*" if vocabulary.apart else "(?s).+").findall

    def encoded(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids, with those of begin and end as asked for; null and empty texts have no others."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(MARK + text.replace(" ", MARK) if text else "")
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _learn(self, words: set[str]) -> list[str]:
        """Encodes new words; returns those that are not to be kept."""
        known, passing = self.words, []
        parts = {w: FINER.findall(w) for w in words} if self.vocabulary.finer else {w: [w] for w in words}
        ids = dict(self.vocabulary.encode(sorted(set().union(*parts.values()).difference(known))))
        for word, its in parts.items():
            if len(word) > CACHED_LENGTH or len(known) >= CACHED_WORDS:
                passing.append(word)
            known[word] = b"".join([ids[p] if p in ids else known[p] for p in its])
        return passing

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.split(t) for t in texts]
        known = self.words
        passing = self._learn(set().union(*split).difference(known))
        for words in split:
            yield b"".join([self.before, *map(known.__getitem__, words), self.after])
        for word in passing:
            del known[word]

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids' bytes, SHA-256 of the decoded text."""
        for ids in self.encoded(texts):
            decoded = self.vocabulary.decode(np.frombuffer(ids, "<u4"))
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()


# --- columns


_kept: dict[tuple[str, bool, bool], Encoder] = {}


def _encoder(told: str, digest: str, begin: bool, end: bool) -> Encoder:
    """The worker's encoder of a vocabulary."""
    key = digest, begin, end
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(Vocabulary(told), begin, end)
    return _kept[key]


def model_path() -> str:
    """Where the production model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _column(spark: SparkSession, given: Column, path: str | None, begin: bool, end: bool, out: str, run: Callable[[Encoder, list], pd.Series | pd.DataFrame]) -> Column:
    """A pandas UDF over some values at a time."""
    bound_batches(spark)
    told = read_model(path or model_path())
    digest, held = hashlib.md5(told.encode()).hexdigest(), spark.sparkContext.broadcast(told)

    def mapped(parts):  # noqa: ANN001, ANN202
        encoder = _encoder(held.value, digest, begin, end)
        for part in parts:
            values = part.tolist()
            for i in range(0, len(values), HANDED):
                yield run(encoder, values[i : i + HANDED])

    mapped.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame if "," in out else pd.Series]}
    return F.pandas_udf(mapped, out)(given)


def token_digests(spark: SparkSession, text: Column, path: str | None = None, begin: bool = True, end: bool = True) -> Column:
    """A struct of ``OUT`` for a text column; a null text counts as empty, which has the begin and end ids only."""
    return _column(spark, text, path, begin, end, OUT, lambda encoder, texts: pd.DataFrame(list(encoder.digests(texts)), columns=["n_tokens", "ids_sha256", "decoded_sha256"]))


def encode(spark: SparkSession, text: Column, path: str | None = None, begin: bool = True, end: bool = True) -> Column:
    """Token ids of a text column, as an array; a null text counts as empty."""
    return _column(spark, text, path, begin, end, "array<int>", lambda encoder, texts: pd.Series([np.frombuffer(x, "<i4") for x in encoder.encoded(texts)], dtype=object))


def decode(spark: SparkSession, ids: Column, path: str | None = None) -> Column:
    """Text of an array of token ids (null: null). Ids outside the vocabulary raise."""

    def texts(encoder: Encoder, given: list) -> pd.Series:
        size = len(encoder.vocabulary.length)
        for x in given:
            if x is not None and any(i is None or not 0 <= i < size for i in x):
                raise ValueError("an id is not in the vocabulary")
        return pd.Series([None if x is None else encoder.vocabulary.decode(np.asarray(x, dtype=np.int64)) for x in given], dtype=object)

    return _column(spark, ids, path, True, True, "string", texts)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text of ``documents``, one row per row; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", token_digests(spark, F.col("text")).alias("t")).select("doc_id", "t.*")
