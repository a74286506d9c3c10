"""Byte-pair encoding and decoding with a compiled lexicon of frequent words.

A *word* is what lies between two cuts of a text; a cut is a space of which one
neighbour at least is not white space.  The split pattern of byte-level
vocabularies never takes a token across such a cut, and the space goes with the
word that follows it.  So a text's ids are its words' ids one after another.

Frequent words of the whole corpus are looked up in a minimal acyclic
transducer (``lexicon``), mapped into memory by every worker; all others are
split by the vocabulary's pattern and merged pair by pair, exactly: many words of
one length side by side, a merge of each at a time.  Results are
the same with any lexicon, an empty one included.

Defined results: a null or empty text has no ids and decodes to an empty text;
the string of a special token in a text is that token, as the library has it;
equal rows are encoded each on their own; null ids and other columns are passed through, but
``ids`` and ``decoded_text``, which are replaced; a long text is encoded as a whole; of words
that occur equally often the smaller ones are in the lexicon; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import small_batches, tidy
from .lexicon import Lexicon, compile_words
from .textcore import slices

#: The characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"
_UNSAFE = re.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)")
_UNSAFE_RE2 = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] (?:[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|\\z)"
_PLAIN = re.compile(rf" [^{WHITE}\u0250-\U0010ffff][^ \u0250-\U0010ffff]*")
_CUT = re.compile(rf"(?<![{WHITE}]) | (?=[^{WHITE}])")
#: Fixed value: the split pattern of byte-level vocabularies.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
LATIN_END = "\u0250"
#: Words in the lexicon, words in a generation of a worker's cache, and the longest word that is kept.
LEXICON_WORDS, CACHED_WORDS, CACHED_CHARS = 1 << 16, 200_000, 64
#: Words in a generation, and tokens, that an encoder keeps within a task: the frequent words are in the lexicon.
ENCODER_WORDS = 1 << 16
#: Tokens longer than this are merged one by one; so many of one length are merged side by side.
SIDE_BY_SIDE_BYTES, SIDE_BY_SIDE = 32, 4096
#: Bytes of text that are encoded at a time: the more, the fewer distinct words they have for their size.
ENCODED_BYTES = 6 << 20
NO_PAIR = np.int32(0x7FFFFFFF)
#: A task reports the words that make up at least this share of its words.
LEAST_SHARE = 1 / (1 << 18)


def cut_words(text: str) -> list[str]:
    return _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = raw(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        pairs = sorted((a * (size + 1) + b, rank, to) for (a, b), (rank, to) in self.merges.items())
        self.size, self.pair_keys, self.pair_ranks = size, np.array([k for k, _, _ in pairs], np.int64), np.array([r for _, r, _ in pairs], np.int32)
        self.merged_to = np.zeros(len(spec["model"]["merges"]), np.int32)
        self.merged_to[self.pair_ranks] = [to for _, _, to in pairs]
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, token: bytes) -> list[int]:
        """Merges the leftmost pair of least rank until none is left."""
        ids = [self.single[b] for b in token]
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best = at = None
            for i, m in enumerate(found):
                if m is not None and (best is None or m[0] < best):
                    best, at = m[0], i
            if at is None:
                return ids
            ids[at : at + 2] = [found[at][1]]
            del found[at]
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]))
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            after[i] = after[j]
            if after[i] < n:
                back[after[i]] = i
                if m := get((to, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, to, ids[after[i]], m[1]))
            if back[i] >= 0 and (m := get((ids[back[i]], to))):
                heapq.heappush(heap, (m[0], back[i], ids[back[i]], to, m[1]))
        return [x for x in ids if x >= 0]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, ``NO_PAIR`` for those that no merge has."""
        if not len(self.pair_keys):
            return np.full(a.shape, NO_PAIR, np.int32)
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_PAIR)

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """``merge`` of every token, as little-endian 32-bit integers."""
        out: list = [None] * len(tokens)
        by_size: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            by_size.setdefault(len(token), []).append(i)
        for n, which in by_size.items():
            if n > SIDE_BY_SIDE_BYTES or len(which) < 8:
                for i in which:
                    out[i] = _packed(self.merge(tokens[i]))
                continue
            for k in range(0, len(which), SIDE_BY_SIDE):
                some = which[k : k + SIDE_BY_SIDE]
                body, ends = self._merge_side_by_side(b"".join([tokens[i] for i in some]), n)
                for i, a, b in zip(some, [0, *ends], ends):
                    out[i] = body[a:b]
        return out

    def _merge_side_by_side(self, joined: bytes, n: int) -> tuple[bytes, list[int]]:
        """Tokens of ``n`` bytes each, one a row.  Places are linked, so a merge moves nothing; column ``n`` is the end on both sides."""
        rows = len(joined) // n
        ids = np.full((rows, n + 1), self.size, np.int32)
        ids[:, :n] = np.array(self.single, np.int32)[np.frombuffer(joined, np.uint8)].reshape(rows, n)
        rank = np.full((rows, n + 1), NO_PAIR, np.int32)
        rank[:, : n - 1] = self.ranks_of(ids[:, : n - 1], ids[:, 1:n])
        after = np.tile(np.arange(1, n + 2), (rows, 1))
        back = np.tile(np.append(n, np.arange(n)), (rows, 1))
        left = np.ones((rows, n), bool)
        row = np.arange(rows)
        while True:
            at = rank[row].argmin(axis=1)  # the leftmost of least rank
            best = rank[row, at]
            some = best < NO_PAIR
            row, at, best = row[some], at[some], best[some]
            if not len(row):
                break
            gone, before = after[row, at], back[row, at]
            then = after[row, gone]
            to = self.merged_to[best]
            ids[row, at], left[row, gone], rank[row, gone] = to, False, NO_PAIR
            after[row, at], back[row, then] = then, at
            rank[row, at] = self.ranks_of(to, ids[row, then])
            rank[row, before] = self.ranks_of(ids[row, before], to)
        return ids[:, :n][left].astype("<i4").tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """``encode_word`` of every word, as little-endian 32-bit integers.

        Latin words that begin with their only space, and no other white space behind it, are split together: no token goes across that
        space, and a token that begins with one begins a word.
        """
        special = self.split_special.search if self.split_special and self.split_special.search("\n".join(words)) else None
        out: list = [None] * len(words)
        plain = []
        for i, word in enumerate(words):
            if _PLAIN.fullmatch(word) and not (special and special(word)):
                plain.append(i)
            else:
                out[i] = _packed(self.encode_word(word))
        tokens = self.split.findall("".join([words[i] for i in plain]))
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        known.update(zip(new, self.merge_many([t.encode() for t in new])))
        ids = [known[t] for t in tokens]
        first = [*[k for k, t in enumerate(tokens) if t[0] == " "], len(tokens)]
        for i, a, b in zip(plain, first[:-1], first[1:], strict=True):
            out[i] = ids[a] if b == a + 1 else b"".join(ids[a:b])
        if len(known) > ENCODER_WORDS:
            known.clear()
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, white space and special tokens included."""
        out: list[int] = []
        parts = self.split_special.split(word) if self.split_special and any(s in word for s in self.special) else [word]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            else:
                for token in self.tokens(part):
                    out += self.merge(token.encode())
        return out

    def tokens(self, part: str) -> list[str]:
        """What the split pattern makes of a text.  Beyond Latin the library decides what is a letter:
        its character tables are of another Unicode version than those of the regex module."""
        if part.isascii() or max(part) < LATIN_END:
            return self.split.findall(part)
        from tokenizers.pre_tokenizers import ByteLevel

        return [part[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(part)]


class WordCache:
    """Ids of texts from ids of words; ``learn`` makes those of words that aren't known.

    What is known lies in two generations: a full young one becomes the old one, and a word that is
    met again moves back to the young one.  So memory is bounded and frequent words stay.
    """

    def __init__(self, learn, size: int = CACHED_WORDS):
        self.learn, self.size = learn, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, each with a space in front, as little-endian 32-bit integers."""
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        todo = []
        for i, ids in zip(missing, map(old.get, [words[i] for i in missing])):
            if ids is None:
                todo.append(i)
            else:
                out[i] = young[words[i]] = ids
        new = [words[i] for i in todo]
        for i, word, ids in zip(todo, new, self.learn([" " + w for w in new])):
            out[i] = ids
            if len(word) <= CACHED_CHARS:
                young[word] = ids
        if len(young) > self.size:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): ``ids[bounds[i]:bounds[i + 1]]`` are those of text ``i``.

        Texts are cut, and equal words of the slice are found, without making an object of each word.
        """
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(texts, " ")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE_RE2).to_numpy(zero_copy_only=False))
        if len(odd):  # cuts of these depend on more than the space
            pieces, at = [], 0
            for i in odd.tolist():
                pieces += [parts.slice(at, i - at), pa.array([cut_words(texts[i].as_py())], parts.type)]
                at = i + 1
            parts = pa.concat_arrays([*pieces, parts.slice(at)])
        flat = parts.flatten()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())]).astype(np.int64)
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        words_of_begins = [words[i] for i in index[bounds[:-1]].tolist()]  # the only words without a space in front
        begins = list(dict.fromkeys(w for w in words_of_begins if w))
        place = {w: len(words) + k for k, w in enumerate(begins)} | {"": len(words) + len(begins)}
        index[bounds[:-1]] = [place[w] for w in words_of_begins]
        table = pa.array([*self.ids_of(words), *self.learn(begins), b""], pa.binary())
        taken = table.take(pa.array(index))
        ends = np.frombuffer(taken.buffers()[1], "<i4", len(taken) + 1, taken.offset * 4).astype(np.int64)
        body = taken.buffers()[2]
        ids = np.frombuffer(body, "<i4", (ends[-1] - ends[0]) // 4, int(ends[0])) if body is not None and body.size else np.zeros(0, "<i4")
        return ids, (ends[bounds] - ends[0]) // 4


class Encoder:
    """Vocabulary and lexicon are kept by a worker from task to task, words that it has met until the task ends: a worker
    goes on to other stages."""

    _made: dict = {}

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.vocabulary = Vocabulary(path)
        self.lexicon = lexicon
        self.words = WordCache(self._learn, ENCODER_WORDS)
        self.encode = self.words.encode
        self.table = pa.array(self.vocabulary.bytes, pa.binary())

    @classmethod
    def of(cls, path: str, data: bytes) -> "Encoder":
        key = (path, hash(data))
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(path, Lexicon.mapped(data) if data else None)
        return cls._made[key]

    def forget(self) -> None:
        self.words.young, self.words.old = {}, {}
        self.vocabulary.known = {}

    def _learn(self, words: list[str]) -> list[bytes]:
        """By the lexicon, or else by merging."""
        ranks = self.lexicon.ranks([w.encode() for w in words]).tolist() if self.lexicon else [-1] * len(words)
        rest = iter(self.vocabulary.encode_words([w for w, r in zip(words, ranks) if r < 0]))
        return [_packed(self.lexicon.ids_of(r)) if r >= 0 else next(rest) for r in ranks]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ``ids[bounds[i]:bounds[i + 1]]``."""
        pieces = self.table.take(pa.array(ids, pa.int32()))
        if not len(pieces):
            return [""] * (len(bounds) - 1)
        off = np.frombuffer(pieces.buffers()[1], "<i4", len(pieces) + 1, pieces.offset * 4)[bounds]
        body = pieces.buffers()[2].to_pybytes() if pieces.buffers()[2] is not None else b""
        return [body[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


def count_frequent(docs: DataFrame, text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """(word, n): how often words occur in the whole corpus.

    Every word of every text is counted.  A task reports a word if it makes up ``least_share`` of the
    task's words, so its rows are bounded.  A task with more distinct words than it may hold forgets those that
    are rare so far; one that comes late can be missed then, which costs time, for ids are the same without it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        total = 0
        for batch in batches:
            for a, b in slices(batch, text):
                for value in batch.column(0).slice(a, b - a).to_pylist():
                    if value:
                        words = value.split(" ")
                        found.update(words[1:])
                        total += len(words)
            if len(found) > 400_000:  # bounded memory: what is rare so far goes, at the same share
                least = max(2, int(total * least_share))
                found = Counter({w: n for w, n in found.items() if n >= least})
        least = max(2, int(total * least_share))
        rows = [(w, n) for w, n in found.items() if n >= least and w and len(w) <= CACHED_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

    return small_batches(docs).select(F.col(f"`{text}`").alias(text)).mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus' ``words`` most frequent words."""
    top = count_frequent(docs, text).orderBy(F.desc("n"), "word").limit(words).collect()
    vocabulary = Vocabulary(path)
    # a word that holds a special token or white space is left to the exact path
    plain = [w for (w, _) in top if not any(s in w for s in vocabulary.special) and not re.search(f"[{WHITE}]", w)]
    return compile_words([((" " + w).encode(), vocabulary.encode_word(" " + w)) for w in plain])


def encode_decode(docs: DataFrame, path: str, lexicon: bytes = b"", text: str = "text", decoded: bool = True) -> DataFrame:
    """All columns of ``docs``, with ``ids`` (array of int) and, from these ids, ``decoded_text`` added."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    columns = [c for c in docs.columns if c not in ("ids", "decoded_text")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, shared.value)
        try:
            for batch in batches:
                for a, b in slices(batch, text, ENCODED_BYTES):
                    part = batch.slice(a, b - a)
                    ids, bounds = encoder.encode(part.column(columns.index(text)))
                    out = [*part.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
                    if decoded:
                        out.append(pa.array(encoder.decode(ids, bounds), pa.string()))
                    yield pa.RecordBatch.from_arrays(out, [*columns, "ids", *["decoded_text"] * decoded])
        finally:
            encoder.forget()

    return docs.select(*[f"`{c}`" for c in columns]).mapInArrow(tidy(run), f"{fields}, ids array<int>" + ", decoded_text string" * decoded)
