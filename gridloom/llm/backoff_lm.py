"""Language-model scores by a weighted backoff automaton.

**Model.**  n-grams of all training texts are counted.  Let ``c(h)`` be the count of a history.  Then
``p(w | h) = (1 - r) * c(h w) / c(h) + r * p(w | h')`` with ``h'`` the history without its first word, and
``p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))``, all unknown words being one more class.  The weight ``r`` is the rate of
new continuations among histories of about that count (to a power of two): the share of n-grams seen once.  The
probabilities after every history sum to 1.

**Automaton.**  Seen histories are states.  An arc of state ``h`` for the word ``w`` has weight ``log10 p(w | h)`` and
leads to the longest seen suffix of ``h w``; a state's failure arc has weight ``log10 r`` and leads to ``h'``, where the
same word is tried again; the first state, that of no history, has an arc for every word.  A text is read once from left to right: the state is
carried on and log-probabilities add up.  Lanes of texts walk side by side; a long text is cut into lanes, and
a lane begins with a walk over the words before it that a history holds, which leads to the same state.

**Scale.**  The automaton of a corpus is larger than a task, that of a block of documents is not.  Documents are
turned into token ids by blocks, once, in buckets of a table.  A block sends each of its distinct n-grams with its count in the
block to the part of the key space that it belongs to; parts are many, as large as one another, and a frequent n-gram
weighs one entry a block.  The totals go back to the blocks, in buckets of the task that made the block like these (so a task
writes one file, whatever the number of its blocks), and reading the two together needs no further exchange: each block builds the states and arcs that its texts can meet, with corpus-wide weights.
n-grams are told apart by 64-bit hashes, of which the last two bits hold the order.

Defined results: a null or empty text is one token, its end; a null id is learnt from; repeated rows count and are
scored each; without training texts all words are unknown and have probability 1; results have no other columns
than those named; a long text is a block of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .fingerprint_index import bucketed, most_buckets
from .packed import binaries, pack, raw, unpack
from .textcore import LOWER, U64, joined_bytes, mix, slices, word_bounds, word_hashes

ORDER = 2
#: Bytes of text in a block, of keys in a part, and of token ids in a bucket, at most about.
BLOCK_BYTES, PART_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20, 4 << 20
LEAST_PARTS = 16
#: Tokens that a lane of the walk has at most.
LANE = 256
#: Classes of a history's count: by powers of two.
CLASSES = 64
#: The last bits of a key: order - 1, or that of the mark before a text, which is no token.
TAG, START_TAG = U64(3), U64(3)
START, END = mix(np.array([1, 2], U64)) & ~TAG
START |= START_TAG
TEXT_BLOCKS = "block long, task int, size long, ids array<{0}>, learnt array<boolean>, sizes array<int>, vocabulary binary, tokens binary"
ENTRIES = "part int, block long, keys binary, counts binary"
TOTALS = "block long, part int, totals binary, tokens long, words long"
UNIT = 0.5


def learnt(doc_id: str = "doc_id", folds: int = 5, held: int = 1) -> Column:
    """Rows that the model learns from."""
    return ~F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == held, F.lit(False))


def _planes(tokens: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress well."""
    return tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def text_blocks(docs: DataFrame, learn: Column, id: str, text: str) -> DataFrame:
    """Documents as token ids: a row a block.  A document is its start mark, its words and its end."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = task << 32
        for batch in batches:
            for a, b in slices(batch, "text", BLOCK_BYTES):
                part = batch.slice(a, b - a)
                buf, bounds = joined_bytes(part.column(1))
                start, end, edge = word_bounds(buf := LOWER[buf], bounds)
                n = np.diff(edge) + 2
                close = np.cumsum(n)
                tokens = np.empty(int(close[-1]), U64)
                inside = np.ones(len(tokens), bool)
                inside[close - 1] = inside[close - n] = False
                tokens[close - n], tokens[close - 1] = START, END
                tokens[inside] = word_hashes(buf, start, end) & ~TAG
                vocabulary, tokens = np.unique(tokens, return_inverse=True)
                whole = pa.array([0, b - a], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, x) for x in (part.column(0), part.column(2), pa.array(n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([task], pa.int32()), pa.array([len(tokens)]), *lists, pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()), pa.array([_planes(tokens)], pa.binary()),
                ], ["block", "task", "size", "ids", "learnt", "sizes", "vocabulary", "tokens"])
                number += 1

    some = small_batches(docs).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), learn.alias("learn"))
    return some.mapInArrow(run, TEXT_BLOCKS.format(kind))


class Grams:
    """The distinct n-grams of a block, order by order: for each its key, its history and its suffix (places among those of the
    order below), its last word, and its count in the block's training texts."""

    def __init__(self, sizes: np.ndarray, learnt: np.ndarray, vocabulary: np.ndarray, tokens: np.ndarray, order: int):
        self.vocabulary, self.tokens, self.sizes, self.order = vocabulary, tokens, sizes, order
        self.begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(tokens)) - np.repeat(self.begin, sizes)
        train = np.repeat(learnt, sizes)
        self.keys, self.history, self.suffix, self.word = [vocabulary], [None], [None], [np.arange(len(vocabulary))]
        self.own = [np.bincount(tokens[train], minlength=len(vocabulary))]
        of = tokens  # for each place the n-gram that ends there
        for k in range(2, order + 1):
            at = np.flatnonzero(inside >= k - 1)
            pair, gram = np.unique(of[at - 1] * len(vocabulary) + tokens[at], return_inverse=True)
            history, word = np.divmod(pair, max(1, len(vocabulary)))
            suffix = np.zeros(len(pair), np.int64)
            suffix[gram] = of[at]
            key = (mix(self.keys[-1][history] * U64(0x9E3779B97F4A7C15) + vocabulary[word] + U64(k)) & ~TAG) | U64(k - 1)
            for x, y in ((self.keys, key), (self.history, history), (self.suffix, suffix), (self.word, word), (self.own, np.bincount(gram[train[at]], minlength=len(pair)))):
                x.append(y)
            of = np.zeros(len(tokens), np.int64)
            of[at] = gram
        self.edges = np.cumsum([0, *map(len, self.keys)])

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys, ascending, and the places they come from."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def by_order(self, values: np.ndarray) -> list[np.ndarray]:
        return [values[a:b] for a, b in zip(self.edges[:-1], self.edges[1:])]


def _part_edges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts that ascending keys belong to, bounds of their keys); a part is a range of the high 32 bits."""
    part = ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[edge], np.concatenate([edge, [len(keys)]])


def _grams(table: pa.Table | pa.RecordBatch, i: int, order: int) -> Grams:
    get = lambda name: table.column(name)[i]
    numbers = lambda name: get(name).values.to_numpy(zero_copy_only=False)
    vocabulary = np.frombuffer(get("vocabulary").as_buffer(), "<u8").astype(U64)
    return Grams(numbers("sizes").astype(np.int64), numbers("learnt").astype(bool), vocabulary, _from_planes(np.frombuffer(get("tokens").as_buffer(), np.uint8)), order)


def gram_entries(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """Each block's distinct n-grams, a row for each part that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g = _grams(batch, i, order)
                keys, at = g.sorted()
                own = np.concatenate(g.own)[at]
                part, edge = _part_edges(keys, parts)
                block = np.full(len(part), batch.column(0)[i].as_py())
                counts = [pack(own[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block), binaries(keys, 8 * edge), pa.array(counts, pa.binary())], ["part", "block", "keys", "counts"])

    return blocks.select("block", "learnt", "sizes", "vocabulary", "tokens").mapInArrow(run, ENTRIES)


def add_up(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of a part's n-grams, sent back to every block that named them; tokens and words of the part are told once."""
    data, _ = raw(table.column("keys"))
    keys = data.view("<u8")
    counts = [unpack(x.as_buffer()) for x in table.column("counts")]
    edge = np.cumsum([0, *map(len, counts)])
    distinct, which = np.unique(keys, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    words = (distinct & TAG) == 0
    back = total[which]
    n = table.num_rows
    first = np.zeros(n, np.int64)
    first[0] = 1
    packed = [pack(back[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return pa.table([table.column("block"), table.column("part"), pa.array(packed, pa.binary()), pa.array(first * int(total[words].sum())), pa.array(first * int((total[words] > 0).sum()))], ["block", "part", "totals", "tokens", "words"])


def _totals(g: Grams, told: pa.Table) -> list[np.ndarray]:
    """Corpus-wide counts of a block's n-grams, order by order."""
    order = np.argsort(told.column("part").to_numpy())
    values = told.column("totals")
    back = np.concatenate([unpack(values[i].as_buffer()) for i in order.tolist()])
    out = np.zeros(len(back), np.int64)
    out[g.sorted()[1]] = back
    return g.by_order(out)


def classes(count: np.ndarray) -> np.ndarray:
    """The power of two that a count reaches; counts of 0 have that of 1."""
    return np.frexp(np.maximum(count, 1))[1] - 1


class Automaton:
    """States and arcs of the n-grams of a block, with corpus-wide weights.  State 0 has no history."""

    def __init__(self, g: Grams, total: list[np.ndarray], tokens: int, words: int, rates: np.ndarray):
        self.width, self.order = max(1, len(g.vocabulary)), g.order
        p = (total[0] + UNIT) / (tokens + UNIT * (words + 1))
        self.base = np.log10(p)  # arcs of state 0
        state: list[np.ndarray] = []  # of the n-grams of each order; 0 where there is none
        fail, fail_weight, made, key, weight, to = [np.zeros(1, np.int64)], [np.zeros(1)], 1, [], [], []
        for k in range(1, g.order + 1):
            seen = np.flatnonzero(total[k - 1] > 0)
            mine = np.zeros(len(total[k - 1]), np.int64)
            if k < g.order:
                mine[seen] = made + np.arange(len(seen))
                made += len(seen)
                fail.append(state[-1][g.suffix[k - 1][seen]] if k > 1 else np.zeros(len(seen), np.int64))
                fail_weight.append(np.log10(rates[k + 1, classes(total[k - 1][seen])]))
            if k > 1:
                history, suffix = g.history[k - 1][seen], g.suffix[k - 1][seen]
                rate = rates[k, classes(total[k - 2][history])]
                below, p = p, np.zeros(len(total[k - 1]))
                p[seen] = (1 - rate) * total[k - 1][seen] / total[k - 2][history] + rate * below[suffix]
                key.append(state[-1][history] * self.width + g.word[k - 1][seen])
                weight.append(np.log10(p[seen]))
                to.append(mine[seen] if k < g.order else state[-1][suffix])
            state.append(mine)
        self.known, self.words = total[0] > 0, state[0]
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        if key:
            key = np.concatenate(key)
            order = np.argsort(key)
            self.key, self.weight, self.to = key[order], np.concatenate(weight)[order], np.concatenate(to)[order]
        else:
            self.key, self.weight, self.to = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word in each lane: (states, log-probabilities).  A lane without an arc for its word fails over to the
        state of its shorter history, at most as often as a history has words."""
        state, score = state.copy(), np.zeros(len(state))
        open_ = np.arange(len(state))
        for _ in range(self.order - 1):
            if not len(self.key) or not len(open_):
                break
            key = state[open_] * self.width + word[open_]
            at = np.searchsorted(self.key, key)
            at[at == len(self.key)] = 0
            hit = self.key[at] == key
            found, at = open_[hit], at[hit]
            score[found] += self.weight[at]
            state[found] = self.to[at]
            open_ = open_[~hit]
            score[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        score[open_] += self.base[word[open_]]
        state[open_] = self.words[word[open_]]
        return state, score

    def walk(self, tokens: np.ndarray, begin: np.ndarray, size: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Sum of the log-probabilities of each text; ``begin`` is the place of its start mark, ``size`` counts it."""
        real = size - 1
        cuts = -(-real // lane)
        text = np.repeat(np.arange(len(size)), cuts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first = begin[text] + 1 + place * lane
        last = np.minimum(first + lane, (begin + size)[text])
        # the words before a lane that a history holds; the start mark among them
        warm = np.minimum(first - begin[text], max(0, self.order - 1))
        order = np.argsort(-(last - first), kind="stable")
        text, first, last, warm = text[order], first[order], last[order], warm[order]
        state = np.zeros(len(first), np.int64)
        for back in range(self.order - 1, 0, -1):
            at = np.flatnonzero(warm >= back)
            state[at] = self.step(state[at], tokens[first[at] - back])[0]
        total = np.zeros(len(first))
        length = last - first
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, "left"))
            state[:n], score = self.step(state[:n], tokens[first[:n] + t])
            total[:n] += score
        return np.bincount(text, weights=total, minlength=len(size))


def _schema(kind: str) -> str:
    return f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def novelty_rates(blocks: DataFrame, totals: DataFrame, order: int) -> np.ndarray:
    """(order, class) -> share of new continuations after histories of that class of counts, from all training texts."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for i in range(left.num_rows):
            g = _grams(left, i, order)
            total = _totals(g, right)
            for k in range(2, order + 1):
                of = classes(total[k - 2][g.history[k - 1]])
                single = np.bincount(of[(total[k - 1] == 1) & (g.own[k - 1] == 1)], minlength=CLASSES)
                places = np.bincount(of, weights=g.own[k - 1], minlength=CLASSES).astype(np.int64)
                rows += [(k, c, int(single[c]), int(places[c])) for c in np.flatnonzero(places).tolist()]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.table([pa.array(list(x), t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["k", "class", "single", "places"])

    left, right = blocks.select("task", "block", "learnt", "sizes", "vocabulary", "tokens"), totals.select("task", "block", "part", "totals")
    found = left.groupBy("task", "block").cogroup(right.groupBy("task", "block")).applyInArrow(run, "k int, class int, single long, places long")
    rates = np.full((order + 2, CLASSES), 0.5)
    for r in found.groupBy("k", "class").agg(F.sum("single").alias("single"), F.sum("places").alias("places")).collect():  # orders x CLASSES rows
        rates[r.k, r["class"]] = (r.single + UNIT) / (r.places + 1)
    return rates


def score_texts(docs: DataFrame, folder: str, learn: Column | None = None, id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` says which rows
    the model learns from.  ``folder`` is new and shared."""
    if not 1 <= order <= 3:
        raise ValueError("keys have room for orders 1 to 3")
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    made = text_blocks(docs, learnt(id) if learn is None else learn, id, text)
    bytes_ = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("b")).first().b or 0
    buckets = min(max(LEAST_PARTS, math.ceil(bytes_ / BUCKET_BYTES)), most_buckets(spark))
    blocks = bucketed(made, "task", buckets, f"{folder}/blocks")
    size = blocks.agg(F.sum("size").alias("n")).first().n
    if not size:
        return spark.createDataFrame([], _schema(kind)).withColumn("train_tokens", F.lit(0).cast("long")).select(*columns)
    parts = max(LEAST_PARTS, math.ceil(size * 8 * order / PART_BYTES))
    entries = gram_entries(blocks, order, parts)
    answers = entries.groupBy("part").applyInArrow(add_up, TOTALS).withColumn("task", F.shiftright("block", 32).cast("int"))
    totals = bucketed(answers.repartition(buckets, "task"), "task", buckets, f"{folder}/totals")
    seen = totals.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, words = seen.tokens, seen.words
    rates = novelty_rates(blocks, totals, order)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            g = _grams(left, i, order)
            automaton = Automaton(g, _totals(g, right), tokens, words, rates)
            real = np.ones(len(g.tokens), bool)
            real[g.begin] = False
            sums = lambda x: np.add.reduceat(np.where(real, x[g.tokens], 0), g.begin)
            held = ~left.column("learnt")[i].values.to_numpy(zero_copy_only=False).astype(bool)
            out.append(pa.table([
                left.column("ids")[i].values, pa.array(held), pa.array(g.sizes - 1), pa.array(sums(automaton.known.astype(np.int64))),
                pa.array(sums(automaton.base)), pa.array(automaton.walk(g.tokens, g.begin, g.sizes)),
            ], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    scored = blocks.groupBy("task", "block").cogroup(totals.select("task", "block", "part", "totals").groupBy("task", "block")).applyInArrow(run, _schema(kind))
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long")).select(*columns)
