"""Language-model scoring with a probabilistic suffix tree.

States are contexts of up to ``depth`` words, the longest suffixes of what precedes a token in its document.  A context of ``least`` training
occurrences or more is a candidate once its suffix is a state, and becomes a state if the distribution of its next symbols diverges
from its parent's by ``divergence`` nats: the mean, over its own occurrences, of the log ratio of both probabilities, each occurrence
judged by the counts of all others, so that chance agreement of rare contexts counts against them.  A state's distribution is
smoothed by its parent's, P(w | s) = (n(s w) + weight * P(w | parent)) / (n(s) + weight), down to add-one unigrams.

Tokens are words (A-Z folded) and one end per document.  All counts cover all training documents; nothing but the fixed ``least``
bounds what is kept, so the tree grows with the corpus.

Scale: no task holds the tree.  Documents lie in blocks of bounded size.  For each order of n-gram, and each order of context, a block
sends its distinct keys with its own sums to their ranges of keys; a range adds up what all blocks sent and answers each block for
its own keys.  Keys of an order are sent only where the context reached ``least``.  A key that every block has is one entry per block,
so hot contexts are spread like all others.  Blocks and answers are written once, in the same buckets, and not shuffled again.

Rows: null and empty texts are one end token.  Repeated rows are documents of their own (counted, and sent once).  A null doc_id is
training.  An empty training set knows no words.  Words and longer n-grams are identified by hashes of 64 bits, whatever the size of the
corpus.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.llm.shared import bucketed
from oneway.llm.textkit import U64, Words, chunks, longs, mix, pack, text_buffer, text_bytes, unpack

#: Training occurrences of a context that may be a state.
LEAST = 4
#: Mean gain of a state over its parent, in nats.
DIVERGENCE = 0.02
#: Occurrences that the parent's distribution counts as.
WEIGHT = 300.0
DEPTH = 3
#: Bytes of text in a block.
BLOCK_BYTES = 3 << 20
#: Gains are added up as whole numbers, so that their order does not matter.
UNIT = float(1 << 10)
END = mix(np.array([0xE0F], U64))[0]

_TEXTS = "bucket int, data binary"
_ASKED = "range int, bucket int, kind string, data binary"
_TOLD = "bucket int, range int, kind string, data binary, tokens long, known long"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, and where each text's tokens begin (with the end of the last)."""
    words = Words(*text_buffer(raw), lower=True)
    first = words.first + np.arange(len(raw) + 1)
    out = np.empty(first[-1], U64)
    out[first[1:] - 1] = END
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = words.hashes()
    return out, first


def planes(a: np.ndarray) -> np.ndarray:
    """Whole numbers by byte, so that compression sees equal bytes together."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).ravel()


def from_planes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.reshape(8, -1).T).view("<i8").ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and for each key its place among them.  The upper bits of keys and their places are sorted as one number;
    the few runs of keys that agree in those and differ below are put in order after."""
    spare = max(1, int(len(keys)).bit_length())
    both = (keys >> U64(spare)) << U64(spare) | np.arange(len(keys), dtype=U64)
    both.sort()
    at = (both & U64((1 << spare) - 1)).astype(np.int64)
    own = keys[at]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    upper = own >> U64(spare)
    mixed = np.flatnonzero(new[1:] & (upper[1:] == upper[:-1])) + 1
    if len(mixed):
        for value in np.unique(upper[mixed]):
            lo, hi = np.searchsorted(upper, [value, value + U64(1)])
            order = np.argsort(own[lo:hi], kind="stable")
            at[lo:hi], own[lo:hi] = at[lo:hi][order], own[lo:hi][order]
        new[1:] = own[1:] != own[:-1]
    where = np.empty(len(keys), np.int64)
    where[at] = np.cumsum(new) - 1
    return own[new], where


class Block:
    """The tokens of a block, and what was told about them so far.

    ``n[k]`` holds for each place the training count of the k tokens that end there, ``gain[k]`` that of the k words before it."""

    def __init__(self, raw: list[bytes], train: np.ndarray, copies: np.ndarray, options: dict):
        self.o = options
        self.h, self.first = tokens(pa.array(raw, pa.large_binary()))
        size = np.diff(self.first)
        self.at = np.arange(len(self.h)) - np.repeat(self.first[:-1], size)
        self.weight = np.repeat(np.where(train, copies, 0), size)
        self.n: dict[int, np.ndarray] = {}
        self.gain: dict[int, np.ndarray] = {}
        self.chain = {1: self.h}

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the k tokens that end at each place."""
        if k not in self.chain:
            back = np.zeros(len(self.h), U64)
            back[k - 1 :] = self.h[: len(self.h) - k + 1]
            self.chain[k] = mix(self.grams(k - 1) * U64(0x9FB21C651E98DF25) + back)
        return self.chain[k]

    def before(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(values)
        out[1:] = values[:-1]
        return out

    def context(self, k: int) -> np.ndarray:
        """Places whose k words before them are a candidate: often enough, and their suffix a state."""
        if k == 0:
            return np.ones(len(self.h), bool)
        often = (self.at >= k) & (self.before(self.n[k]) >= self.o["least"])
        return often & self.state(k - 1) if k - 1 in self.gain or k == 1 else often

    def state(self, k: int) -> np.ndarray:
        """Places whose k words before them are a state."""
        if k == 0:
            return np.ones(len(self.h), bool)
        return self.context(k) & (self.gain[k] >= self.o["divergence"] * self.before(self.n[k]) * UNIT)

    def places(self, kind: str) -> np.ndarray:
        """Where a kind of key is asked for: ``n1`` all tokens, ``n2`` all pairs, longer ones after frequent words; ``g1`` ... contexts."""
        k = int(kind[1:])
        if kind[0] == "g":
            return np.flatnonzero(self.context(k))
        if k <= 2:
            return np.flatnonzero(self.at >= k - 1)
        return np.flatnonzero((self.at >= k - 1) & (self.before(self.n[k - 1]) >= self.o["least"]))

    def keys(self, kind: str, at: np.ndarray) -> np.ndarray:
        k = int(kind[1:])
        return self.grams(k)[at - 1] if kind[0] == "g" else self.grams(k)[at]

    def probability(self, k: int, without: bool) -> np.ndarray:
        """Of each token after its longest state of up to k words; ``without``: by the counts of all other occurrences."""
        less = 1 if without else 0
        p = (self.n[1] - less + 1) / (self.o["tokens"] - less + self.o["known"] + 1)
        for j in range(1, k + 1):
            on = np.flatnonzero(self.state(j))
            context = self.before(self.n[j])[on]
            p[on] = (self.n[j + 1][on] - less + self.o["weight"] * p[on]) / (context - less + self.o["weight"])
        return p

    def gains(self, k: int, at: np.ndarray) -> np.ndarray:
        """What the k words before each place add to the log probability of a training token there."""
        parent = self.probability(k - 1, True)[at]
        own = (self.n[k + 1][at] - 1 + self.o["weight"] * parent) / (self.before(self.n[k])[at] - 1 + self.o["weight"])
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(self.weight[at] > 0, np.log(own / parent), 0.0)
        return np.rint(gain * UNIT) * self.weight[at]

    def ask(self, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, sorted, and the block's own sums for them."""
        at = self.places(kind)
        keys, where = distinct(self.keys(kind, at))
        values = self.weight[at] if kind[0] == "n" else self.gains(int(kind[1:]), at)
        return keys, np.bincount(where, weights=values, minlength=len(keys)).astype(np.int64)

    def tell(self, kind: str, answers: dict[int, np.ndarray]) -> None:
        """Take in the sums over all blocks, one array for each range of keys."""
        at = self.places(kind)
        keys, where = distinct(self.keys(kind, at))
        values = np.concatenate([answers[r] for r, _, _ in ranges(keys, self.o)] or [np.empty(0, np.int64)])
        out = np.zeros(len(self.h), np.int64)
        out[at] = values[where]
        (self.n if kind[0] == "n" else self.gain)[int(kind[1:])] = out


def ranges(keys: np.ndarray, o: dict) -> Iterator[tuple[int, int, int]]:
    """(range, begin, end) of sorted keys, for the ranges that have any: equal shares of all possible keys."""
    n = o["ranges"]
    each = U64(-(-(1 << 64) // n)) if n > 1 else U64((1 << 64) - 1)
    of = keys // each if n > 1 else np.zeros(len(keys), U64)
    begin = np.flatnonzero(np.diff(of, prepend=U64((1 << 64) - 1)))
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
        yield int(of[lo]), lo, hi


def _pack_texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts by bucket; rows equal in id and text are sent once, with their number."""
    held: dict[int, dict] = {}
    size = 0

    def flush():
        for bucket, docs in held.items():
            ids, _, null, held_out, n, raw = zip(*((*k, *v) for k, v in docs.items()))
            numbers = np.array([ids, n, [len(x) for x in raw], null, held_out], np.int64)
            data = pack(numbers.ravel(), np.frombuffer(b"".join(raw), np.uint8))
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])

    for batch in batches:
        for part in chunks(batch):
            ids, tags, null, out = longs(part.column("doc_id")), part.column("tag").to_numpy(), part.column("doc_id").is_null().to_pylist(), part.column("held_out").to_pylist()
            home = (mix(ids.view(U64) ^ mix(tags.view(U64))) % U64(buckets)).tolist()
            for b, d, t, none, o, raw in zip(home, ids.tolist(), tags.tolist(), null, out, text_bytes(part.column("text"))):
                docs = held.setdefault(b, {})
                docs[(d, t, none, o)] = (docs.get((d, t, none, o), (0,))[0] + 1, raw)
                size += len(raw)
            if size >= 24 << 20:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _blocks(batches: Iterator[pa.RecordBatch], kinds: list[str], o: dict) -> Iterator[tuple[int, Block, np.ndarray]]:
    """(bucket, block with all it was told, its documents' numbers: id, copies, bytes, null, held out) of each row."""
    for batch in batches:
        names = [c for c in batch.schema.names if c.startswith("told")]
        for i in range(batch.num_rows):
            numbers, raw = [], []
            for blob in batch.column("texts")[i].values:
                own, data = unpack(blob.as_buffer())
                own, data, at = own.reshape(5, -1), data.tobytes(), 0
                numbers.append(own)
                for n in own[2].tolist():
                    raw.append(data[at : at + n])
                    at += n
            numbers = np.concatenate(numbers, axis=1)
            block = Block(raw, numbers[4] == 0, numbers[1], o)
            del raw
            answers: dict[str, dict[int, np.ndarray]] = {}
            for name in names:
                for x in batch.column(name)[i].values or ():
                    answers.setdefault(x["kind"].as_py(), {})[x["range"].as_py()] = from_planes(unpack(x["data"].as_buffer())[0])
            for kind in kinds:
                block.tell(kind, answers.pop(kind, {}))
            yield batch.column("bucket")[i].as_py(), block, numbers


def _asks(batches: Iterator[pa.RecordBatch], known: list[str], wanted: list[str], o: dict) -> Iterator[pa.RecordBatch]:
    for bucket, block, _ in _blocks(batches, known, o):
        for kind in wanted:
            keys, values = block.ask(kind)
            out = [(r, pack(planes(np.diff(keys[lo:hi], prepend=U64(0)).view(np.int64)), planes(values[lo:hi]))) for r, lo, hi in ranges(keys, o)]
            columns = [pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([kind] * len(out), pa.string()), pa.array([x[1] for x in out], pa.binary())]
            yield pa.record_batch(columns, names=["range", "bucket", "kind", "data"])


def _answers(asked: pd.DataFrame, o: dict) -> pd.DataFrame:
    """Add up a range's keys over all blocks, and answer each block for the keys it sent."""
    out = []
    r = int(asked["range"].iloc[0])
    for kind, rows in asked.groupby("kind"):
        parts = [(int(b), *(from_planes(x) for x in unpack(data))) for b, data in zip(rows["bucket"], rows["data"])]
        sent = np.concatenate([np.cumsum(p[1].view(U64), dtype=U64) for p in parts])
        keys, where = distinct(sent)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate([p[2] for p in parts]))
        at = 0
        for i, (b, own, _) in enumerate(parts):
            tokens, known = (int(total.sum()), int((total > 0).sum())) if kind == "n1" and not i else (0, 0)
            out.append((b, r, kind, pack(planes(total[where[at : at + len(own)]])), tokens, known))
            at += len(own)
    return pd.DataFrame(out, columns=["bucket", "range", "kind", "data", "tokens", "known"]).astype({"bucket": "int32", "range": "int32"})


def _scores(batches: Iterator[pa.RecordBatch], kinds: list[str], o: dict) -> Iterator[pa.RecordBatch]:
    for _, block, numbers in _blocks(batches, kinds, o):
        at, copies = block.first[:-1], numbers[1]
        total = lambda x: np.repeat(np.add.reduceat(x, at), copies)  # noqa: E731, B023
        again = [np.repeat(x, copies) for x in numbers]
        base, score = (total(np.log10(block.probability(k, False))) for k in (0, o["depth"]))
        columns = [pa.array(again[0], mask=again[3] > 0), pa.array(again[4] > 0), pa.array(np.repeat(np.diff(block.first), copies)), pa.array(total((block.n[1] > 0).astype(np.int64))), pa.array(base), pa.array(score)]
        yield pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def fit_and_score(
    docs: DataFrame, folds: int = 7, held: int = 2, depth: int = DEPTH, least: int = LEAST, divergence: float = DIVERGENCE, weight: float = WEIGHT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row, learnt from the documents whose
    crc32(doc_id) is not ``held`` modulo ``folds``.  At a ``depth`` of 0 there is no tree: only tokens are counted, and score is base_score."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"), held_out.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    o = {"depth": depth, "least": least, "divergence": divergence, "weight": weight, "ranges": -(-n // 3), "tokens": 0, "known": 0}
    texts = bucketed(docs.mapInArrow(lambda it: _pack_texts(it, n), _TEXTS), "blocks", "bucket", n)
    rows = texts.groupBy("bucket").agg(F.collect_list("data").alias("texts"))
    known: list[str] = []

    def each_block(f: Callable[..., Iterator[pa.RecordBatch]], schema: str, *args) -> DataFrame:
        args = (*(list(x) for x in args), dict(o))  # as they are now
        return rows.mapInArrow(lambda it: f(it, *args), schema)

    def answers(asked: pd.DataFrame) -> pd.DataFrame:
        return _answers(asked, o)

    for step in range(1, depth + 2):
        wanted = ["n1", "n2"][: depth + 1] if step == 1 else [f"g{step - 1}", *([f"n{step + 1}"] if step <= depth else [])]
        asked = each_block(_asks, _ASKED, known, wanted)
        told = bucketed(asked.groupBy("range").applyInPandas(answers, _TOLD), "answers", "bucket", n)
        # both sides lie in the same buckets, so the join moves nothing
        own = told.groupBy("bucket").agg(F.collect_list(F.struct("range", "kind", "data")).alias(f"told{step}"))
        rows = rows.join(own.hint("merge"), "bucket", "left")
        known += wanted
        if step == 1:
            o["tokens"], o["known"] = (x or 0 for x in told.agg(F.sum("tokens"), F.sum("known")).first())
    scores = each_block(_scores, _OUT, known)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(o["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
