"""Collocations from depth-limited count tries.

A phrase is 2 to 4 words of one piece of a text, pieces being cut at ``.,;:!?`` and line ends.  Everything is per language (null: ``und``).
A phrase that occurs at least FLOOR times is a candidate; its score is that of its weakest cut in two, floor(2,000,000 a / (l + r)),
where a, l and r count the phrase and its two parts.  Candidates that mostly stand inside a longer one are dropped.

1. Screen.  Words and pairs are counted by 64-bit hashes, per task and then by ranges of the hash.  Those that reach FLOOR set bits of a
   filter of at most FILTER_BITS, whatever the corpus: hashes that meet, and a full filter, let more through and lose nothing.
2. Tries.  Each shard (a map task, or as much of it as MOST_LEAVES holds) walks from every word along words whose pairs pass, four deep at
   most, and counts the paths in a trie: sorted paths of word numbers with counts, and a sorted dictionary, both exact.  A trie is serialised in
   ranges of its prefixes (of the hash of a path's first three words), and each range of all shards is merged by one task, a few at a time.
   A node's count is the sum over the paths that lead through it.  Nodes of three words and more are whole in a range; shorter ones,
   as a frequent word that starts a third of all paths, lie in many, are summed there and then added up by Spark.
3. Parts.  A node's prefixes are the nodes that its path walks through; its suffix links lead to the nodes without its first words.  Both
   are looked up for every cut by joins of the node table, which holds only what occurs FLOOR times.

Shards count before they send, so a row that repeats costs one path; no group of documents, phrase or language meets in one task but the
last choice, which is made in parts first.  Words are runs of bytes other than space, tab, the cuts and line ends, A-Z lower-cased.

Rows: null texts and texts without words count nothing.  Rows that repeat count as often as they stand.  Ties of scores go to the larger
count, then to the phrase that is smaller in UTF-8; ties of cuts to the shorter left part.  Columns but lang and text are left out,
whatever they are called.  An empty table gives none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.llm.shared import materialize, partitions
from oneway.llm.textkit import U64, Words, chunks, grams, group_starts, mix, pack, text_buffer, unpack

FLOOR = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if a longer one that contains it has this share of its count, in hundredths.
COVERED = 80
FILTER_BITS = 1 << 27
SEGMENT_BYTES = 1 << 15
#: Hashes, and paths, that a task holds before it sends them on.
MOST_KEYS, MOST_LEAVES = 2_000_000, 1_000_000

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?\n\x0b\x0c\r"]] = True
_SEP = _CUT.copy()
_SEP[[9, 32]] = True
_LOW = U64(0xFFFFFFFF)


class Pieces(Words):
    """Words of texts, and which of them stand next to the following one in a piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        super().__init__(buf, offsets, _SEP, lower=True)
        cuts = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_CUT[buf], out=cuts[1:])
        text = self.text_of_word()
        self.text = text
        self.joined = (text[1:] == text[:-1]) & (cuts[self.starts[1:]] == cuts[self.ends[:-1]]) if len(text) else np.zeros(0, bool)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: words, languages, hash of each word, and the keys of words and of pairs with their languages."""
    for batch in batches:
        for part in chunks(batch):
            words = Pieces(*text_buffer(part.column("text")))
            if not len(words):
                continue
            langs = part.column("lang").to_pylist()
            salt = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], U64)[words.text]
            h = words.hashes()
            yield words, langs, h, mix(h ^ salt), mix(grams(h, 2) ^ salt[:-1]) ^ U64(1)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = group_starts(k)
    return k[at], np.add.reduceat(n, at) if len(at) else n


class KeyCounts:
    """Counts of hashes, summed whenever as many wait as are held."""

    def __init__(self):
        self.keys, self.counts, self.held, self.size = [], [], 0, 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > max(2 * self.held, MOST_KEYS // 4):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, U64), np.empty(0, np.int64)
        k, n = _merged(self.keys, self.counts)
        self.keys, self.counts, self.held, self.size = [k], [n], len(k), len(k)
        return k, n


def _screen(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = KeyCounts()

        def send() -> Iterator[pa.RecordBatch]:
            k, n = held.settle()
            edges = np.searchsorted(k, (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(U64)) if buckets > 1 else np.empty(0, np.int64)
            rows = [(i, pack(np.diff(x, prepend=U64(0)), y.astype(np.uint32 if y.max(initial=0) < 1 << 32 else np.int64))) for i, (x, y) in enumerate(zip(np.split(k, edges), np.split(n, edges))) if len(x)]
            for at in range(0, len(rows), 256):
                yield pa.record_batch([pa.array([r[0] for r in rows[at : at + 256]], pa.int32()), pa.array([r[1] for r in rows[at : at + 256]], pa.binary())], names=["bucket", "keys"])

        for words, _, _, single, pairs in _read(batches):
            for keys in (single, pairs[words.joined]):
                held.add(*np.unique(keys, return_counts=True))
            if held.held > MOST_KEYS:
                yield from send()
                held = KeyCounts()
        yield from send()

    return run


def _frequent(floor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, KeyCounts()

        def send() -> pa.RecordBatch:
            k, n = held.settle()
            k = k[n >= floor]
            return pa.record_batch([pa.array([len(k)], pa.int64()), pa.array([pack(k)], pa.binary())], names=["n", "keys"])

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                if own is not None and bucket != own:
                    yield send()
                    held = KeyCounts()
                own = bucket
                k, n = unpack(blob)
                held.add(np.cumsum(k, dtype=U64), n.astype(np.int64))
        if own is not None:
            yield send()

    return run


class Filter:
    """Two bits for each key that passed the screen."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        shift = U64(64 - bits)
        return mix(keys) >> shift, mix(keys ^ U64(0x5851F42D4C957F2D)) >> shift

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            out &= self.data[at >> U64(3)] >> (at & U64(7)).astype(np.uint8) & 1 > 0
        return out


def _filter(frequent: DataFrame) -> Filter:
    """The filter over a written table of keys, or-ed segment by segment; the driver receives FILTER_BITS at most."""
    keys = frequent.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS.bit_length() - 1, max(18, (16 * keys).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            for blob in batch.column("keys").to_pylist():
                for at in Filter.places(unpack(blob)[0], bits):
                    np.bitwise_or.at(data, at >> U64(3), np.left_shift(1, at & U64(7), dtype=np.uint8, casting="unsafe"))
        parts = data.reshape(-1, SEGMENT_BYTES)
        used = np.flatnonzero(parts.any(1))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used.tolist()], pa.binary())], names=["segment", "data"])

    def united(key: tuple, table: pa.Table) -> pa.Table:
        data = np.zeros(SEGMENT_BYTES, np.uint8)
        for x in table.column("data").to_pylist():
            data |= np.frombuffer(x, np.uint8)
        return pa.table({"segment": [key[0].as_py()], "data": [data.tobytes()]}, pa.schema([("segment", pa.int32()), ("data", pa.binary())]))

    data = np.zeros((1 << bits - 3) // SEGMENT_BYTES * SEGMENT_BYTES, np.uint8)
    for r in frequent.select("keys").mapInArrow(spread, "segment int, data binary").groupBy("segment").applyInArrow(united, "segment int, data binary").collect():
        data[r["segment"] * SEGMENT_BYTES : (r["segment"] + 1) * SEGMENT_BYTES] = np.frombuffer(r["data"], np.uint8)
    return Filter(bits, data)


class Trie:
    """Sorted paths (language, up to four words; numbers from 1 in a sorted dictionary, 0 for none) and how often each was walked."""

    def __init__(self, words: pa.Array, hashes: np.ndarray, top: np.ndarray, middle: np.ndarray, last: np.ndarray, counts: np.ndarray):
        self.words, self.hashes, self.top, self.middle, self.last, self.counts = words, hashes, top, middle, last, counts

    def __len__(self) -> int:
        return len(self.top)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        together = pa.concat_arrays([t.words for t in tries]).dictionary_encode()
        number, words = together.indices.to_numpy(zero_copy_only=False), together.dictionary
        order = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes = np.empty(len(order), U64)
        hashes[rank[number]] = np.concatenate([t.hashes for t in tries])
        tops, middles, lasts, at = [], [], [], 0
        for t in tries:
            new = np.concatenate([np.zeros(1, U64), (rank[number[at : at + len(t.words)]] + 1).astype(U64)])
            at += len(t.words)
            tops.append(new[t.top >> U64(32)] << U64(32) | new[t.top & _LOW])
            middles.append(new[t.middle >> U64(32)] << U64(32) | new[t.middle & _LOW])
            lasts.append(new[t.last])
        top, middle, last, counts = (np.concatenate(x) for x in (tops, middles, lasts, [t.counts for t in tries]))
        order = np.lexsort((last, middle, top))
        top, middle, last, counts = top[order], middle[order], last[order], counts[order]
        at = group_starts(top, middle, last)
        return cls(words.take(pa.array(np.argsort(rank))), hashes, top[at], middle[at], last[at], np.add.reduceat(counts, at) if len(at) else counts)

    def ranges(self, n: int) -> np.ndarray:
        """The prefix range of each path: that of the hash of its language and first three words."""
        of = np.concatenate([np.zeros(1, U64), self.hashes])
        h = np.zeros(len(self), U64)
        for x in (self.top >> U64(32), self.top & _LOW, self.middle >> U64(32), self.middle & _LOW):
            h = mix(h * U64(0x9FB21C651E98DF25) ^ of[x])
        return (h % U64(n)).astype(np.int64)

    def taken(self, rows: np.ndarray) -> Trie:
        """Some of the paths, with the words that they use."""
        cols = [self.top[rows] >> U64(32), self.top[rows] & _LOW, self.middle[rows] >> U64(32), self.middle[rows] & _LOW, self.last[rows]]
        used = np.unique(np.concatenate([np.zeros(1, U64), *cols]))
        lang, one, two, three, four = (np.searchsorted(used, c).astype(U64) for c in cols)
        own = used[1:].astype(np.int64) - 1
        return Trie(self.words.take(pa.array(own)), self.hashes[own], lang << U64(32) | one, two << U64(32) | three, four, self.counts[rows])

    def packed(self) -> bytes:
        buf, offsets = text_buffer(self.words)
        return pack(buf, np.diff(offsets).astype(np.int32), self.hashes, *(x.astype(np.uint32) for x in (self.top >> U64(32), self.top & _LOW, self.middle >> U64(32), self.middle & _LOW, self.last)), self.counts)

    @classmethod
    def unpacked(cls, blob: bytes) -> Trie:
        buf, sizes, hashes, lang, one, two, three, four, counts = unpack(blob)
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf.tobytes())])
        wide = [x.astype(U64) for x in (lang, one, two, three, four)]
        return cls(words, hashes, wide[0] << U64(32) | wide[1], wide[2] << U64(32) | wide[3], wide[4], counts)

    def nodes(self, floor: int) -> pa.RecordBatch:
        """Language, phrase and count of the nodes, by sums over the sorted paths below; those of three words and more are whole, and
        go if they miss the floor."""
        names = pa.concat_arrays([pa.array([b""], pa.large_binary()), self.words])
        take = lambda x: names.take(pa.array(x.astype(np.int64)))
        keys = ([self.top >> U64(32)], [self.top], [self.top, self.middle >> U64(32)], [self.top, self.middle], [self.top, self.middle, self.last])
        present = (None, self.top & _LOW, self.middle >> U64(32), self.middle & _LOW, self.last)
        cols: list[list] = [[], [], [], []]
        for depth, (key, here) in enumerate(zip(keys, present)):
            rows = np.arange(len(self)) if here is None else np.flatnonzero(here)
            if not len(rows):
                continue
            at = group_starts(*(k[rows] for k in key))
            n, first = np.add.reduceat(self.counts[rows], at), rows[at]
            if depth > 2:
                n, first = n[n >= floor], first[n >= floor]
            parts = [take(x[first]) for x in (self.top & _LOW, self.middle >> U64(32), self.middle & _LOW, self.last)[:depth]]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if depth else pa.array([b""] * len(first), pa.large_binary())
            for c, x in zip(cols, (take(self.top[first] >> U64(32)), phrase, pa.array([depth] * len(first), pa.int32()), pa.array(n, pa.int64()))):
                c.append(x)
        lang, phrase, depth, n = (pa.concat_arrays(c) for c in cols)
        return pa.record_batch([lang.cast(pa.binary()).cast(pa.string()), phrase.cast(pa.binary()).cast(pa.string()), depth, n], names=["lang", "phrase", "words", "n"])


def _walked(words: Pieces, langs: list[str], h: np.ndarray, single: np.ndarray, pairs: np.ndarray) -> Trie:
    """The trie of a slice of texts; ``single`` and ``pairs`` say which words and pairs pass."""
    names = sorted(set(langs))
    lang = np.array([names.index(x) + 1 for x in langs], U64)[words.text]
    here = np.flatnonzero(single)
    starts, ends = words.starts[here], words.ends[here]
    edge = np.zeros(len(words.buf) + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(here), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.buf[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes())]).dictionary_encode()
    number = np.zeros(len(words) + LONGEST, np.int64)
    number[here] = spelled.indices.to_numpy(zero_copy_only=False)
    hashes = np.zeros(len(names) + len(spelled.dictionary), U64)
    hashes[: len(names)] = [xxhash.xxh3_64_intdigest(x.encode()) for x in names]
    hashes[len(names) + number[here]] = h[here]
    number[here] += len(names) + 1
    number = number.astype(U64)
    on = np.zeros(len(words) + LONGEST, bool)
    on[: len(pairs)] = pairs
    n = len(words)
    two = on[:n]
    three = two & on[1 : n + 1]
    four = three & on[2 : n + 2]
    top = lang << U64(32) | number[:n]
    middle = np.where(two, number[1 : n + 1], U64(0)) << U64(32) | np.where(three, number[2 : n + 2], U64(0))
    last = np.where(four, number[3 : n + 3], U64(0))
    short, counts = np.unique(top[~two], return_counts=True)
    none, deep = np.zeros(len(short), U64), np.flatnonzero(two)
    dictionary = pa.concat_arrays([pa.array([x.encode() for x in names], pa.large_binary()), spelled.dictionary])
    return Trie(dictionary, hashes, np.concatenate([short, top[deep]]), np.concatenate([none, middle[deep]]), np.concatenate([none, last[deep]]), np.concatenate([counts, np.ones(len(deep), np.int64)]))


class Shard:
    """Tries that wait to be merged: two when the later ones have as many paths as the first."""

    def __init__(self):
        self.tries: list[Trie] = []

    def add(self, trie: Trie) -> None:
        self.tries.append(trie)
        if sum(map(len, self.tries[1:])) > max(len(self.tries[0]), MOST_LEAVES // 4):
            self.settle()

    def settle(self) -> Trie | None:
        if self.tries:
            self.tries = [Trie.merged(self.tries)]
        return self.tries[0] if self.tries else None


def _tries(found: Broadcast, n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, shard = found.value.has, Shard()

        def send() -> Iterator[pa.RecordBatch]:
            trie = shard.settle()
            if trie is None:
                return
            of = trie.ranges(n)
            order = np.argsort(of, kind="stable")
            for rows in np.split(order, group_starts(of[order])[1:]):
                yield pa.record_batch([pa.array([int(of[rows[0]])], pa.int32()), pa.array([trie.taken(rows).packed()], pa.binary())], names=["range", "trie"])

        for words, langs, h, single, pairs in _read(batches):
            ok = words.joined.copy()
            ok[ok] = passes(pairs[ok])
            shard.add(Trie.merged([_walked(words, langs, h, passes(single), ok)]))
            if len(shard.tries) == 1 and len(shard.tries[0]) > MOST_LEAVES:
                yield from send()
                shard = Shard()
        yield from send()

    return run


def _merge(floor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = None, Shard()
        for batch in batches:
            for at, blob in zip(batch.column("range").to_pylist(), batch.column("trie").to_pylist()):
                if own is not None and at != own:
                    yield shard.settle().nodes(floor)
                    shard = Shard()
                own = at
                shard.add(Trie.unpacked(blob))
        if own is not None:
            yield shard.settle().nodes(floor)

    return run


def phrase_counts(documents: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(lang, phrase, words, n) of words and phrases of up to four words that occur at least ``floor`` times and, with no words, of all
    word occurrences of each language."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark, 2 * size, 64 << 20)
    keys = docs.mapInArrow(_screen(n), "bucket int, keys binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    frequent = materialize(keys.mapInArrow(_frequent(floor), "n long, keys binary"), "frequent")
    found = spark.sparkContext.broadcast(_filter(frequent))
    tries = docs.mapInArrow(_tries(found, n), "range int, trie binary").repartition(n, "range").sortWithinPartitions("range")
    nodes = tries.mapInArrow(_merge(floor), "lang string, phrase string, words int, n long")
    counted = nodes.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return materialize(counted.where((F.col("n") >= floor) | (F.col("words") == 0)), "phrases")


def _inner(longest: int) -> list[tuple[int, int, int]]:
    """(words of a candidate, words skipped, words kept) of every shorter phrase inside."""
    return [(m, skip, keep) for m in range(3, longest + 1) for keep in range(2, m) for skip in range(m - keep + 1)]


def _span(phrase: Column, skip: int, keep: int) -> Column:
    return F.substring_index(F.substring_index(phrase, " ", skip + keep), " ", -keep)


def collocations(documents: DataFrame, top: int | None = TOP, floor: int = FLOOR, covered: int = COVERED) -> DataFrame:
    """The ``top`` candidates of each language (all, if null) with their rank, counts of the phrase and of both parts of its weakest cut,
    the language's words, and the score."""
    counts = phrase_counts(documents, floor)
    nodes = counts.where("words > 0").select("lang", "phrase", "words", "n")
    found = nodes.where("words > 1").withColumnRenamed("n", "a")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cut = found.select("*", cuts).withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    prefix = nodes.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    suffix = nodes.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    score = F.expr("cast(2000000 * cast(a as decimal(38, 0)) div cast(l + r as decimal(38, 0)) as long)").alias("score")
    weakest = cut.join(prefix, ["lang", "left"]).join(suffix, ["lang", "right"]).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))
    inside = F.explode(F.filter(F.array(*(F.when(F.col("words") == m, _span(F.col("phrase"), s, k)) for m, s, k in _inner(LONGEST))), lambda x: x.isNotNull()))
    longer = found.where("words > 2").select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))
    total = counts.where("words = 0").select("lang", F.col("n").alias("__n"))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # in parts first, so that no language meets in one task
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        rows = rows.withColumn("__part", part).withColumn("__r", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*best))).where(F.col("__r") <= top).drop("__part", "__r")
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", *(["rank"] if top is not None else []), "phrase", "a", "l", "r", F.col("__n").alias("n"), "score")


def collocations_sql(top: int = TOP, floor: int = FLOOR, covered: int = COVERED) -> str:
    cut = r"[.,;:!?\n\x0B\x0C\r]"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    span = lambda k: f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    inside = ", ".join(f"CASE WHEN m = {m} THEN array_to_string(w[{s + 1}:{s + k}], ' ') END" for m, s, k in _inner(LONGEST))
    return f"""WITH pc AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '{cut}')) AS piece FROM documents),
    ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pc),
    g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS m, unnest({span(k)}) AS phrase FROM ws WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))}),
    f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= {floor}),
    tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
    c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
    k AS (SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM c, range(1, {LONGEST}) x(k) WHERE k < m),
    s AS (SELECT k.lang, k.phrase, k.a, list_min(list({{'s': ((2000000::HUGEINT * k.a) // (l.n + r.n))::BIGINT, 'k': k.k, 'l': l.n, 'r': r.n}})) AS b FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.lp JOIN f r ON r.lang = k.lang AND r.phrase = k.rp GROUP BY ALL),
    o AS (SELECT lang, i AS phrase, max(a) AS a FROM (SELECT lang, a, unnest(list_filter([{inside}], lambda x: x IS NOT NULL)) AS i FROM c WHERE m > 2) GROUP BY ALL),
    t AS (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY b.s DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, b.l AS l, b.r AS r, b.s AS score FROM s LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.a IS NULL OR 100 * o.a < {covered} * s.a)
    SELECT t.lang, rank, t.phrase, t.a, t.l, t.r, tot.n, score FROM t JOIN tot USING (lang) WHERE rank <= {top}"""
