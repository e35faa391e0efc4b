"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the ``length - anchor_words + 1`` anchor hashes inside a window of ``length`` words the smallest
is an anchor (all, if several are), so equal windows always share one.  One row per anchor is sent, with a hash of its surroundings
(the words that any window over the anchor can hold).  Occurrences are joined on the anchor:

* surroundings that a smaller document has alike are repeats as they stand;
* where documents share an anchor in different surroundings, its words are looked up and matches are extended word by word to
  the right and to the left; what reaches ``length`` words is a repeat.

Neighbouring repeats are merged to maximal ones.  A window counts as repeated if the same words start in a document with a
smaller id; the words it covers go.

Scale: each map task first settles equal surroundings among its own documents, so a passage shared by a third of all rows reaches
the join as one row per task.  An anchor that is common inside a task (``hot`` surroundings), whose bucket would exceed ``most``
rows, or that more than ``crowd`` places ask for, is not joined in one task: its windows become rows of their own, counted with partial aggregation and joined by Spark,
which splits skewed keys.  Texts move compressed, once for the look-up and once for the cut.

Rows: null texts are empty; an empty text has no words.  Rows with one doc_id and different texts are told apart by a
text hash and keep their own spans; equal ids are never smaller than each other, so such rows do not remove each other.
A null doc_id counts as the smallest long.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.llm.shared import materialize, partitions
from oneway.llm.textkit import U64, Words, chunks, give_back, grams, group_starts, longs, mix, pack, sliding_min, text_buffer, text_bytes, tidied, unpack

NO_ID = -(1 << 63)
#: Anchors or windows up to this many are broadcast (8 or 40 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: Bytes of text whose anchors are found in one call; its arrays, of eight bytes a word and more, take many times as much.
SEED_BYTES = 512 << 10
#: Bytes of text that a task holds before it sends them by bucket.
HELD_BYTES = 24 << 20

SPAN, OPEN, WIDE = 1, 2, 3  # repeated words; an anchor to be extended; one to be extended window by window
_SENT = "bucket int, data binary"
_FOUND = "kind int, bucket int, id long, tag long, start int, n int, anchor long"
_CONTEXT = "wide boolean, bucket int, anchor long, id long, tag long, start int, n int, left int, words string"
_SPANS = "bucket int, id long, tag long, start int, n int"
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,words:int>>"


def _home(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document's text."""
    return (mix(ids.view(U64) ^ tags.view(U64)) % U64(buckets)).astype(np.int32)


def anchors(words: Words, h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, anchor, hash of its surroundings) of the winnowed anchors."""
    if len(h) < length:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, U64)
    g = grams(h, k, 1)
    least = sliding_min(g, length - k + 1)
    inside = np.arange(len(least)) <= np.repeat(words.first[1:], words.counts)[: len(least)] - length
    chosen = np.zeros(len(g), bool)
    for shift in range(length - k + 1):
        chosen[shift : shift + len(least)] |= inside & (g[shift : shift + len(least)] == least)
    at = np.flatnonzero(chosen)
    # texts are set apart by as many blanks as surroundings can reach beyond a text
    reach = length - k
    apart = at + (words.text_of_word()[at] + 1) * reach
    spread = np.zeros(len(h) + (words.n_texts + 1) * reach + length, U64)
    spread[np.arange(len(h)) + (words.text_of_word() + 1) * reach] = h
    whole = grams(spread, length, 2)
    return at, g[at], mix(whole[apart - reach] * U64(0x9FB21C651E98DF25) + whole[apart])


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, words) of the unions of spans that touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = (x[order].astype(np.int64) for x in (doc, start, end))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(doc * far + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * far + start[1:] > reach[:-1]
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - doc[at] * far - start[at]


def _least(ids: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The smallest id of each group of equal (sorted) keys, for every row."""
    at = group_starts(*keys)
    return np.repeat(np.minimum.reduceat(ids, at), np.diff(np.append(at, len(ids)))) if len(ids) else ids


def _blocks(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    at = group_starts(bucket[order])
    for lo, hi in zip(at, np.append(at[1:], len(order))):
        pick = order[lo:hi]
        yield int(bucket[pick[0]]), pack(np.array([kind], np.uint8), *(c[pick] for c in columns))


def _sent(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 64):
        part = rows[lo : lo + 64]
        yield pa.record_batch([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], names=["bucket", "data"])


def _seed(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int, hot_count: int, flush_words: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n_docs = n_words = 0

    def flush():
        ids, tags, size, doc, pos, anchor, around = (np.concatenate([x[i] for x in held]) for i in range(7))
        held.clear()
        if len(ids) != len(once := np.unique(np.stack([ids, tags.view(np.int64)]), axis=1, return_index=True)[1]):
            only = np.zeros(len(ids), bool)  # rows equal in id and text share their spans
            only[once] = True
            doc, pos, anchor, around = (x[only[doc]] for x in (doc, pos, anchor, around))
        # neighbours that agree in both hashes (a word repeated) are one run
        new = np.ones(len(doc), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (around[1:] != around[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(doc)))
        order = at[by := np.lexsort((around[at], anchor[at]))]
        doc, pos, anchor, around, run = doc[order], pos[order], anchor[order], around[order], run[by]
        of = ids[doc]
        gone = of > _least(of, anchor, around)
        rows = []
        d, s, n = _merged(doc[gone], np.maximum(pos[gone] - (length - k), 0), np.minimum(pos[gone] + run[gone] - 1 + length, size[doc[gone]]))
        rows += _blocks(SPAN, _home(ids[d], tags[d], buckets), ids[d], tags[d], s.astype(np.uint32), n.astype(np.uint32))
        # what has the smallest id of all is never repeated, so one of them stands for all
        stays = ~gone
        if len(of):
            first = np.zeros(len(of), bool)
            first[group_starts(anchor, around)] = True
            stays &= first | (of != NO_ID)
        doc, pos, anchor, around, run = (x[stays] for x in (doc, pos, anchor, around, run))
        if len(doc):
            at = group_starts(anchor)
            count = np.diff(np.append(at, len(anchor)))
            hot = np.repeat(count > hot_count, count)
            d = doc[hot]
            rows += _blocks(WIDE, _home(ids[d], tags[d], buckets), ids[d], tags[d], pos[hot].astype(np.uint32), run[hot].astype(np.uint32), anchor[hot])
            marks = anchor[at[count > hot_count]]
            cool = np.flatnonzero(~hot)
            bucket = (mix(np.concatenate([anchor[cool], marks])) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = group_starts(bucket[order])
            for lo, hi in zip(cut, np.append(cut[1:], len(order))):
                pick = order[lo:hi]
                own = cool[pick[pick < len(cool)]]
                used, local = np.unique(doc[own], return_inverse=True)
                parts = ids[used], tags[used], size[used].astype(np.uint32), local.astype(np.uint32), pos[own].astype(np.uint32), run[own].astype(np.uint32), anchor[own], around[own]
                rows.append((int(bucket[pick[0]]), pack(np.array([0], np.uint8), *parts, marks[pick[pick >= len(cool)] - len(cool)])))
        yield from _sent(rows)

    for batch in batches:
        for part in chunks(batch, most=SEED_BYTES):
            words = Words(*text_buffer(part.column("text")))
            at, anchor, around = anchors(words, words.hashes(), length, k)
            doc = words.text_of_word()[at]
            held.append((longs(part.column("doc_id")), part.column("tag").to_numpy().view(U64), words.counts, doc + n_docs, at - words.first[doc], anchor, around))
            n_docs += part.num_rows
            n_words += len(words)
            if n_words >= flush_words:
                yield from flush()
                n_docs = n_words = 0
                give_back()
    if held:
        yield from flush()


def _found(kind: np.ndarray, ids, tags, start, n, anchor, buckets: int) -> pa.RecordBatch:
    columns = [kind.astype(np.int32), _home(ids, tags, buckets), ids, tags.view(np.int64), start.astype(np.int32), n.astype(np.int32), anchor.view(np.int64)]
    return pa.record_batch([pa.array(c) for c in columns], names=["kind", "bucket", "id", "tag", "start", "n", "anchor"])


def _settle(batches: Iterator[pa.RecordBatch], length: int, k: int, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket.  Joins a bucket's anchors; reports repeats, and anchors to be extended."""

    def opened(parts: list[list[np.ndarray]]):
        for ids, tags, _, doc, pos, run, anchor, *_ in parts:
            yield _found(np.full(len(doc), WIDE), ids[doc], tags[doc], pos, run, anchor, buckets)

    def join(parts: list[list[np.ndarray]]):
        if not parts:
            return
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        ids, tags, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
        doc = np.concatenate([p[3].astype(np.int64) + b for p, b in zip(parts, base)])
        pos, run, anchor, around, marks = (np.concatenate([p[i] for p in parts]) for i in range(4, 9))
        order = np.lexsort((around, anchor))
        doc, pos, run, anchor, around = doc[order], pos[order].astype(np.int64), run[order].astype(np.int64), anchor[order], around[order]
        of = ids[doc]
        gone = of > _least(of, anchor, around)
        d, s, n = _merged(doc[gone], np.maximum(pos[gone] - (length - k), 0), np.minimum(pos[gone] + run[gone] - 1 + length, size[doc[gone]]))
        yield _found(np.full(len(d), SPAN), ids[d], tags[d], s, n, np.zeros(len(d), U64), buckets)
        doc, pos, run, anchor, of = (x[~gone] for x in (doc, pos, run, anchor, of))
        wide = np.isin(anchor, marks)
        several = _least(of, anchor) < -_least(-(of + 1), anchor) - 1  # -(x + 1) has no overflow
        pick = np.flatnonzero(wide | several)
        yield _found(np.where(wide[pick], WIDE, OPEN), ids[doc[pick]], tags[doc[pick]], pos[pick], run[pick], anchor[pick], buckets)

    parts, bucket, rows, over = [], None, 0, False
    for batch in batches:
        for b, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            kind, *columns = unpack(data.as_buffer())
            if kind[0] != 0:
                ids, tags, start, n = columns[:4]
                yield _found(np.full(len(ids), kind[0]), ids, tags, start, n, columns[4] if len(columns) > 4 else np.zeros(len(ids), U64), buckets)
                continue
            if b != bucket:
                yield from join(parts)
                parts, bucket, rows, over = [], b, 0, False
                give_back()
            parts.append(columns)
            rows += len(columns[3])
            if over or rows > most:
                yield from opened(parts)
                parts, over = [], True
    yield from join(parts)


def _pack_texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts by bucket; rows equal in id and text are sent once, with their number."""
    held: dict[int, dict] = {}
    size = 0

    def flush():
        rows = []
        while held:  # texts go as they are packed
            bucket, docs = held.popitem()
            ids, tags, null, n, raw = zip(*((*k, *v) for k, v in docs.items()))
            blob = np.frombuffer(b"".join(raw), np.uint8)
            rows.append((bucket, pack(np.array(ids, np.int64), np.array(tags, np.int64), np.array(null, np.uint8), np.array(n, np.int64), np.array([len(x) for x in raw], np.int64), blob)))
            del docs, raw, blob
            if len(rows) == 64:
                yield from _sent(rows)
                rows = []
        yield from _sent(rows)

    for batch in batches:
        for part in chunks(batch):
            ids, tags = longs(part.column("doc_id")), part.column("tag").to_numpy()
            null = part.column("doc_id").is_null().to_pylist()
            for b, d, t, none, raw in zip(_home(ids, tags, buckets).tolist(), ids.tolist(), tags.tolist(), null, text_bytes(part.column("text"))):
                docs = held.setdefault(b, {})
                docs[(d, t, none)] = (docs.get((d, t, none), (0,))[0] + 1, raw)
                size += len(raw)
            if size >= HELD_BYTES:
                yield from flush()
                size = 0
                give_back()
    if held:
        yield from flush()


def _texts(data: pd.Series) -> Iterator[tuple[int, int, bool, int, bytes]]:
    for blob in data:
        ids, tags, null, n, lengths, raw = unpack(blob)
        raw, at = raw.tobytes(), 0
        for d, t, none, m, size in zip(*(x.tolist() for x in (ids, tags, null, n, lengths))):
            yield d, t, bool(none), m, raw[at : at + size]
            at += size


def _look_up(texts: pd.DataFrame, asked: pd.DataFrame, length: int, k: int) -> pd.DataFrame:
    """The words around the anchors asked for."""
    give_back()  # of the bucket before
    by: dict[tuple[int, int], list] = {}
    for kind, d, t, start, n, anchor in zip(*(asked[c].tolist() for c in ("kind", "id", "tag", "start", "n", "anchor"))):
        by.setdefault((d, t), []).append((kind, start, n, anchor))
    bucket = int(asked["bucket"].iloc[0]) if len(asked) else 0
    out = []
    for d, t, _, _, raw in _texts(texts["data"]):
        wanted = by.pop((d, t), None)
        if wanted:
            words = raw.split()
            for kind, start, n, anchor in wanted:
                left = min(start, length - k)
                out.append((kind == WIDE, bucket, anchor, d, t, start, n, left, b" ".join(words[start - left : start + length]).decode()))
    return pd.DataFrame(out, columns=["wide", "bucket", "anchor", "id", "tag", "start", "n", "left", "words"])


def _classes(cls: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Classes split by the next word."""
    return np.unique(cls * (int(code.max(initial=0)) + 2) + code + 1, return_inverse=True)[1]


def extend(anchor: np.ndarray, ids: np.ndarray, left: np.ndarray, words: list[bytes], length: int, k: int) -> np.ndarray:
    """For each row and each number of words to the left, whether the window that begins there is in a row of the same (sorted)
    anchor with a smaller id.  Rows stay in one class as long as they agree, word by word to the right and to the left."""
    reach = length - k
    split = [w.split() for w in words]
    count = np.array([len(w) for w in split], np.int64)
    codes = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    table = np.full((len(ids), reach + length), -1, np.int64)
    row = np.repeat(np.arange(len(ids)), count)
    table[row, np.arange(len(codes)) - np.repeat(np.cumsum(count) - count, count) + reach - left[row]] = codes
    new = np.zeros(len(ids), np.int64)
    new[group_starts(anchor)] = 1
    cls = np.cumsum(new)
    right = {0: cls}
    for n in range(1, length + 1):
        right[n] = _classes(right[n - 1], table[:, reach + n - 1])
    found = np.zeros((len(ids), reach + 1), bool)
    to_left = np.zeros(len(ids), np.int64)
    for n in range(reach + 1):
        if n:
            to_left = _classes(to_left, table[:, reach - n])
        key = to_left * (int(right[length - n].max(initial=0)) + 1) + right[length - n]
        whole = np.flatnonzero((left >= n) & (count - left >= length - n))
        order = whole[np.argsort(key[whole], kind="stable")]
        found[order, n] = ids[order] > _least(ids[order], key[order])
    return found


def _extended(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a group may go over several batches."""
    rest = None

    def spans(table: pa.Table):
        anchor, ids, tags, start, n, left, bucket = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "id", "tag", "start", "n", "left", "bucket"))
        found = extend(anchor, ids, left, text_bytes(table.column("words").combine_chunks()), length, k)
        # neighbouring windows of a row are one longer match
        edge = np.zeros((len(ids), 1), bool)
        row, near = np.nonzero(found & ~np.concatenate([edge, found[:, :-1]], axis=1))
        _, far = np.nonzero(found & ~np.concatenate([found[:, 1:], edge], axis=1))
        columns = bucket[row].astype(np.int32), ids[row], tags[row], (start[row] - far).astype(np.int32), (far - near + length + n[row] - 1).astype(np.int32)
        yield pa.record_batch([pa.array(c) for c in columns], names=["bucket", "id", "tag", "start", "n"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        anchor = table.column("anchor").to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
        rest = table.slice(last)
        if last:
            yield from spans(table.slice(0, last))
    if rest is not None and rest.num_rows:
        yield from spans(rest)


def _few(keys: DataFrame) -> DataFrame:
    """Broadcast if they are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _by_window(wide: DataFrame, length: int, k: int, crowd: int) -> DataFrame:
    """Repeats around hot anchors: each window is a row, and joins the smallest id that has it; windows that a crowd has are joined apart
    from the others."""
    words = F.split("words", " ")
    rows = wide.select("bucket", "id", "tag", "start", "n", "left", words.alias("w")).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(length - k))))
    rows = rows.where((F.col("left") >= F.col("back")) & (F.size("w") - F.col("left") >= length - F.col("back")))
    key = F.md5(F.array_join(F.slice("w", F.col("left") - F.col("back") + 1, F.lit(length)), " ").cast("binary"))
    rows = rows.select("bucket", "id", "tag", (F.col("start") - F.col("back")).alias("start"), (F.col("n") - 1 + length).alias("n"), F.unhex(key).alias("key"))
    least = materialize(rows.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows")).where("least < most"), "windows")
    crowded = _few(least.where(F.col("rows") > crowd))
    found = rows.join(crowded.select("key"), "key", "left_anti").join(least.where(F.col("rows") <= crowd), "key").unionByName(rows.join(crowded, "key"))
    return found.where("id > least").select("bucket", "id", "tag", F.col("start").cast("int"), F.col("n").cast("int"))


def _cut(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
    """Remove the spans from a bucket's texts."""
    give_back()  # of the bucket before
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for d, t, s, n in zip(*(spans[c].tolist() for c in ("id", "tag", "start", "n"))):
        found.setdefault((d, t), []).append((s, n))
    out = []
    for d, t, none, m, raw in _texts(texts["data"]):
        words = raw.split()
        merged: list[list[int]] = []
        for s, n in sorted(found.get((d, t), ())):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s + n)
            else:
                merged.append([s, s + n])
        n_words = len(words)
        for s, e in reversed(merged):
            del words[s:e]
        row = (None if none else d, n_words, n_words - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), [{"start": s, "words": e - s} for s, e in merged])
        out += [row] * m
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]).astype({"doc_id": "Int64"})


def substring_dedup(docs: DataFrame, length: int = 13, anchor_words: int = 4, hot: int = 64, most: int = 4_000_000, crowd: int = 2_000, flush: int = 2_000_000) -> DataFrame:
    """One row per document: its word count, the words removed, the hash of what is kept, and the removed maximal spans
    (in words).  ``docs`` needs doc_id and text.  Whatever the limits, the result is the same: ``flush``: words that a map task settles
    among themselves at a time; ``hot``: surroundings of one anchor beyond which a task calls it hot; ``most``: anchors joined in one
    task's memory; ``crowd``: look-ups of one anchor that are extended in one task, and
    rows of one window that are joined in one."""
    spark, k = docs.sparkSession, anchor_words
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark, total)
    seeds = docs.mapInArrow(lambda it: tidied(_seed(it, length, k, n, hot, flush)), _SENT)
    found = materialize(seeds.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: tidied(_settle(it, length, k, n, most)), _FOUND), "found")
    texts = docs.mapInArrow(lambda it: tidied(_pack_texts(it, n)), _SENT).groupBy("bucket")
    context = texts.cogroup(found.where(F.col("kind") != SPAN).groupBy("bucket")).applyInPandas(lambda t, a: _look_up(t, a, length, k), _CONTEXT)
    context = materialize(context, "context")
    # the windows of anchors that many documents ask for are joined one by one, too
    many = materialize(context.where("not wide").groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowds")
    many = _few(many)
    near, far = context.where("not wide"), context.where("wide")
    near, far = near.join(many, "anchor", "left_anti"), far.unionByName(near.join(many, "anchor", "left_semi").select(context.columns))
    near = near.select(context.columns).repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: tidied(_extended(it, length, k)), _SPANS)
    spans = found.where(F.col("kind") == SPAN).select("bucket", "id", "tag", "start", "n")
    spans = spans.unionByName(near).unionByName(_by_window(far, length, k, crowd))
    return texts.cogroup(spans.groupBy("bucket")).applyInPandas(_cut, _OUT)
