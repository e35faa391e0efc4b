"""Secrets in texts: three fixed patterns, and what looks like the credentials that these find, by inferred grammars.

1. Labels.  The patterns find assigned passwords and keys (assign), access key ids (access) and long hexadecimal strings (hex); what they match are
   labelled credentials.  One pass over all texts sends them on, once per task, and counts which character follows which
   in the rest of the texts: a table of fixed size.
2. Grammar.  Of each kind at most SAMPLE distinct credentials of up to LONGEST_LABEL characters, those with the smallest hashes, make a prefix
   tree with counts.  Its states are merged where a Hoeffding bound cannot tell their endings and next characters apart, nor those of
   the states they lead to; a state that differs from all merged ones becomes a state of its own.  What is left is a
   probabilistic automaton per kind (none for a kind with fewer than LEAST_LABELS credentials).
3. Scan.  Every run of at least SHORTEST characters of ``[A-Za-z0-9+/_-]`` outside the labelled spans is scored whole by every automaton and by the
   table of followers.  It is reported if one automaton finds it as likely, per character, as all but one in a hundred of its own
   credentials, and more likely than the table by MARGIN nats.

Texts never move: both passes are maps, and only the automata (bounded by the sample) and the table are broadcast.

Rows: null and empty texts have no spans; rows that repeat are scanned each.  Spans are counted in code points, the end excluded, and stand by
start, then by kind as listed above, added ones (kind ``format``) last.  Columns but doc_id and text are left out, whatever they are called.
An empty table gives none."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.llm.shared import materialize
from oneway.llm.textkit import Words, chunks, text_buffer

KINDS = ("assign", "access", "hex")
ADDED = "format"
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: What a text with an assigned secret has, for a first look.
HINT = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Labelled credentials of a kind that a grammar is inferred from, at most and at least, and their length at most.
SAMPLE, LEAST_LABELS, LONGEST_LABEL = 2000, 8, 256
#: Characters of a candidate, at least; nats by which it is more likely as a credential than as text; share of credentials less likely.
SHORTEST, MARGIN, TAIL = 12, 12.0, 0.01
#: Chance that states of one distribution are told apart, and occurrences below which a state is not told from any.
ALPHA, EVIDENCE = 0.01, 12
SMOOTH = 0.01

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SYMBOLS = len(ALPHABET)
#: Number of a byte; SYMBOLS stands for anything else and for both ends.
NUMBER = np.full(256, SYMBOLS, np.int64)
NUMBER[list(ALPHABET)] = np.arange(SYMBOLS)
_HEX = np.ones(256, bool)
_HEX[list(b"0123456789abcdef")] = False
_RUN = NUMBER == SYMBOLS

#: text of the slice, start and end in bytes of the slice, kind, start and end of the credential itself
Span = tuple[int, int, int, str, int, int]


def labelled_spans(texts: pa.Array, buf: np.ndarray, offsets: np.ndarray) -> list[Span]:
    """What the patterns find in a slice of texts, from left to right without overlap for each kind."""
    out: list[Span] = []
    runs = Words(buf, offsets, _HEX)
    long = np.flatnonzero(runs.ends - runs.starts >= LEAST["hex"])
    if len(long):
        of = np.searchsorted(runs.first, long, "right") - 1
        out += [(d, s, e, "hex", s, e) for d, s, e in zip(of.tolist(), runs.starts[long].tolist(), runs.ends[long].tolist())]
    for kind, pattern, hint in (("access", ACCESS, pc.match_substring(texts, "AKIA")), ("assign", ASSIGN, pc.match_substring_regex(texts, HINT))):
        for d in np.flatnonzero(hint.fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            at = int(offsets[d])
            for m in pattern.finditer(buf[at : offsets[d + 1]].tobytes()):
                group = m.span(m.re.groups)
                if group[1] - group[0] >= LEAST[kind]:
                    out.append((d, at + m.start(), at + m.end(), kind, at + group[0], at + group[1]))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[Span]]]:
    for batch in batches:
        for part in chunks(batch):
            texts = part.column("text")
            buf, offsets = text_buffer(texts)
            yield part, buf, offsets, labelled_spans(texts, buf, offsets)


def followers(buf: np.ndarray, offsets: np.ndarray, spans: list[Span]) -> np.ndarray:
    """How often each symbol follows each outside the spans; whatever is not of the alphabet, and either end of a text, is one symbol."""
    symbols = NUMBER[buf]
    for _, start, end, *_ in spans:
        symbols[start:end] = SYMBOLS
    wide = SYMBOLS + 1
    counts = np.bincount(symbols[:-1] * wide + symbols[1:], minlength=wide * wide) if len(symbols) else np.zeros(wide * wide, np.int64)
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(symbols))]
    edges = np.unique(edges)
    before, after = symbols[edges - 1], symbols[edges]
    counts -= np.bincount(before * wide + after, minlength=wide * wide)
    counts += np.bincount(before * wide + SYMBOLS, minlength=wide * wide) + np.bincount(SYMBOLS * wide + after, minlength=wide * wide)
    return counts.reshape(wide, wide)


class Tree:
    """A prefix tree of strings with counts, whose states are merged in place: endings, and per symbol the state it leads to and how
    often."""

    def __init__(self, values: list[bytes]):
        self.seen, self.ends, self.next, self.went = [0], [0], [{}], [{}]
        for value in values:
            self.add(NUMBER[np.frombuffer(value, np.uint8)].tolist())

    def add(self, symbols: list[int]) -> None:
        state = 0
        self.seen[0] += 1
        for s in symbols:
            self.went[state][s] = self.went[state].get(s, 0) + 1
            if s not in self.next[state]:
                self.next[state][s] = len(self.seen)
                for column, empty in ((self.seen, 0), (self.ends, 0), (self.next, {}), (self.went, {})):
                    column.append(empty)
            state = self.next[state][s]
            self.seen[state] += 1
        self.ends[state] += 1

    def alike(self, a: int, b: int) -> bool:
        """Whether no Hoeffding bound tells two states apart, nor the states that both lead to."""
        width, pairs = math.sqrt(0.5 * math.log(2 / ALPHA)), [(a, b)]
        while pairs:
            a, b = pairs.pop()
            m, n = self.seen[a], self.seen[b]
            if m < EVIDENCE or n < EVIDENCE:
                continue
            bound = width * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[a] / m - self.ends[b] / n) > bound:
                return False
            for s in self.went[a].keys() | self.went[b].keys():
                if abs(self.went[a].get(s, 0) / m - self.went[b].get(s, 0) / n) > bound:
                    return False
                if s in self.next[a] and s in self.next[b]:
                    pairs.append((self.next[a][s], self.next[b][s]))
        return True

    def fold(self, into: int, state: int) -> None:
        """Add a state and all below it, which is a tree still, to another."""
        pairs = [(into, state)]
        while pairs:
            a, b = pairs.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for s, to in self.next[b].items():
                self.went[a][s] = self.went[a].get(s, 0) + self.went[b][s]
                if s in self.next[a]:
                    pairs.append((self.next[a][s], to))
                else:
                    self.next[a][s] = to

    def merge(self) -> list[int]:
        """The states that are left; of those next to them, the most frequent is merged with the first it is like, or joins them."""
        kept = [0]
        while True:
            settled = set(kept)
            edge = [(-self.seen[to], to, a, s) for a in kept for s, to in self.next[a].items() if to not in settled]
            if not edge:
                return kept
            _, state, parent, symbol = min(edge)
            like = next((a for a in kept if self.alike(a, state)), None)
            if like is None:
                kept.append(state)
            else:
                self.next[parent][symbol] = like
                self.fold(like, state)


class Automaton:
    """Log probabilities of symbols and of the end by state, and where symbols lead; the last state takes what was never seen."""

    def __init__(self, values: list[bytes]):
        tree = Tree(values)
        kept = tree.merge()
        place, lost, kinds = {s: i for i, s in enumerate(kept)}, len(kept), SYMBOLS + 1
        self.to = np.full((lost + 1, SYMBOLS), lost, np.int32)
        self.log = np.full((lost + 1, kinds), -math.log(kinds))
        for i, s in enumerate(kept):
            p = np.full(kinds, SMOOTH)
            p[SYMBOLS] += tree.ends[s]
            for symbol, n in tree.went[s].items():
                p[symbol] += n
                self.to[i, symbol] = place[tree.next[s][symbol]]
            self.log[i] = np.log(p / p.sum())
        own = self.score(*_symbols(values))
        self.floor = float(np.quantile(own / np.array([len(v) + 1 for v in values]), TAIL))

    def score(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of each string, all strings one symbol on at a time."""
        total, state, live = np.zeros(len(starts)), np.zeros(len(starts), np.int64), np.arange(len(starts))
        order = np.argsort(sizes, kind="stable")
        done = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0)) + 1), "right")
        for i in range(int(sizes.max(initial=0))):
            live = order[done[i] :]
            s = symbols[starts[live] + i]
            total[live] += self.log[state[live], s]
            state[live] = self.to[state[live], s]
        return total + self.log[state, SYMBOLS]


def _symbols(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values], np.int64)
    return NUMBER[np.frombuffer(b"".join(values), np.uint8)], np.cumsum(sizes) - sizes, sizes


class Grammar:
    """The automata by kind, and the log probabilities of followers in text."""

    def __init__(self, labelled: dict[str, list[bytes]], text: np.ndarray):
        self.kinds = {k: Automaton(v) for k, v in labelled.items() if len(v) >= LEAST_LABELS}
        smooth = text + 0.5
        self.text = np.log(smooth / smooth.sum(1, keepdims=True))

    def judge(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By how many nats each run is more likely as a credential of a kind whose floor it reaches; minus infinity if of none."""
        sizes, best = ends - starts, np.full(len(starts), -np.inf)
        if not len(starts) or not self.kinds:
            return best
        inside = np.concatenate([[0.0], np.cumsum(self.text[symbols[:-1], symbols[1:]])]) if len(symbols) else np.zeros(1)
        plain = inside[ends - 1] - inside[starts] + self.text[SYMBOLS, symbols[starts]] + self.text[symbols[ends - 1], SYMBOLS]
        for a in self.kinds.values():
            p = a.score(symbols, starts, sizes)
            best = np.where(p / (sizes + 1) >= a.floor, np.maximum(best, p - plain), best)
        return best


_LABELS = "kind string, value string, n long"


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    follow, found = np.zeros((SYMBOLS + 1, SYMBOLS + 1), np.int64), set()

    def send(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "n"])

    for _, buf, offsets, spans in _slices(batches):
        follow += followers(buf, offsets, spans)
        for _, _, _, kind, start, end in spans:
            # characters that candidates cannot have part a credential in several
            found |= {(kind, v.decode(), 1) for v in re.split(rb"[.=]+", buf[start:end].tobytes()) if LEAST["assign"] <= len(v) <= LONGEST_LABEL}
        if len(found) > 100_000:
            yield send(list(found))
            found = set()
    yield send([*found, *(("", str(i), n) for i, n in enumerate(follow.ravel().tolist()) if n)])


def infer(documents: DataFrame, sample: int = SAMPLE) -> Grammar:
    """The grammars of the credentials that the patterns find in the documents; the driver receives ``sample`` of each kind."""
    rows = documents.select("text").where("text is not null").mapInArrow(_label, _LABELS)
    rows = materialize(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")), "labels")
    text = np.zeros((SYMBOLS + 1) ** 2)
    for r in rows.where("kind = ''").collect():  # as many rows as pairs of symbols at most
        text[int(r["value"])] = r["n"]
    labelled = {k: [r["value"].encode() for r in rows.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample).collect()] for k in KINDS}
    return Grammar(labelled, text.reshape(SYMBOLS + 1, SYMBOLS + 1))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _scan(grammar: Callable[[], Grammar], margin: float) -> Callable:
    kind_order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = grammar()
        for part, buf, offsets, spans in _slices(batches):
            runs = Words(buf, offsets, _RUN)
            taken = np.zeros(len(buf) + 1, np.int64)
            for _, start, end, *_ in spans:
                taken[start + 1 : end + 1] = 1
            taken = np.cumsum(taken)
            pick = np.flatnonzero((runs.ends - runs.starts >= SHORTEST) & (taken[runs.ends] == taken[runs.starts]))
            score = model.judge(NUMBER[buf], runs.starts[pick], runs.ends[pick])
            hit = score >= margin
            of = np.searchsorted(runs.first, pick[hit], "right") - 1
            rows: list[list] = [[] for _ in range(part.num_rows)]
            added = zip(of.tolist(), runs.starts[pick[hit]].tolist(), runs.ends[pick[hit]].tolist(), score[hit].tolist())
            for d, start, end, kind, value in [*((d, s, e, k, None) for d, s, e, k, *_ in spans), *((d, s, e, ADDED, v) for d, s, e, v in added)]:
                rows[d].append((start, kind_order[kind], end, kind, value))
            out = []
            for d, own in enumerate(rows):
                if own:
                    at = int(offsets[d])
                    points = np.concatenate([[0], np.cumsum(buf[at : offsets[d + 1]] & 0xC0 != 0x80)])
                    own = [{"kind": kind, "start": int(points[start - at]), "end": int(points[end - at]), "score": value} for start, _, end, kind, value in sorted(own, key=lambda x: x[:3])]
                out.append(own)
            yield pa.record_batch([part.column("doc_id"), pa.array(out, schema)], names=["doc_id", "spans"])

    return run


def secret_spans(documents: DataFrame, grammar: Grammar | None = None, margin: float = MARGIN) -> DataFrame:
    """(doc_id, spans): kind, start, end and, of added spans, the nats by which they are more likely as credentials than as text."""
    shared = documents.sparkSession.sparkContext.broadcast(grammar or infer(documents))
    return documents.select("doc_id", "text").mapInArrow(_scan(lambda: shared.value, margin), f"doc_id long, spans {SPANS}")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the pattern's spans and all spans as text, kind:start:end joined by commas."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
