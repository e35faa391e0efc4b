"""Repairs the structure of conversations by an A* search for the cheapest edits.

A conversation is legal if its role initials read ``(s?(ua)+)?``.  Its messages are kept (K, no cost), given the role that is due (R, 2) or
deleted (D, 3); an empty message of the role that is due may be inserted anywhere (I, 2).  Blank and duplicate messages have to go, a
truncated one that stays costs 1.  The edits are a path in the lattice (messages behind, last role): what role is due depends on the last
role alone, so a string of edits fixes the result.  The search's heuristic sums, over the messages ahead, 3 for each that has to go and 1
for each truncated one (it is deleted or charged), which never exceeds the rest of the cost; its queue is keyed (cost plus heuristic,
edits), so the first path that ends is the cheapest and, of equals, the least in ASCII.

A conversation of up to LONG_ROWS messages is searched whole, one at a time as sorted rows stream by.  A longer one, which may hold any share of
all rows, is dealt by ranges of its order to many tasks and cut in blocks: each block gives its costs from every last role to every other,
a fold over these small tables says what each way out of a block costs from there on, and the same search then runs block by block
towards these costs.  Only the digest of the repaired text is a fold over all blocks, which holds one block at a time.

Rows: null roles and texts count as one space; messages stand by turn, nulls first, then by role and text in UTF-8 order, so that rows
which repeat are duplicates.  A null conv_id is a conversation of its own.  Faults: a message is blank (nothing but white space), else a
duplicate (role and text seen before in the conversation), else truncated (its last character other than white space is not one of
``.!?``).  Other columns are left out, whatever they are called.  An empty table gives none."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.llm.shared import materialize

#: Messages of a conversation that are searched at once, and of a block of a longer one.
LONG_ROWS = 4096
#: Long conversations whose ids are broadcast; with more, their rows are found by a join.
MOST_BROADCAST = 100_000
SPACE = " \t\n\x0b\x0c\r"
RENAME, DELETE, INSERT, CHARGE = 2, 3, 2, 1
#: By last role (none, system, user, assistant): the role that is due, the state after it, and the states that a kept initial leads to.
DUE, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEVER = 1 << 60
#: What a whole conversation may end on: no message at all, or an assistant's.
ENDS = (0, NEVER, NEVER, 0)
LEGAL = {"su", "ua", "au"}

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "conv_id long, position long, edit string, role string, text string"

#: An initial, whether the message has to go, whether it is truncated.
Mark = tuple[str, bool, bool]


def search(marks: list[Mark], entry: int = 0, ends: Iterable[int] = ENDS, insert_last: bool = True) -> tuple[int, str, int]:
    """Cost (with that of the end), edits and last state of the best path from ``entry`` past all marks; ``ends`` are the costs of
    ending in each state.  Without ``insert_last`` nothing is inserted behind the last message, where the next block begins."""
    ends, n = tuple(ends), len(marks)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if marks[i][1] else CHARGE if marks[i][2] else 0)
    least = min(ends)
    queue, closed = [(ahead[0] + least, "", 0, entry, 0)], set()
    while queue:
        _, audit, i, state, cost = heapq.heappop(queue)
        if i > n:
            return cost, audit, state
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and ends[state] < NEVER:
            heapq.heappush(queue, (cost + ends[state], audit, n + 1, state, cost + ends[state]))
        steps = [("I", INSERT, i, AFTER[state])] if i < n or insert_last else []
        if i < n:
            initial, must, cut = marks[i]
            steps.append(("D", DELETE, i + 1, state))
            if not must:
                steps.append(("R", RENAME + CHARGE * cut, i + 1, AFTER[state]))
                if initial in KEPT[state]:
                    steps.append(("K", CHARGE * cut, i + 1, KEPT[state][initial]))
        for edit, price, to, then in steps:
            if (to, then) not in closed:
                heapq.heappush(queue, (cost + price + ahead[to] + least, audit + edit, to, then, cost + price))
    return NEVER, "", entry


def crossing_costs(marks: list[Mark]) -> np.ndarray:
    """Least costs from each state before the marks (row) to each state behind them (column), nothing inserted behind the last."""
    best = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(best, 0)
    for initial, must, cut in marks:
        best[:, 2] = np.minimum(best[:, 2], best[:, [0, 1, 3]].min(1) + INSERT)
        best[:, 3] = np.minimum(best[:, 3], best[:, 2] + INSERT)
        then = best + DELETE
        if not must:
            for state in range(4):
                then[:, AFTER[state]] = np.minimum(then[:, AFTER[state]], best[:, state] + RENAME + CHARGE * cut)
                if initial in KEPT[state]:
                    to = KEPT[state][initial]
                    then[:, to] = np.minimum(then[:, to], best[:, state] + CHARGE * cut)
        best = np.minimum(then, NEVER)
    return best


def applied(rows: list[tuple], audit: str, entry: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every message that the edits leave; rows are (turn, role, text)."""
    state, i = entry, 0
    for edit in audit:
        role, text = rows[i][1:3] if edit != "I" else (DUE[state], "")
        i += edit != "I"
        if edit == "K":
            state = KEPT[state][role[:1]]
        elif edit != "D":
            role, state = DUE[state], AFTER[state]
        if edit != "D":
            yield edit, role, text


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_cut(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


def marked(rows: list[tuple], repeats: list[bool]) -> list[Mark]:
    return [(role[:1], dull or again, not dull and not again and is_cut(text)) for (_, role, text), again in zip(rows, repeats) for dull in (is_blank(text),)]


def _repeats(rows: list[tuple]) -> list[bool]:
    seen: set[tuple] = set()
    return [r[1:] in seen or bool(seen.add(r[1:])) for r in rows]


def _counts(rows: list[tuple], marks: list[Mark]) -> tuple[int, int, int, int]:
    blank, cut = sum(is_blank(r[2]) for r in rows), sum(m[2] for m in marks)
    return blank, sum(m[1] for m in marks) - blank, cut, sum(a[0] + b[0] not in LEGAL for a, b in zip(marks, marks[1:]))


def _summary(conv, rows: list[tuple]) -> list[tuple]:
    marks = marked(rows, _repeats(rows))
    cost, audit, _ = search(marks)
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    text = "\n".join(f"{role}:{text}" for _, role, text in applied(rows, audit))
    return [(conv, gaps, *_counts(rows, marks), cost, audit, hashlib.sha256(text.encode()).hexdigest())]


def _messages(conv, rows: list[tuple]) -> list[tuple]:
    audit = search(marked(rows, _repeats(rows)))[1]
    return [(conv, at, *message) for at, message in enumerate(applied(rows, audit))]


def _table(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = [x.split(" ") for x in ddl.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.record_batch([pa.array(list(c), types[t]) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in their first columns, from batches that come sorted by them."""
    own, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if own is not None and row[:keys] != own:
                yield own, rows
                rows = []
            own = row[:keys]
            rows.append(row[keys:])
    if own is not None:
        yield own, rows


def _fold(make: Callable, ddl: str, keys: int) -> Callable:
    """A function over sorted batches that makes rows of each run and sends them in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, rows in _grouped(batches, keys):
            made = list(make(key, rows))
            out += made
            size += sum(len(x) if isinstance(x, (str, bytes)) else 8 for r in made for x in r)
            if size > 4 << 20:
                yield _table(out, ddl)
                out, size = [], 0
        if out:
            yield _table(out, ddl)

    return run


def messages_of(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), *(["lost"] if "lost" in rows.columns else [F.lit(False).alias("lost")]))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with one message in twenty lost, emptied, stripped of ``.!?``, repeated or said by the user instead, by the CRC of
    ``conv_id:turn``.  Lost ones stay as rows with the flag ``lost``, so that a conversation without any other keeps its row."""
    rows = messages_of(rows)
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.withColumn("__k", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20)
    k = F.col("__k")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (k == 0).alias("lost"), F.when(k == 3, 2).otherwise(1).alias("__n"))
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "__i")


def _split(rows: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that are searched whole, and those of long ones if there are any."""
    many = materialize(rows.groupBy("conv_id").count().where(F.col("count") > long_rows).select(F.col("conv_id").alias("__long")), "long-conversations")
    n = many.count()
    if not n:
        return rows, None
    many = F.broadcast(many) if n <= MOST_BROADCAST else many
    same = F.col("conv_id").eqNullSafe(F.col("__long"))
    return rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", "role", "text", "lost").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _whole(make: Callable) -> Callable:
    return lambda key, rows: make(key[0], [r[:3] for r in rows if not r[3]])


_BLOCK = ["conv_id", "part", "block"]
_COSTS = "conv_id long, part long, block long, rows long, first string, last string, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, costs array<long>"


def _block_rows(rows: DataFrame, long_rows: int) -> DataFrame:
    """Long conversations in their order, dealt by ranges of it, with whether a message repeats an earlier one; cut in blocks."""
    spark = rows.sparkSession
    rows = rows.where("not lost").withColumn("__salt", F.rand(7))  # equal rows, of which there may be any number, part anywhere
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "role", "text", "__salt").sortWithinPartitions("conv_id", "turn", "role", "text", "__salt")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, own = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            places = []
            for conv in batch.column("conv_id").to_pylist():
                at, own = at + 1 if own == (conv,) else 0, (conv,)
                places.append(at)
            yield pa.record_batch([*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], names=["conv_id", "turn", "role", "text", "part", "at"])

    placed = materialize(dealt.drop("lost", "__salt").mapInArrow(place, "conv_id long, turn long, role string, text string, part long, at long"), "placed")
    place_ = F.struct("part", "at")
    first = placed.groupBy("conv_id", "role", F.sha2("text", 256).alias("__h")).agg(F.min(place_).alias("__first")).withColumnsRenamed({"conv_id": "__c", "role": "__r"})
    same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.sha2("text", 256) == F.col("__h"))
    return placed.join(first, same).select("conv_id", "part", F.floor(F.col("at") / long_rows).alias("block"), "at", "turn", "role", "text", (place_ > F.col("__first")).alias("again"))


def _in_blocks(rows: DataFrame, make: Callable, ddl: str) -> DataFrame:
    """A function of each block: (key, [(at, turn, role, text, again, ...)])."""
    return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "at").mapInArrow(_fold(make, ddl, 3), ddl)


def _of_conversations(blocks: DataFrame, make: Callable, ddl: str) -> DataFrame:
    """A function of the small rows of each conversation's blocks, in order."""
    return blocks.repartition("conv_id").sortWithinPartitions(*_BLOCK).mapInArrow(_fold(make, ddl, 1), ddl)


def _block_costs(key: tuple, rows: list[tuple]) -> list[tuple]:
    plain = [r[1:4] for r in rows]
    marks = marked(plain, [r[4] for r in rows])
    turns = sorted({t for t, _, _ in plain if t is not None})
    return [(*key, len(rows), marks[0][0], marks[-1][0], *_counts(plain, marks), turns[0] if turns else None, turns[-1] if turns else None, len(turns), crossing_costs(marks).ravel().tolist())]


def _ends(key: tuple, blocks: list[tuple]) -> list[tuple]:
    """For each block the cost from every state behind it to the conversation's end; a path may insert before the next block."""
    end, out = np.array(ENDS, np.int64), []
    # behind the last message up to two more may be inserted
    end[2] = min(end[2], end[3] + INSERT)
    end[[0, 1]] = np.minimum(end[[0, 1]], end[2] + INSERT)
    for b in reversed(blocks):
        out.append((key[0], b[0], b[1], end.tolist()))
        end = np.minimum((np.array(b[-1], np.int64).reshape(4, 4) + end).min(1), NEVER)
    return out


def repair_long(rows: DataFrame, long_rows: int = LONG_ROWS) -> tuple[DataFrame, DataFrame]:
    """Summaries and messages of long conversations, block by block."""
    blocks = materialize(_block_rows(rows, long_rows), "blocks")
    costs = materialize(_in_blocks(blocks, _block_costs, _COSTS), "block-costs")
    ends = materialize(_of_conversations(costs, _ends, "conv_id long, part long, block long, ends array<long>"), "block-ends")

    def with_small(table: DataFrame, small: DataFrame, *columns: str) -> DataFrame:
        small = small.select(*(F.col(c).alias(f"__{c}") for c in _BLOCK), *columns)
        on = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block"))
        return table.join(small, on).drop(*(f"__{c}" for c in _BLOCK))

    def ways(key: tuple, rows: list[tuple]) -> list[tuple]:
        marks = marked([r[1:4] for r in rows], [r[4] for r in rows])
        return [(*key, [search(marks, entry, rows[0][5], False)[2] for entry in range(4)])]

    out_of = materialize(_in_blocks(with_small(blocks, ends, "ends"), ways, "conv_id long, part long, block long, exits array<long>"), "block-exits")

    def entries(key: tuple, blocks: list[tuple]) -> list[tuple]:
        state, out = 0, []
        for part, block, exits in blocks:
            out.append((key[0], part, block, state))
            state = exits[state]
        return [(*x, i + 1 == len(out)) for i, x in enumerate(out)]

    entered = _of_conversations(out_of, entries, "conv_id long, part long, block long, entry long, final boolean")
    entered = with_small(ends, entered, "entry", "final")

    def edits(key: tuple, rows: list[tuple]) -> list[tuple]:
        plain, (ends, entry, final) = [r[1:4] for r in rows], rows[0][5:8]
        marks = marked(plain, [r[4] for r in rows])
        _, audit, _ = search(marks, entry, ENDS if final else ends, final)
        return [(*key, at, audit if not at else "", *x) for at, x in enumerate([*applied(plain, audit, entry), (None, None, None)])]

    edited = materialize(_in_blocks(with_small(blocks, entered, "ends", "entry", "final"), edits, "conv_id long, part long, block long, at long, audit string, edit string, role string, text string"), "block-edits")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, audit, begun = None, None, [], False
        done = lambda: _table([(own[0], "".join(audit), sha.hexdigest())], "conv_id long, audit string, repaired_sha256 string")
        for batch in batches:
            for conv, path, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "edit", "role", "text"))):
                if own != (conv,):
                    if own is not None:
                        yield done()
                    own, sha, audit, begun = (conv,), hashlib.sha256(), [], False
                audit.append(path)
                if edit is not None:
                    sha.update(("\n" * begun + f"{role}:{text}").encode())
                    begun = True
        if own is not None:
            yield done()

    digests = edited.repartition("conv_id").sortWithinPartitions(*_BLOCK, "at").mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string")

    def totals(key: tuple, blocks: list[tuple]) -> list[tuple]:
        illegal, turns, low, high, last, before = 0, 0, None, None, None, None
        for b in blocks:
            illegal += b[8] + (last is not None and last + b[3] not in LEGAL)
            last = b[4]
            if b[9] is not None:
                turns += b[11] - (before == b[9])
                low, high, before = b[9] if low is None else low, b[10], b[10]
        cost = int((np.array(blocks[0][-1], np.int64).reshape(4, 4)[0] + np.array(_ends(key, blocks)[-1][3])).min())
        gaps = high - low + 1 - turns if turns else 0
        return [(key[0], gaps, *(sum(b[i] for b in blocks) for i in (5, 6, 7)), illegal, cost)]

    sums = _of_conversations(costs, totals, SUMMARY.split(", audit")[0])
    d = digests.withColumnRenamed("conv_id", "__d")
    summaries = sums.join(d, F.col("conv_id").eqNullSafe(F.col("__d"))).drop("__d")
    kept = edited.where("edit is not null")
    return summaries, kept.select("conv_id", (F.col("part") * (1 << 46) + F.col("block") * (1 << 20) + F.col("at")).alias("position"), "edit", "role", "text")


def repair(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row per conversation: gaps in its turns, faults, adjacent roles that do not follow each other, cost and edits of the repair,
    and the SHA-256 of the repaired ``role:text`` lines.  A column ``lost`` marks rows that only name their conversation."""
    short, long = _split(messages_of(rows), long_rows)
    out = _sorted(short).mapInArrow(_fold(_whole(_summary), SUMMARY, 1), SUMMARY)
    return out if long is None else out.unionByName(repair_long(long, long_rows)[0])


def repaired_messages(rows: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """The messages of the repaired conversations, in the order of ``position``, with the edit that each comes from."""
    short, long = _split(messages_of(rows), long_rows)
    out = _sorted(short).mapInArrow(_fold(_whole(_messages), MESSAGES, 1), MESSAGES)
    return out if long is None else out.unionByName(repair_long(long, long_rows)[1])


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: a byte enters, eight shifts follow."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"


def repair_sql() -> str:
    """The query as a recursion over messages that keeps, for each last role, the cheapest and then least edits."""
    s = r"[\x20\x09-\x0D]"
    crc = crc32_sql("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")
    step = lambda q, edit, price, out="''": f"{{'c': v[{q + 1}].c + {price}, 'a': v[{q + 1}].a || '{edit}', 'o': v[{q + 1}].o || {out}}}"
    said, due = "chr(10) || role || ':' || text", lambda q: f"chr(10) || '{DUE[q]}:' || text"
    never = "{'c': 1000000000, 'a': '', 'o': ''}"

    def to(state: int) -> str:
        ways = [step(state, "D", 3)]
        for q in range(4):
            ways += [f"CASE WHEN NOT must AND r = '{r}' THEN {step(q, 'K', 'cut', said)} ELSE {never} END" for r, t in KEPT[q].items() if t == state]
            ways += [f"CASE WHEN NOT must THEN {step(q, 'R', '2 + cut', due(q))} ELSE {never} END"] * (AFTER[q] == state)
        return f"list_min([{', '.join(ways)}])"

    new = lambda q: f"'{chr(10)}{DUE[q]}:'"
    two = f"list_min([v[3], {', '.join(step(q, 'I', 2, new(q)) for q in (0, 1, 3))}])"
    closed = lambda rows: f"SELECT conv_id, i, [v[1], v[2], w, list_min([v[4], {{'c': w.c + 2, 'a': w.a || 'I', 'o': w.o || {new(2)}}}])] AS v FROM (SELECT conv_id, i, v, {two} AS w FROM ({rows}))"
    return f"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
    hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM src WHERE k <> 0
      UNION ALL SELECT conv_id, turn, role, text FROM src WHERE k = 3),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS r FROM hurt),
    judged AS (SELECT *, NOT regexp_matches(text, '[^{s[1:]}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
      regexp_extract(text, '([^{s[1:]}){s}*$', 1) NOT IN ('.', '!', '?') AS open, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS odd FROM placed),
    ms AS (SELECT *, blank OR again AS must, (NOT blank AND NOT again AND open)::INTEGER AS cut FROM judged),
    dp AS ({closed("SELECT DISTINCT conv_id, 0::BIGINT AS i, [{'c': 0, 'a': '', 'o': ''}, " + ", ".join([never] * 3) + "] AS v FROM conversations")}
      UNION ALL {closed("SELECT dp.conv_id, ms.i, [" + ", ".join(to(q) for q in range(4)) + "] AS v FROM dp JOIN ms ON ms.conv_id IS NOT DISTINCT FROM dp.conv_id AND ms.i = dp.i + 1")}),
    fin AS (SELECT conv_id, list_min([v[1], v[4]]) AS b FROM (SELECT conv_id, arg_max(v, i) AS v FROM dp GROUP BY conv_id)),
    st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (odd) AS illegal FROM ms GROUP BY conv_id)
    SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
      b.c::BIGINT AS cost, b.a AS audit, sha256(substr(b.o, 2)) AS repaired_sha256 FROM fin LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM fin.conv_id"""
