"""Phrase counts and ranks against plain counting, with small memory, a common pair, nulls, ties and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from oneway.llm import collocations as C
from tests.llm.cases import cluttered, docs, empty


def texts() -> list[tuple]:
    rng = random.Random(3)
    common = [f"w{i}" for i in range(12)] + ["É", "ß", "A\xa0b", "x" * 90, "-", "\x00", "naïve…"]
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t .,;", None, None, 0), (None, "Alone", None, "a", 0), (4, "one TWO one two", "und", "a", 0)]
    for i in range(150):
        words = [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(400)}" for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            words += ["hot", "pair"] * 20
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\x0b"]) for w in words).replace("w1", "W1"), rng.choice(["en", "de", None, "und"]), "s", 0))
    return rows + [(500, "said twice. Said twice", "en", "s", 0)] * 40


def expected(rows: list[tuple], floor: int, top: int) -> list[tuple]:
    counts, total = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {k: n for k, n in counts.items() if n >= floor and len(k[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        if any(len(q) > len(p) and g == lang and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * n >= 80 * a for (g, q), n in found.items()):
            continue
        score, _, left, right = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), left, right, total[lang]))
    out.sort()
    ranks = Counter()
    rows = []
    for lang, score, a, phrase, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


@pytest.mark.parametrize("leaves,keys,bits", [(1_000_000, 2_000_000, C.FILTER_BITS), (40, 40, 1 << 18)])
def test_counts_and_ranks(spark, monkeypatch, leaves, keys, bits):
    monkeypatch.setattr(C, "MOST_LEAVES", leaves)
    monkeypatch.setattr(C, "MOST_KEYS", keys)
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    rows = texts()
    table = cluttered(docs(spark, rows).repartition(3), "phrase", "words", "n", "range", "k")
    got = [tuple(r) for r in C.collocations(table, top=25, floor=6).orderBy("lang", "rank").collect()]
    assert got == expected(rows, 6, 25)


def test_nothing(spark):
    assert C.collocations(empty(spark)).count() == 0
    assert C.collocations(docs(spark, [(1, None, None, None, 0), (2, "a b", "en", "", 0)])).count() == 0


def test_tries_merge_in_any_order_and_survive_packing():
    import pyarrow as pa

    from oneway.llm.textkit import text_buffer

    def trie(lines: list[str]) -> C.Trie:
        column = pa.array(lines)
        words, langs, h, single, pairs = next(C._read(iter([pa.record_batch([pa.array(["en"] * len(lines)), column], names=["lang", "text"])])))
        assert text_buffer(column)[1][-1] == len(words.buf)
        import numpy as np

        return C.Trie.merged([C._walked(words, langs, h, np.ones(len(words), bool), words.joined)])

    one, two = trie(["a b c d e", "a b"]), trie(["b c. a b c d", "z"])
    both = trie(["a b c d e", "a b", "b c. a b c d", "z"])
    for parts in ([one, two], [two, C.Trie.unpacked(one.packed())]):
        assert C.Trie.merged(parts).nodes(1).to_pylist() == both.nodes(1).to_pylist()
