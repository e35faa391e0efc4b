"""Canonical JSON is what a JSON reader reads back, and tells rows apart; chains go on from what is stored."""

from __future__ import annotations

import hashlib
import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oneway.functions import canonical as C
from oneway.operators import ledger as LE
from oneway.operators.ranges import positions

ROW = st.tuples(st.none() | st.text(max_size=12), st.none() | st.text("|=\",:{}\\\n\x00\x7fé😀", max_size=6), st.none() | st.floats(), st.none() | st.integers(-(1 << 63), (1 << 63) - 1), st.none() | st.booleans())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=40, max_size=60))
def test_rows_that_differ_have_texts_that_differ(spark, rows):
    rows = [r for r in rows if not any(isinstance(x, str) and any(0xD800 <= ord(c) < 0xE000 for c in x) for x in r)] + [("x|b=y", "z", None, None, None), ("x", "b=y|z", None, None, None), (None, "", 0.0, 0, None), ("", None, 0.0, 0, None)]
    frame = spark.createDataFrame(rows, "a string, b string, d double, i long, f boolean")
    got = [r.j for r in frame.select(C.canonical(a=F.col("a"), inner={"b": F.col("b"), "d": C.number(F.col("d"))}, i=F.col("i"), f=F.col("f")).alias("j")).collect()]
    same = lambda x, y: x == y and math.copysign(1, x) == math.copysign(1, y) if isinstance(x, float) and not math.isnan(x) and not math.isinf(x) else x == y
    for (a, b, d, i, f), text in zip(rows, got):
        read = json.loads(text)
        assert (read["a"], read["inner"]["b"], read["i"], read["f"]) == (a, b, i, f) and text.isascii() and text.isprintable()
        assert read["inner"]["d"] == {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[repr(d)] if d is not None and not math.isfinite(d) else same(read["inner"]["d"], d)
        assert (json.dumps(a) in text) and (json.dumps(b) in text)
    key = lambda r: (r[0], r[1], None if r[2] is None else repr(r[2]), r[3], r[4])
    assert len(set(got)) == len({key(r) for r in rows})


def test_lists_and_maps(spark):
    frame = spark.createDataFrame([(["b", None, "a\""], {"z": 0.5, "a": None})], "l array<string>, m map<string, double>")
    assert frame.select(C.canonical(l=C.texts(F.col("l")), m=C.doubles_by_name(F.col("m"))).alias("j")).first().j == '{"l":["b",null,"a\\""],"m":{"a":null,"z":5e-1}}'


def bundles(lo: int, hi: int) -> list[tuple]:
    return [(s, i, float(i), hashlib.sha256(f"{s}{i}".encode()).hexdigest()) for s, step in (("hot", 1), ('q"é\x7f', 3), (None, 7)) for i in range(lo, hi) if i % step == 0]


def test_appended_batches_are_the_chain_of_one(spark, tmp_path):
    frame = lambda lo, hi: spark.createDataFrame(bundles(lo, hi), LE.Ledger.BUNDLE)
    want = sorted(map(str, LE.seal(LE.batches(frame(0, 100)), b"k").collect()))
    book = LE.Ledger(spark, str(tmp_path / "book"), b"k")
    with pytest.raises(ValueError, match="no batch"):
        book.chain()
    for number, (lo, hi) in enumerate([(0, 5), (5, 40), (40, 41), (41, 100)]):
        assert book.append(frame(lo, hi), number)
        before = sorted(map(str, book.chain().collect()))
        assert not book.append(frame(lo, hi), number)  # a batch that comes again
        assert sorted(map(str, book.chain().collect())) == before
    assert {r.sensor_id: r.n for r in book.pending().groupBy("sensor_id").agg(F.count("*").alias("n")).collect()} == {"hot": 4, 'q"é\x7f': 2, None: 7}
    assert book.append(frame(0, 0), 9, close=True) and book.pending().count() == 0
    assert sorted(map(str, book.chain().select(LE.seal(LE.batches(frame(0, 1)), b"k").columns).collect())) == want
    assert all(r.intact for r in LE.verify_chain(book.chain(), b"k").collect())
    with pytest.raises(ValueError, match="comes after"):
        book.append(frame(0, 1), 8)


def test_a_batch_that_failed_half_way_leaves_nothing(spark, tmp_path, monkeypatch):
    book = LE.Ledger(spark, str(tmp_path / "book"), b"k")
    frame = lambda lo, hi: spark.createDataFrame(bundles(lo, hi), LE.Ledger.BUNDLE)
    book.append(frame(0, 20), 0)
    before = sorted(map(str, book.chain().collect()))
    with monkeypatch.context() as m:
        m.setattr(LE.Ledger, "_fs", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            book.append(frame(20, 60), 1)
    (tmp_path / "book" / "blocks" / "1").mkdir(exist_ok=True)
    assert sorted(map(str, book.chain().collect())) == before
    assert book.append(frame(20, 60), 1) and all(r.intact for r in LE.verify_chain(book.chain(), b"k").collect())


def test_a_stream_of_bundles_is_sealed_once(spark, tmp_path):
    land = tmp_path / "in"
    book = LE.Ledger(spark, str(tmp_path / "book"), b"k")
    for lo, hi in ((0, 13), (13, 30)):
        spark.createDataFrame(bundles(lo, hi), LE.Ledger.BUNDLE).write.mode("append").parquet(str(land))
        book.append_stream(spark.readStream.schema(LE.Ledger.BUNDLE).parquet(str(land)), str(tmp_path / "check")).awaitTermination()
    assert book.chain().where("sensor_id = 'hot' and index > 0").count() == 3 and book.pending().where("sensor_id = 'hot'").count() == 6


def test_more_leaves_than_a_tree_has_rounds_for(spark):
    frame = spark.createDataFrame([(["ab" * 32] * 80,)], "leaves array<string>")
    with pytest.raises(Exception, match="more than 64 leaves: 80"):
        LE.merkle_root(frame, "leaves").collect()


def test_positions_of_a_key_that_has_most_rows(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("seq"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("sensor_id")).repartition(5)
    got = positions(rows, ["sensor_id"], ["seq"], "n")
    wrong = got.join(got.groupBy("sensor_id").agg(F.array_sort(F.collect_list("seq")).alias("all")), "sensor_id").where("element_at(all, cast(n + 1 as int)) <> seq")
    assert wrong.count() == 0 and got.count() == 20_000


def test_order_statistics_of_a_class_that_has_most_rows(spark):
    """Thresholds, p-values and quantiles of a class with two thirds of all rows, by definition."""
    from oneway.operators import conformal as CO
    from oneway.operators import metrics as ME

    rows = [(i, "hot" if i % 3 else f"c{i % 4}", (i * 7919 % 5000) / 5000, 0.0) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id long, class string, score double, uncertainty double").repartition(6)
    by: dict = {}
    for i, c, s, _ in rows:
        by.setdefault(c, []).append(1 - s)
    fitted = {r["class"]: (r.n, r.q) for r in CO.fit(frame).collect()}
    stats = {r["class"]: (r.median, r.p90) for r in ME.summary_stats(frame, "score", "class").collect()}
    p = {r.id: r.p for r in CO.p_values(frame.where("id < 300"), frame).collect()}
    for c, xs in by.items():
        xs.sort()
        assert fitted[c] == (len(xs), xs[min(len(xs), math.ceil((len(xs) + 1) * 0.9)) - 1])
        up = sorted(1 - x for x in xs)
        assert all(math.isclose(a, up[min(len(up) - 1, int(q * len(up)))]) for a, q in zip(stats[c], (0.5, 0.9)))
    for i, c, s, _ in rows[:300]:
        assert math.isclose(p[i], (sum(x >= 1 - s for x in by[c]) + 1) / (len(by[c]) + 1))


def test_bundles_are_numbered_and_hashed_once(spark):
    """Headers and digests of a chain come from blocks that are written, not from two computations of them."""
    rows = spark.createDataFrame([("s", i, float(i), f"{i:064x}") for i in range(20)], "sensor_id string, seq long, ts double, digest string")
    chain = LE.seal(LE.batches(rows), b"k")
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "collect_list" not in plan
    assert chain.count() == 4 and LE.verify_chain(chain, b"k").where("intact").count() == 1


def test_doubles_are_cut_without_patterns(spark):
    values = [0.0, -0.0, 1.5, -2.0, 1e7, 1704067211.172425, 1e-300, 5e-324, -1.7976931348623157e308, 0.001, float("nan"), float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(C.double(F.col("x")).alias("t"))
    want = ["0e0", "-0e0", "15e-1", "-2e0", "1e7", "1704067211172425e-6", "1e-300", "49e-325", "-17976931348623157e292", "1e-3", '"NaN"', '"Infinity"', '"-Infinity"', None]
    assert [r.t for r in rows.collect()] == want
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
