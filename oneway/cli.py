"""``python -m oneway.cli analyze CAPTURES``, ``profile CAPTURES ...``, ``replay CAPTURES``, ``demo`` and the regression gate, ``gate``."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oneway.functions import fixtures as X
from oneway.operators.alerts import ranked
from oneway.operators.ledger import verify_chain
from oneway.operators.metrics import gate
from oneway.operators.profile import compare, rate_buckets, with_quality
from oneway.plans.analysis import analyze, evaluate, name_auc, tampered
from oneway.sources.pcap import capture_quality, read_pcap
from oneway.streaming.replay import Replay


def _print(df: DataFrame, limit: int) -> None:
    for row in df.limit(limit).toJSON().collect():
        print(row)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="oneway")
    todo = parser.add_subparsers(dest="command", required=True)
    a = todo.add_parser("analyze", help="alerts of captures, by falling confidence")
    a.add_argument("path")
    a.add_argument("--window", type=float, help="seconds; 60, or 600 with --stream")
    a.add_argument("--backend", choices=("auto", "classic", "permissive"), default="auto")
    a.add_argument("--stream", action="store_true", help="judge window by window, where a window opens at the packet that overflowed the last")
    a.add_argument("--save", help="folder for all results")
    a.add_argument("--json", help="folder for the alerts as JSON")
    a.add_argument("--limit", type=int, default=50)
    p = todo.add_parser("profile", help="one traffic profile per capture")
    p.add_argument("paths", nargs="+")
    p.add_argument("--bucket", type=float, default=1.0)
    r = todo.add_parser("replay", help="replay captures at a multiple of their own pace")
    r.add_argument("path")
    r.add_argument("--speed", type=float, default=1.0)
    d = todo.add_parser("demo", help="alerts, incidents and a tampered ledger of built-in traffic")
    d.add_argument("--limit", type=int, default=20)
    g = todo.add_parser("gate", help="evaluate the labelled scenarios against the floors")
    g.add_argument("--trials", type=int, default=5)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("oneway").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "analyze":
        window = args.window if args.window is not None else 600.0 if args.stream else 60.0
        found = analyze(read_pcap(spark, args.path, args.backend), window, windows=args.stream)
        if args.save:
            found.save(args.save)
        if args.json:
            found.alerts.write.mode("overwrite").json(args.json)
        _print(ranked(found.alerts), args.limit)
    elif args.command == "replay":
        total, seen = read_pcap(spark, args.path).count(), []
        with tempfile.TemporaryDirectory() as folder:  # the checkpoint of this run alone, on the driver's own machine
            replay = Replay(spark, args.path, folder, lambda rows, _: seen.append(rows.count()), args.speed)
            replay.start()
            while sum(seen) < total and replay.query.isActive:
                time.sleep(0.2)
            replay.stop()
        print(json.dumps({"packets": sum(seen), "batches": len(seen), "state": replay.state}))
    elif args.command == "demo":
        packets = X.frame(spark, X.background(4) + X.syn_flood(1) + X.tunnel(2) + X.generated_names(3) + X.beacon(5))
        found = analyze(packets)
        chain = found.chain.persist()
        _print(ranked(found.alerts), args.limit)
        _print(found.incidents.select("incident_id", "host", "threat_score", "severity", "reasons", "recommendation"), args.limit)
        for name, blocks in (("sealed", chain), ("tampered", tampered(chain))):
            print(json.dumps({"ledger": name} | verify_chain(blocks, b"sensor-signing-key").first().asDict()))
        chain.unpersist()
    elif args.command == "profile":
        captures = {p: read_pcap(spark, p, "permissive") for p in args.paths}
        counts = None
        for p in args.paths:
            own = capture_quality(spark, p).agg(F.lit(p).alias("scenario"), F.sum("malformed").alias("malformed"), F.sum("unsupported").alias("unsupported"))
            counts = own if counts is None else counts.unionByName(own)
        _print(with_quality(compare(captures), counts), len(captures))
        for packets in captures.values():
            _print(rate_buckets(packets, args.bucket).orderBy(F.desc("packets"), "bucket"), 5)
    else:
        got = evaluate(spark, args.trials)
        f1, alarms = got["macro"].first()["f1"], got["alarms"].first()["false_alarm_rate"]
        auc = name_auc(spark).first()["auc"]
        short = gate(f1, alarms, auc)
        print(json.dumps({"macro_f1": f1, "false_alarm_rate": alarms, "auc": auc, "short": short}))
        return int(bool(short))
    return 0


if __name__ == "__main__":
    sys.exit(main())
