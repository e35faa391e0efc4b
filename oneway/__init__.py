"""One-way network traffic analytics on Spark: flows, half-flow estimates, detectors, alerts, evidence, incidents."""
