"""Collects the oracle SQL of every area."""

from oracle import detect, evaluate, explain, ingest, metrics, report

SQL = {**metrics.SQL, **detect.SQL, **explain.SQL, **report.SQL, **ingest.SQL, **evaluate.SQL}

from adsight.plans.all_queries import SHARED  # noqa: E402

SQL.update({name: SQL[other] for name, other in SHARED.items() if other in SQL})
