"""Spark analytics over dated snapshots of published indicator lists."""
