"""Track and corpus analytics on Spark.

Detections, tracks, brightness curves, per-frame statistics, lines of sight and winds over many videos at once, as
DataFrame functions (``operators``), readers and writers (``sources``), column helpers (``functions``), ready-made
queries (``plans``) and Structured Streaming jobs (``streaming``).
"""
