"""Every registered query, by importing the modules that register them."""

import importlib

from skyloom.plans.registry import REGISTRY, Tables

MODULES = ["q_windows", "q_tracks", "q_stats", "q_series", "q_geometry", "q_sources", "q_links", "q_readings", "q_models", "q_more", "q_streams"]

for _m in MODULES:
    importlib.import_module(f"skyloom.plans.{_m}")

__all__ = ["REGISTRY", "Tables"]
