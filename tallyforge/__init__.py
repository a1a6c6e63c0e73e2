"""A PySpark-native automated analytics engine.

Public entry points are imported lazily so that ``import tallyforge`` needs no running session.
"""

from __future__ import annotations

__version__ = "0.1.0"

_API = {
    "analyze": "tallyforge.plans.analysis",
    "AnalysisResult": "tallyforge.plans.analysis",
    "profile": "tallyforge.plans.analysis",
    "quality_check": "tallyforge.plans.analysis",
    "clean_file": "tallyforge.plans.analysis",
    "open": "tallyforge.operators.dataset",
    "open_asset": "tallyforge.operators.dataset",
    "DataAsset": "tallyforge.operators.dataset",
    "large": "tallyforge.operators.lazy",
    "LargeDataAsset": "tallyforge.operators.lazy",
}


def __getattr__(name: str):
    if name in _API:
        import importlib

        return getattr(importlib.import_module(_API[name]), name)
    raise AttributeError(name)
