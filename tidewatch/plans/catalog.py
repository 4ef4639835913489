"""Imports every plan module, which fills the registry."""
import importlib
import pkgutil

import tidewatch.plans as _plans
from tidewatch.plans.registry import QUERIES, SQL  # noqa: F401

for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__)):
    if _m not in ("registry", "views", "catalog"):
        importlib.import_module(f"tidewatch.plans.{_m}")
