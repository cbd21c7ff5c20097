"""Every operator of the inventory wired to the given tables."""

import importlib
import pkgutil

from .registry import ORACLES, QUERIES


def load_all():
    for m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if m != "registry":
            importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
