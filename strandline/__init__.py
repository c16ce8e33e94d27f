"""Spark-native search for short sequences in large collections of long ones."""

from importlib import import_module

__version__ = "0.1.0"
__all__ = ["IndexBuilder", "ProteinIndex", "Search", "__version__"]
_PLACES = {"Search": ".plans.engine", "IndexBuilder": ".sources.index", "ProteinIndex": ".sources.index"}


def __getattr__(name: str):
    # on first use: Python workers that unpickle one function need not import the engine
    if name in _PLACES:
        return getattr(import_module(_PLACES[name], __name__), name)
    raise AttributeError(name)
