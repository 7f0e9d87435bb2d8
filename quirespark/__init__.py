"""A document-to-Markdown engine and training-data operators on PySpark DataFrames."""

from importlib import import_module

__version__ = "0.2.0"
_PLACES = {"convert": "plans.convert", "convert_path": "plans.convert", "conversion": "plans.convert", "translate": "plans.translate", "Providers": "providers", "Converter": "registry", "register": "registry"}
__all__ = [*_PLACES]


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
