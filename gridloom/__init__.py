"""A Spark-native analytics engine for dense N-dimensional tensors, and operators for training data.

The public names are loaded on first use, so that tasks which import one module don't load them all.
"""

import importlib

#: Public names by the module that has them.
_HOMES = {
    "engine": ("Catalog", "execute_query_document", "execute_query_json", "execute_query_toml", "host_available_ram", "materialize_query", "plan_read_for_document", "query", "to_numpy"),
    "model": ("DTYPES", "TensorFrame", "TensorMeta", "ValidationError"),
    "plans.document": ("QueryDocument", "parse_query_json", "parse_query_text", "parse_query_toml", "parse_query_value"),
    "plans.geometry": ("ReadPlan", "read_plan", "resolve_selection"),
    "sources.container": ("ContainerError", "open_catalog", "open_tensor", "read_summary", "write_container"),
    "sources.convert": ("convert", "import_tensors", "sniff"),
    "tools.verify": ("repair", "verify"),
}
_HOME = {name: module for module, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_HOME[name]}"), name)
