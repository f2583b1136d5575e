"""ledgerleaf: a document-extraction and analytics engine expressed as Spark plans."""

__version__ = "0.2.0"
__all__ = ["TRUST_BOUNDARY", "extract", "process", "renames"]


def __getattr__(name: str):
    """The functions of ``ledgerleaf.api``, loaded when they are first asked for."""
    if name in __all__:
        from ledgerleaf import api

        return getattr(api, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
