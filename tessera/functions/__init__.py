from . import aggregates, scalars, spans

__all__ = ["aggregates", "scalars", "spans"]
