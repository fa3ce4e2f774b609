from . import changes
from .relation import Relation

__all__ = ["Relation", "changes"]
