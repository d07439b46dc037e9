"""Connected components, as the operators of this part import them."""

from tessera.operators.components import components

__all__ = ["components"]
