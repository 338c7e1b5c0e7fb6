"""Tables in the shared folder, as the rest of the library writes them."""

from ..operators.cut import discard, place, shared, temporary, written

__all__ = ["discard", "place", "shared", "temporary", "written"]
