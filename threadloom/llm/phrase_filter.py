"""The bitmaps of ``functions.bitmaps`` as the text operators use them: sets of 64-bit hashes of fixed size."""

from threadloom.functions.bitmaps import BITS, _places, built, empty, holds

__all__ = ["BITS", "_places", "built", "empty", "holds"]
