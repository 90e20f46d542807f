"""Operations for training-data corpora: chat formatting, deduplication, sketches, packing, mixing, filtering and scoring.

Nothing else in the library imports this package; ``queries`` holds what the entry point registers.
"""
