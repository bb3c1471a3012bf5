from tongueloom.functions.arrays import argmax_index, label_index
from tongueloom.functions.hashing import digest, hash32, hash_word, uniform
from tongueloom.functions.text import lines, strip, word_count, words

__all__ = [
    "argmax_index", "label_index", "digest", "hash32", "hash_word", "uniform", "lines", "strip", "word_count", "words",
]
