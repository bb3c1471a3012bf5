"""Job parameters and the fixed values they default to."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values -----------------------------------------------------------
NER_TAGS = ["O", "B-DATE", "I-DATE", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
LABEL_SETS = {
    "yoruba": ["nigeria", "africa", "world", "entertainment", "health", "sport", "politics"],
    "hausa": ["africa", "world", "health", "nigeria", "politics"],
    "sentiment": ["positive", "neutral", "negative"],
}
RESERVED_PIECES = ["<s>", "<pad>", "</s>", "<unk>"]
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
IGNORE_LABEL_ID = -100
MASK_PIECE = "<mask>"
MISSING_WORDS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]  # what a table reader takes for no value
WORD_MARK = "\u2581"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class CorpusJob:
    """Parameters of one corpus-growing job; the defaults are the published settings."""

    seed: int = 1234
    holdout: float = 0.2
    min_words: int = 5
    window_lo: int = 5
    window_hi: int = 256
    mask_rate: float = 0.15
    rounds: int = 3
    batch_size: int = 64
    workers: int = 6
    alpha: float = 1.0
    vocab_size: int = 250000
    coverage: float = 0.9995
    max_len: int = 256
