"""What the two tokenizer operators share: the vocabulary file and the cutting of texts into words.

A piece of the vocabulary holds the word mark only in front, so nothing that is merged or matched
crosses from a character to a following space: a text may be handled word by word, a word being a
run of spaces with what follows up to the next space. ``Vocabulary`` verifies this when it loads."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import sentencepiece

MARK = "▁"
WORD = re.compile(" +[^ ]*|[^ ]+")


class Vocabulary:
    """Pieces with scores, as plain tables."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.scores = np.array([sp.get_score(i) for i in range(self.size)], np.float32)
        self.unk, self.bos, self.eos = sp.unk_id(), sp.bos_id(), sp.eos_id()
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(self.size) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.control = [i for i in range(self.size) if sp.is_control(i)]
        if any(re.search(f"[^{MARK}]{MARK}|{MARK} | ", self.pieces[i]) for i in self.plain):
            raise ValueError("a piece of this vocabulary crosses words")
        if any(sp.is_unused(i) for i in range(self.size)) or len(self.byte_of) != 256:
            raise ValueError("a vocabulary with unused pieces or without all bytes isn't supported")
        probe = sp.encode("  ﬁ A　", out_type=str)
        if "".join(probe).replace(MARK, " ") != "   ﬁ A　":
            raise ValueError("a vocabulary that changes texts first isn't supported")
        self.bytes_out = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode()
                          for i in range(self.size)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(text: str) -> list[str]:
    """The words of a text behind its leading dummy space; none for the empty text. The word mark
    itself, when a text holds it, reads as a space, as in the tokenizer."""
    return WORD.findall(" " + text.replace(MARK, " ")) if text else []
