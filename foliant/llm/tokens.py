"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

A byte-level vocabulary splits text by a fixed pattern before any merge.  No token of
that pattern goes past a space or line end that is followed by other than white space,
nor from letters to marks.  So a text is cut there, and each distinct piece is encoded
once per worker.  For tokenizers of any other kind whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Pieces remembered per worker, the longest piece that is remembered, and bits of the marks that a piece leaves at first.
MOST_PIECES, LONGEST_PIECE, MARKS = 300_000, 40, 1 << 22

_LOOSE = re.compile(r"[ \n](?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_MARKS = ".,;:!?*#$%&|"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + rest.index(b)) for b in range(256)]


_LETTER = _byte_letters()


def _ids(tokenizer, text: str) -> bytes:
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class _Pieces(dict):
    """Piece to ids; a piece has a space before it unless it begins with a line end.

    Most distinct pieces occur once only, so a piece is remembered when it comes the second time.
    """

    def __init__(self, tokenizer, most: int):
        super().__init__()
        self.tokenizer, self.most, self.marks = tokenizer, most, {}
        self.model, self.met = tokenizer.model, bytearray(MARKS)

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if len(word) < len(piece) and word.isalpha():
            ids = self[word] + self.mark(piece[len(word) :])
        elif word.isalpha():
            ids = self.word(" " + word)
        elif piece[0] == "\n" and piece[1:].isalpha():
            ids = self.mark("\n") + self.word(piece[1:])
        else:
            ids = _ids(self.tokenizer, piece if piece.startswith("\n") else " " + piece)
        if len(piece) <= LONGEST_PIECE and len(self) < self.most:
            mark = hash(piece) % MARKS
            if self.met[mark]:
                self[piece] = ids
            else:
                self.met[mark] = 1
        return ids

    def word(self, text: str) -> bytes:
        """Ids of letters with or without a space before them: the pattern keeps them whole, so the model alone is asked."""
        letters = text.replace(" ", _LETTER[32]) if text.isascii() else "".join([_LETTER[b] for b in text.encode()])
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def mark(self, text: str) -> bytes:
        """Ids of a run of marks that follows letters."""
        ids = self.marks.get(text)
        if ids is None:
            ids = _ids(self.tokenizer, text)
            if len(text) <= LONGEST_PIECE and len(self.marks) < self.most:
                self.marks[text] = ids
        return ids


class Encoder:
    def __init__(self, path: str, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_piece = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(set(x) & set(" \n" + _MARKS) - {"|"} for x in added)
        )
        self.pieces = _Pieces(self.tokenizer, most)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Unsigned 32-bit ids of each text in the machine's order; null counts as empty."""
        if not self.by_piece:
            return [_ids(self.tokenizer, t or "") for t in texts]
        of, out = self.pieces.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            cut = _CUT.split(text) if _LOOSE.search(text) else text.replace("\n", " \n").split(" ")
            head = _ids(self.tokenizer, cut[0]) if cut[0] else b""
            out.append(head + b"".join(map(of, cut[1:])))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
