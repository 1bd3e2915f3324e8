"""The unigram piece table of a SentencePiece model file, for encoding and for counting.

Every scoring rule is the library's for unigram models: the path of greatest summed score wins, a later start
must be strictly better to replace an earlier one, and a character that is no piece by itself costs the least
score less ten and comes out as its bytes. Pieces of several word marks and nothing else carry a score that
never wins; they are left out, so that they don't set the least score.
"""

from __future__ import annotations

from dataclasses import dataclass

MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class PieceTable:
    #: (piece, id, score) of ordinary pieces
    pieces: list[tuple[str, int, float]]
    #: id of byte 0; the other bytes follow
    first_byte: int
    unknown_score: float
    longest: int


def load_pieces(path: str) -> PieceTable:
    """Reads the table once, on the driver or in a worker; a vocabulary's size is fixed."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    found, first_byte = [], None
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            value = int(piece[3:-1], 16)
            first_byte = i if value == 0 else first_byte
            if first_byte is None or i != first_byte + value:
                raise ValueError("byte pieces don't follow one another")
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and (piece == MARK or set(piece) != {MARK}):
            if MARK in piece[1:]:
                raise ValueError(f"a piece crosses words: {piece!r}")
            found.append((piece, i, m.get_score(i)))
    if first_byte is None:
        raise ValueError("the model has no byte pieces")
    return PieceTable(found, first_byte, min(s for _, _, s in found) - UNKNOWN_PENALTY, max(len(p) for p, _, _ in found))
