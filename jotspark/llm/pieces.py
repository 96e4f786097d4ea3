"""A fixed public piece vocabulary, read once on the driver and broadcast (its size is that of the file)."""

from __future__ import annotations

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the start of a pre-token in the vocabulary.
MARK = "▁"


def load(path: str = DEFAULT_MODEL) -> dict[str, int]:
    """Piece -> rank; control and byte pieces, and those with an inner mark, are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if MARK not in piece[1:]:
            out.setdefault(piece, len(out))
    return out
