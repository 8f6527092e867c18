"""An existing SentencePiece vocabulary: its pieces, and weights read from the scores in its file."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import cache

PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE, NORMAL = 6, 1


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """Fields of a protocol-buffer message: (number, value)."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield tag >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    """``blob`` holds every id's piece (empty where it is none that a text can match), as the kernels read it."""

    blob: bytes
    log_p: tuple[float, ...]
    byte_log_p: float
    first_byte: int
    size: int


@cache
def load(path: str = PATH, byte_share: float = 0.02) -> Vocabulary:
    """Pieces and natural-log weights of a model file.

    Files of the byte-pair kind hold merge ranks as scores, so a weight is read from a score by Zipf's law,
    1 / (rank + 2.7); files of the unigram kind hold log probabilities, taken as they are. Weights are scaled to add up to one, with ``byte_share``
    for the 256 bytes together. Pieces with a mark after another character are refused.
    """
    with open(path, "rb") as f:
        data = f.read()
    pieces, unigram = [], True
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
        elif number == 2:
            unigram = dict(_fields(value)).get(3, 1) == 1
    blob, weight, first_byte = bytearray(), [], -1
    for i, (text, score, kind) in enumerate(pieces):
        own = kind == NORMAL
        if kind == BYTE and first_byte < 0:
            first_byte = i
        if own and MARK in text.lstrip(MARK):
            raise ValueError(f"piece {text!r} crosses a word's start")
        raw = text.encode().replace(MARK.encode(), b"\xff") if own else b""
        blob += struct.pack(">H", len(raw)) + raw
        rank = -score if -score < 1e8 else len(pieces)
        weight.append((math.exp(score) if unigram else 1 / (rank + 2.7)) if own else 0.0)
    total = sum(weight) / (1 - byte_share)
    log_p = tuple(math.log(w / total) if w else -math.inf for w in weight)
    return Vocabulary(bytes(blob), log_p, math.log(byte_share / 256), first_byte, len(pieces))
