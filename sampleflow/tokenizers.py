"""What a tokenizer does with boundary tokens, found by a probe on the driver.

A tokenizer is called with a text and gives a mapping with ``input_ids``; it has
``encode`` and the attributes bos_token, bos_token_id, eos_token, eos_token_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

PROBE = "A short line of text."


@dataclass(frozen=True)
class Behaviour:
    bos: int | None
    eos: int | None
    begins: bool
    ends: bool

    @classmethod
    def of(cls, tokenizer: Any) -> Behaviour:
        ids = tokenizer.encode(PROBE)
        if not isinstance(ids, list):
            raise ValueError("encode must give a list")
        if not ids:
            raise ValueError("the tokenizer gives no tokens for a text")
        if list(tokenizer(PROBE)["input_ids"]) != ids:
            raise ValueError("encode and the call give unlike tokens")
        bos = tokenizer.bos_token_id if tokenizer.bos_token else None
        eos = tokenizer.eos_token_id if tokenizer.eos_token else None
        return cls(bos, eos, bos is not None and ids[0] == bos, eos is not None and ids[-1] == eos)


def ends_to_add(b: Behaviour) -> tuple[int | None, int | None] | None:
    """(bos, eos) to add, None for neither; None alone where nothing is to be done. One token that serves
    as both is put at the end only."""
    if b.bos == b.eos:
        return None if b.begins or b.ends else (None, b.eos)
    return (None if b.begins else b.bos), (None if b.ends else b.eos)


class BytesTokenizer:
    """A text's bytes in UTF-8, with boundary tokens beyond them if asked for."""

    bos_token, bos_token_id, eos_token, eos_token_id = "<s>", 256, "</s>", 257

    def __init__(self, begins: bool = False, ends: bool = False):
        self.begins, self.ends = begins, ends

    def encode(self, text: str) -> list[int]:
        return [self.bos_token_id] * self.begins + list(text.encode()) + [self.eos_token_id] * self.ends

    def __call__(self, text: str, **_: Any) -> dict[str, list[int]]:
        return {"input_ids": self.encode(text)}
