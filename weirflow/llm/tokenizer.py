"""Byte-level BPE tokenizers from public files: one description for the driver, one encoder per Python worker."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.llm.common import once

#: The pre-token pattern of byte-level BPE, with white space written out so that every regex engine agrees.
SPACE = r"\t-\r\x{85}\p{Z}"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the printable alphabet in which byte-level vocabularies are written."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file read once on the driver; its size is fixed by the vocabulary, a few MB."""

    text: str
    special: tuple[tuple[str, int], ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        j = json.loads(text)
        if j["model"]["type"] != "BPE" or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no byte-level BPE tokenizer")
        special = sorted(((t["content"], t["id"]) for t in j.get("added_tokens", [])), key=lambda x: (-len(x[0]), x[0]))
        return cls(text, tuple(special))

    def pieces(self) -> list[bytes]:
        """Bytes of each id; ids without a piece are empty."""
        alphabet = byte_alphabet()
        vocab = json.loads(self.text)["model"]["vocab"]
        out = [b""] * (1 + max([*vocab.values(), *(i for _, i in self.special)]))
        for word, i in vocab.items():
            out[i] = bytes(alphabet[c] for c in word)
        for word, i in self.special:
            out[i] = word.encode()
        return out

    def split(self, text: Column) -> Column:
        """array<string> of the pre-tokens of a text, in order, split by Spark; their concatenation is the text.

        A text with characters that Java's Unicode version doesn't know stays whole: the encoder splits it.
        """
        plain = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
        unknown = text.rlike(r"\p{Cn}")
        if not self.special:
            return F.when(unknown, F.array(text)).otherwise(plain)
        names = [w for w, _ in self.special]
        any_name = "(?:" + "|".join(f"\\Q{w}\\E" for w in names) + ")"
        cut = F.split(text, f"(?={any_name})|(?<={any_name})")
        parts = F.flatten(F.transform(cut, lambda s: F.when(s.isin(names), F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)))))
        has = F.lit(False)
        for w in names:
            has = has | F.contains(text, F.lit(w))
        return F.when(unknown, F.array(text)).when(has, parts).otherwise(plain)


class Encoder:
    """Encodes texts as the tokenizers library does by default; much faster where the ids follow the merge order."""

    def __init__(self, text: str):
        self.fast = self._ranked(json.loads(text))
        if self.fast is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(text)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()

    @staticmethod
    def _ranked(j: dict):
        """The same BPE in tiktoken: valid if each merge makes the next id and the 256 bytes come first."""
        import tiktoken

        model, alphabet = j["model"], byte_alphabet()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        order = sorted(model["vocab"], key=model["vocab"].get)
        if order[256:] != merged or set(order[:256]) != set(alphabet) or model.get("ignore_merges") or model.get("dropout") or j.get("normalizer"):
            return None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j.get("added_tokens", [])):
            return None
        return tiktoken.Encoding(
            "ranked",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks={bytes(alphabet[c] for c in w): i for w, i in model["vocab"].items()},
            special_tokens={t["content"]: t["id"] for t in j.get("added_tokens", [])},
        )

    def encode(self, texts: list[str]) -> list:
        if self.fast is not None:
            return [self.fast.encode(t, allowed_special="all") for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def lengths(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(len, self.encode(texts)), dtype=np.int64, count=len(texts))


def encoder(text: str) -> Encoder:
    return once(("encoder", hash(text)), lambda: Encoder(text))
