"""Token counts by the whole-token shortcut.

A vocabulary string that the tokenizer encodes alone as one token, and that its splitting pattern
leaves whole, needs no merging wherever it occurs as a pre-token.  ``WholeTokens.proven`` proves this once
for each vocabulary string, on the driver, before any document is read; the proven set is broadcast, and counting
looks pre-tokens up in it and merges only the others.  Counts are remembered by chunk between spaces, as a chunk
with the space before it is split alike wherever it stands.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import ship

#: Entries of a worker's memory of chunk counts; at this size it starts anew.
MEMORY = 400_000
#: Chunks over this many characters are not remembered.
LONG = 200
#: A text with such white space is split by the pattern as a whole.
_GAPS = re.compile(r" (?:\s|\Z)|\A\s")


def _newer() -> str:
    """The characters newer than Unicode 3.2, as a class: one library may take them for letters, another for unassigned."""
    import unicodedata

    old = unicodedata.ucd_3_2_0.category
    new = [c for c in range(0x110000) if old(chr(c)) == "Cn" and not 0xD800 <= c < 0xE000]
    runs, start = [], None
    for a, b in zip(new, new[1:] + [-2]):
        start = a if start is None else start
        if b != a + 1:
            runs.append(f"\\U{start:08x}-\\U{a:08x}")
            start = None
    return "".join(runs)


class WholeTokens:
    """A byte-level BPE tokenizer (text of a ``tokenizers`` JSON file) with its proven whole tokens, which ``proven`` gives."""

    def __init__(self, spec: str, pattern: str, whole: frozenset[str] | None = None, newer: str | None = None):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        j = json.loads(spec)
        if (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or j["pre_tokenizer"].get("add_prefix_space") or j.get("normalizer"):
            raise ValueError("the shortcut is proven for byte-level BPE without a normaliser or prefix space")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [a["content"] for a in j.get("added_tokens", [])]
        self.plain_added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in j.get("added_tokens", []))
        self.pattern = regex.compile(pattern)
        self.add_split = regex.compile("|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.newer_class = _newer() if newer is None else newer
        self.newer = regex.compile(f"[{self.newer_class}]")
        self.whole = self._prove() if whole is None else whole
        #: Counts of chunks at the start of a text, and of those with a space before them, by the chunk alone.
        self.memory: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.checked: dict[str, bool] = {}

    @classmethod
    def proven(cls, spec: str, pattern: str) -> tuple[frozenset[str], str]:
        """The proven whole tokens and the class of newer characters, for the constructor."""
        made = cls(spec, pattern)
        return made.whole, made.newer_class

    def _has_newer(self, text: str) -> bool:
        """Whether the text has a character newer than Unicode 3.2."""
        if text.isascii():
            return False
        checked = self.checked
        found = False
        for c in set(text):
            new = checked.get(c)
            if new is None:
                new = checked[c] = bool(self.newer.match(c))
            found |= new
        return found

    def _prove(self) -> frozenset[str]:
        """The vocabulary strings that stay whole under the pattern and encode as their own single id."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        decoded = [self.tokenizer.decoder.decode([t]) for t in vocab]
        # a token that is part of a character decodes to U+FFFD, which no longer encodes to that id
        encoded = self.tokenizer.encode_batch(decoded, add_special_tokens=False)
        return frozenset(s for s, i, e in zip(decoded, vocab.values(), encoded) if e.ids == [i] and self.pattern.findall(s) == [s])

    def _learn(self, chunks: set[str], spaced: bool, rest: dict[str, list[tuple[bool, str]]]) -> None:
        """Put the counts of new chunks into the memory; pre-tokens to merge, into rest, are added later."""
        memory, whole, find = self.memory[spaced], self.whole, self.pattern.findall
        for c in chunks:
            n = 0
            for p in find(" " + c if spaced else c):
                if p in whole:
                    n += 1
                else:
                    rest.setdefault(p, []).append((spaced, c))
            memory[c] = n

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; None counts as empty."""
        out, memory = [0] * len(texts), self.memory
        if len(memory[0]) + len(memory[1]) > MEMORY:
            memory[0].clear()
            memory[1].clear()
        jobs: list[tuple[int, bool, list[str]]] = []
        new: tuple[set[str], set[str]] = (set(), set())
        for k, text in enumerate(texts):
            if not text:
                continue
            if self._has_newer(text) or (self.added and not self.plain_added):
                out[k] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            parts = [text]
            if self.add_split and any(a in text for a in self.added):
                parts = self.add_split.split(text)
                out[k] += len(parts) - 1
            for part in parts:
                if _GAPS.search(part):
                    jobs.append((k, False, self.pattern.findall(part)))
                elif part:
                    got = part.split(" ")
                    jobs.append((k, False, got[:1]))
                    jobs.append((k, True, got[1:]))
        for _, spaced, chunks in jobs:
            new[spaced].update(chunks)
        rest: dict[str, list[tuple[bool, str]]] = {}
        for spaced in (False, True):
            new[spaced].difference_update(memory[spaced])
            self._learn(new[spaced], spaced, rest)
        words = list(rest)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                n = len(e.ids)
                for spaced, c in rest[w]:
                    memory[spaced][c] += n
        for k, spaced, chunks in jobs:
            out[k] += sum(map(memory[spaced].__getitem__, chunks))
        for spaced in (False, True):
            for c in [c for c in new[spaced] if len(c) > LONG]:
                del memory[spaced][c]
        return out


_made: dict[int, WholeTokens] = {}


def count_tokens(df: DataFrame, text_col: str = "text", *, tokenizer_path: str, pattern: str, out_col: str = "n_tokens") -> DataFrame:
    """df with out_col, a long: the tokens of the whole text as the ``tokenizers`` library counts them
    with its defaults, without tokens that it would add, truncation or padding.

    A null text counts as empty: 0.  Repeated rows each get their count.  A column of df named out_col
    is replaced; all others stay.  The tokenizer file is read on the driver and broadcast; its size does
    not depend on the data.  One pass, no shuffle.
    """
    ship(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = df.sparkSession.sparkContext.broadcast((text, *WholeTokens.proven(text, pattern)))

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text, whole, newer = spec.value
        key = hash((text, pattern))
        if key not in _made:
            _made.clear()
            _made[key] = WholeTokens(text, pattern, whole, newer)
        made = _made[key]
        for texts in parts:
            values = texts.tolist()
            yield pd.Series([n for at in range(0, len(values), 1000) for n in made.counts(values[at : at + 1000])], dtype="int64")

    return df.withColumn(out_col, count(df[text_col].cast("string")))
