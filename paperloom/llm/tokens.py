"""Token counts with a whole-token shortcut.

Offline (once, on the driver), every vocabulary string is encoded alone; those that give exactly themselves are whole tokens. A text is cut
into pre-tokens; a pre-token that is a whole token counts one at once, and only the rest are merged by the library, each
distinct one once for as long as it stays in a bounded table.

A null text is empty and has no tokens. Texts of any length are cut at places where a pre-token must begin, so memory does
not grow with the longest text. Texts with code points whose class the library's pre-tokenizer may see otherwise (``ODD``)
go to the library whole. Rows come back in place: nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import arrow_map, text_bytes

#: Pre-tokens of up to this many distinct kinds are remembered by a task.
MEMORY = 400_000
#: Characters of a text that are cut at once.
CHUNK = 1 << 19
#: Code points outside the ranges whose classes were compared one by one with the library's (tests/llm/test_tokens.py).
ODD = "[\u0530-\u1fff\u2070-\u209f\u2c00-\U0010ffff]"


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut a long text before single spaces that precede a letter: byte-level pre-tokens never span such a place."""
    start, n = 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while at != -1 and not (at + 1 < n and text[at + 1].isascii() and text[at + 1].isalpha() and not text[at - 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        yield text[start:at]
        start = at
    if start < n or not n:
        yield text[start:]


class Counter:
    """Counts tokens as ``tokenizers`` does for a byte-level BPE file, special strings in texts included.

    ``whole`` holds the whole tokens, where they were proven before.
    """

    def __init__(self, path: str, whole: list[str] | None = None) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.odd = regex.compile(ODD).search
        self.special = regex.compile("|".join(map(regex.escape, self.specials))).split if self.specials else (lambda text: [text])
        self.whole = self.prove() if whole is None else whole
        self.known = dict.fromkeys(self.whole, 1)

    def prove(self) -> list[str]:
        """Vocabulary strings that encode alone as themselves and are one pre-token."""
        ids = sorted(set(self.library.get_vocab().values()))
        strings = self.library.decode_batch([[i] for i in ids], skip_special_tokens=False)
        found = self.library.encode_batch(strings, add_special_tokens=False)
        return [s for i, s, e in zip(ids, strings, found, strict=True) if e.ids == [i] and s not in self.specials and len(self.cut(s)) == 1]

    def count(self, text: str) -> int:
        if self.odd(text):
            return sum(len(self.library.encode(part, add_special_tokens=False).ids) for part in safe_chunks(text))
        total = 0
        for at, part in enumerate(self.special(text)):
            total += at > 0
            for chunk in safe_chunks(part):
                words = self.cut(chunk)
                if rest := list(set(words).difference(self.known)):
                    if len(self.known) + len(rest) > MEMORY:
                        self.known = dict.fromkeys(self.whole, 1)
                        rest = list(set(words).difference(self.known))
                    self.known.update(zip(rest, (len(e.ids) for e in self.library.encode_batch(rest, add_special_tokens=False)), strict=True))
                total += sum(map(self.known.__getitem__, words))
        return total


def count_tokens(documents: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    kind = dict(documents.select(id_col).dtypes)[id_col]
    whole = Counter(path).whole  # proven once; no more strings than the vocabulary has

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(path, whole)

        def work(batch: pa.RecordBatch):
            sizes, counts = [], []
            for raw in text_bytes(batch.column(1)):
                sizes.append(len(raw))
                counts.append(counter.count(raw.decode()))
            yield {id_col: batch.column(0), "n_bytes": sizes, "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return work

    return arrow_map(documents, [id_col, text_col], f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
