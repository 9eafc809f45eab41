"""Exact token counts by a whole-token shortcut.

For a BPE file with word ends it is proved once, string by string, which
entries of the vocabulary encode alone as exactly one token. A pre-token
among them counts as one without any merging; only the rest are merged, by the
library's own model, and remembered.

No token reaches over a space, a tab or a line end, and no normal form does, so a
text is counted stretch by stretch. Stretches of characters up to U+024F and
common punctuation are normalised and split here; only those with other
characters, or with a special string, go through the library, so that counts
agree everywhere.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from sparkgraph.llm.segment_bpe import byte_chars
from sparkgraph.llm.shared import small_batches
from sparkgraph.llm.textvec import rows_by_bytes

#: Fixed by the file format: the pre-token pattern that this module knows.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pre-tokens whose counts a worker remembers before it forgets all but the whole tokens.
REMEMBERED = 400_000

#: Characters whose normal form, case and class are the same in every Unicode version in use.
_PLAIN = regex.compile("[\t\n\r -\x7e\xa0-ɏ‐-‧‰-⁞€]*+")


#: White space that is dropped whatever stands beside it.
_SPACE = regex.compile("[ \t\n\r]++")


class Counter:
    """Counts tokens as the ``tokenizers`` library does with the file at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        pattern = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or pattern != PRE_TOKENS:
            raise ValueError(f"not a BPE file with word ends of the known form: {path}")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self._chars = byte_chars()
        self._split = regex.compile(PRE_TOKENS)
        self._marks = [t["content"] for t in spec["added_tokens"]]
        self.whole = self._whole_tokens(model["vocab"], model["end_of_word_suffix"])
        self._known: dict[str, int] = dict.fromkeys(self.whole, 1)

    def _whole_tokens(self, vocabulary: dict[str, int], suffix: str) -> list[str]:
        """The strings that are one pre-token and encode alone as one token; each is tried."""
        back = {c: b for b, c in enumerate(self._chars)}
        out = []
        for token, number in vocabulary.items():
            if not token.endswith(suffix) or token == suffix:
                continue
            written = token.removesuffix(suffix)
            try:
                text = bytes(back[c] for c in written).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self._split.fullmatch(text) and [t.id for t in self.model.tokenize(written)] == [number]:
                out.append(text)
        return out

    def _merged(self, piece: str) -> int:
        return len(self.model.tokenize("".join([self._chars[b] for b in piece.encode()])))

    def count(self, text: str) -> int:
        marked = any(mark in text for mark in self._marks)
        if not marked and _PLAIN.fullmatch(text):
            return self._count(text)
        if any(_SPACE.search(mark) for mark in self._marks):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        plain, other = [], []
        for piece in _SPACE.split(text):
            sure = _PLAIN.fullmatch(piece) and not (marked and any(mark in piece for mark in self._marks))
            (plain if sure else other).append(piece)
        return self._count(" ".join(plain)) + (len(self.library.encode(" ".join(other), add_special_tokens=False).ids) if other else 0)

    def _count(self, text: str) -> int:
        """The count of a text of plain characters without special strings."""
        known, pieces = self._known, self._split.findall(unicodedata.normalize("NFC", text).lower())
        counts = list(map(known.get, pieces))
        if None in counts:
            if len(known) > REMEMBERED + len(self.whole):
                self._known = known = dict.fromkeys(self.whole, 1)
            for piece in {p for p, n in zip(pieces, counts, strict=True) if n is None}:
                known[piece] = self._merged(piece)
            return sum(n if n is not None else known[p] for p, n in zip(pieces, counts, strict=True))
        return sum(counts)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text in ``out_col`` (long).

    Without begin, end or other added tokens, truncation or padding; special
    strings inside a text count as the library takes them by default. Null and
    empty texts have 0. A column of the name ``out_col`` is replaced.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    small_batches(docs.sparkSession)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    given = docs.toDF(*names)
    schema = T.StructType([*given.schema.fields, T.StructField("__n", T.LongType(), False)])
    at, arrow = docs.columns.index(text_col), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for rows, _, _ in rows_by_bytes(batch, names[at]):
                counts = [own.count(t or "") for t in rows.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(counts, pa.int64())], schema=arrow)

    kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != out_col]
    return given.mapInArrow(run, schema).select(*kept, F.col("__n").alias(out_col))
