"""Token counts of sections and fields by offset-mapped attribution.

A document is encoded once and whole, as a model would see it. The tokens' spans are then joined with the spans of its
sections, both in order, and every token goes to one section. A token that crosses a boundary goes by an explicit rule:
to the section of its first byte (`first`), of its last (`last`), or to the one that holds most of its bytes, the earlier
of equal ones (`most`). So the counts of a document's sections always sum to the count of the whole document.

One map over the rows; nothing is shuffled. A document's tokens are held as arrays of numbers, so memory follows the
longest document. The vocabulary is read on the driver from a path and sent to the tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import over_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("first", "last", "most")
#: Rows of results handed on at once.
ROWS = 50_000


def vocabulary_path() -> str:
    """Where the installed public tokenizer files keep the vocabulary; any other path may be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


class Vocabulary:
    """A byte-level vocabulary in the text form of token and rank, and the pattern that parts a text before merging."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path or vocabulary_path(), "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern

    def encoder(self):
        return _encoder(self.ranks, self.pattern)


@lru_cache(maxsize=2)
def _encoder(listed: bytes, pattern: str):
    """The encoding, and the bytes in each token."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, listed.splitlines())}
    sizes = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ends(text: str, encoder) -> np.ndarray:
    """The byte offset behind each token of a text."""
    encoding, sizes = encoder
    return np.cumsum(sizes[encoding.encode_to_numpy(text)]) if text else np.zeros(0, dtype=np.int64)


def attributed(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary.

    ends: byte offsets behind the tokens, which follow each other from 0. bounds: the sections' byte offsets from 0 to the
    end, ascending; an empty section gets no tokens.
    """
    sections = len(bounds) - 1
    starts = np.concatenate([[0], ends])[:-1]
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    owner = last if rule == "last" else first
    crossing = np.flatnonzero(first != last)
    if rule == "most" and len(crossing):
        owner = first.copy()
        for t in crossing.tolist():
            inner = bounds[first[t] : last[t] + 2].clip(starts[t], ends[t])
            owner[t] = first[t] + int(np.argmax(np.diff(inner)))
    return np.bincount(owner, minlength=sections), np.bincount(owner[crossing], minlength=sections)


def line_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte and character offsets of the lines of a text; a line end belongs to the line that it ends."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inner = np.flatnonzero(data == 10) + 1
    bounds = np.concatenate([[0], inner[inner < len(data)], [len(data)]])
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return bounds, letters[bounds]


def line_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None, rule: str = "first") -> DataFrame:
    """doc_id, section (from 0), first, last, n_tokens, n_crossing: one row per line of each row of docs (doc_id, text).

    first and last are code points, last exclusive. n_crossing counts those of the tokens that reach beyond the line.
    Null and empty texts have one section without tokens. Repeated rows are counted as often as they come; rows without an
    id are kept; other columns are ignored; an empty table gives no rows.
    """
    vocabulary = _checked(vocabulary, rule)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = vocabulary.encoder()
        for batch in batches:
            parts: list[tuple] = []
            waiting = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                bounds, letters = line_bounds(text.encode("utf-8", "replace"))
                tokens, crossing = attributed(token_ends(text, encoder), bounds, rule)
                parts.append(([doc_id] * len(tokens), letters[:-1], letters[1:], tokens, crossing))
                waiting += len(tokens)
                if waiting >= ROWS:
                    yield _line_rows(parts)
                    parts, waiting = [], 0
            if parts:
                yield _line_rows(parts)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, section int, first long, last long, n_tokens long, n_crossing long"
    return rows.mapInPandas(count, schema)


def _line_rows(parts: list[tuple]) -> pd.DataFrame:
    ids = pd.Series([i for part in parts for i in part[0]], dtype=object)
    section = np.concatenate([np.arange(len(part[0])) for part in parts])
    first, last, tokens, crossing = (np.concatenate([part[k] for part in parts]) for k in range(1, 5))
    return pd.DataFrame(
        {"doc_id": ids, "section": section, "first": first, "last": last, "n_tokens": tokens, "n_crossing": crossing}
    )


def field_tokens(
    rows: DataFrame,
    fields: Sequence[str],
    vocabulary: Vocabulary | None = None,
    separator: str = "\n",
    rule: str = "first",
) -> DataFrame:
    """The columns of rows, and tokens, a struct with the tokens of each field and the total.

    The fields are joined with the separator and encoded as one text; a separator belongs to the field before it. A null
    field is empty.
    """
    vocabulary = _checked(vocabulary, rule)
    fields = list(fields)

    @F.pandas_udf(", ".join(f"`{f}` long" for f in [*fields, "total"]))
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = vocabulary.encoder()
        for batch in batches:
            out = np.zeros((len(batch), len(fields) + 1), dtype=np.int64)
            for i, values in enumerate(zip(*[batch[f] for f in fields], strict=True)):
                texts = [v or "" for v in values]
                texts[:-1] = [t + separator for t in texts[:-1]]
                bounds = np.cumsum([0, *[len(t.encode("utf-8", "replace")) for t in texts]])
                ends = token_ends("".join(texts), encoder)
                out[i, :-1] = attributed(ends, bounds, rule)[0]
                out[i, -1] = len(ends)
            yield pd.DataFrame(out, columns=[*fields, "total"])

    return rows.withColumn("tokens", count(F.struct(*[F.col(f).cast("string").alias(f) for f in fields])))


def counter(vocabulary: Vocabulary | None = None) -> Callable[[], Callable[[list], list]]:
    """What starts counting in a task, as over_texts has it: from a list of texts to the tokens of each."""
    vocabulary = vocabulary or Vocabulary()

    def start():
        encoder = vocabulary.encoder()
        return lambda texts: [len(token_ends(t or "", encoder)) for t in texts]

    return start


def token_count(text: Column, vocabulary: Vocabulary | None = None) -> Column:
    """Tokens of each text, encoded whole; none for null."""
    return over_texts(text, "long", pa.int64(), counter(vocabulary))


def _checked(vocabulary: Vocabulary | None, rule: str) -> Vocabulary:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return vocabulary or Vocabulary()
