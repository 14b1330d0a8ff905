"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Every language has its own probability for each piece, learned from
labelled texts: the pieces that the public tokenizer cuts a word into are counted per language and smoothed. A word's
likelihood in a language is the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product
over its words; the prediction is the language with the largest posterior.

Learning is one map with a small row per language and piece from each task, and one grouping of them. Scoring is one map.
Nothing is shuffled by language, source or text, so hot ones do no harm. What comes to the driver is bounded by
languages x vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import PORTION, over_texts

#: A word is a run of letters, with the marks that follow them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"
VOCABULARY = "piece_bpe_32k.model"
#: Words remembered by a task, each with its likelihood per language, and texts whose new words are scored together.
REMEMBERED, TOGETHER = 250_000, 1024
SCORE = "lang_pred string, score double"
KIND = pa.struct({"lang_pred": pa.string(), "score": pa.float64()})


def vocabulary_path() -> str:
    """Where the installed public tokenizer files keep the vocabulary; any other path may be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _can_occur(piece: str) -> bool:
    """Whether a piece can be cut from a lower-case word with a mark before it."""
    rest = piece.removeprefix("▁")
    return not rest or (rest == rest.lower() and regex.fullmatch(r"[\p{L}\p{M}]+", rest) is not None)


class Scorer:
    """Log-likelihoods of words for each language, from piece probabilities."""

    def __init__(self, pieces: list[str], probs: np.ndarray, unknown: np.ndarray):
        """probs: one row per piece, one column per language. unknown: what a character outside the vocabulary has."""
        own = {piece: i for i, piece in enumerate(pieces) if _can_occur(piece)}
        self.table = np.vstack([probs, unknown])
        self.unknown = len(pieces)
        self.longest = max(map(len, own), default=1)
        # Ends of pieces are kept too, as -1: where a text's end is none of them, no longer piece ends there either.
        self.index = {piece[i:]: -1 for piece in own for i in range(1, len(piece))} | own
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((0, probs.shape[1]))

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """One row per word: the log of the summed probability of all segmentations, per language.

        The forward sum at a place depends on the letters before it only, so it is taken once for all words that begin
        alike: letter by letter, over the different beginnings. Each has a scale of its own, so that long words don't
        vanish.
        """
        out = np.zeros((len(words), self.table.shape[1]))
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        going, beginning = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        sums, scales = [np.ones((1, out.shape[1]))], [np.zeros(1)]
        back: list[np.ndarray] = []  # for each beginning, where it was 1, 2, ... letters ago
        for length in range(1, int(lengths.max(initial=0)) + 1):
            going = going[lengths[going] >= length]
            numbers: dict[str, int] = {}
            own = np.array([numbers.setdefault(words[i][: length - 1], len(numbers)) for i in going.tolist()])
            parent = np.empty(len(numbers), dtype=np.int64)
            parent[own] = beginning[going]
            beginning[going] = own
            back = [parent, *[b[parent] for b in back[: self.longest - 1]]]
            marked = ["▁" + text for text in numbers]
            total, scale = np.zeros((len(marked), out.shape[1])), scales[-1][parent]
            alive = np.arange(len(marked))
            for k, before in enumerate(back, start=1):
                missing = self.unknown if k == 1 else -2
                ids = np.array([self.index.get(marked[i][-k:], missing) for i in alive.tolist()], dtype=np.int64)
                if k == 1:
                    ids[ids == -1] = self.unknown
                known = ids >= 0
                here, at = alive[known], before[alive[known]]
                factor = np.exp(scales[-k][at] - scale[here])[:, None]
                total[here] += sums[-k][at] * factor * self.table[ids[known]]
                alive = alive[ids != -2]
                if not len(alive):
                    break
            top = total.max(axis=1, keepdims=True)
            sums, scales = [*sums, total / top][-self.longest :], [*scales, scale + np.log(top[:, 0])][-self.longest :]
            ending = lengths[going] == length
            with np.errstate(divide="ignore"):
                out[going[ending]] = np.log(sums[-1][own[ending]]) + scales[-1][own[ending]][:, None]
        return out

    def totals(self, texts: list[Counter]) -> np.ndarray:
        """Summed log-likelihood of each text's counted words.

        Words not seen before are scored together, for all texts at once; the memory is emptied when it is full.
        """
        new = {w for words in texts for w in words if w not in self.rows}
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, self.logs, new = {}, self.logs[:0], {w for words in texts for w in words}
        if new:
            listed = sorted(new)
            self.rows.update(zip(listed, range(len(self.rows), len(self.rows) + len(listed)), strict=True))
            self._append(self.log_likelihoods(listed), len(self.rows))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(texts):
            at = np.fromiter((self.rows[w] for w in words), np.int64, len(words))
            out[i] = np.fromiter(words.values(), np.float64, len(words)) @ self.logs[at]
        return out

    def _append(self, scored: np.ndarray, used: int) -> None:
        """Rows are kept in an array that grows by half, so that adding words copies little."""
        if used > len(self.logs):
            grown = np.zeros((max(used * 3 // 2, 1024), scored.shape[1]))
            grown[: used - len(scored)] = self.logs[: used - len(scored)]
            self.logs = grown
        self.logs[used - len(scored) : used] = scored


class LanguageModel:
    """Piece probabilities of every learned language, and how often each occurred."""

    def __init__(self, languages: list[str], pieces: list[str], counts: np.ndarray, texts: np.ndarray, smooth: float):
        """counts: one row per piece, one column per language."""
        self.languages, self.pieces = languages, pieces
        total = counts.sum(axis=0) + smooth * (len(pieces) + 1)
        self.probs = (counts + smooth) / total
        self.unknown = np.full(len(languages), smooth) / total if languages else np.zeros(0)
        self.log_prior = np.log(texts / texts.sum()) if languages else np.zeros(0)

    def predict(self, text: Column) -> Column:
        """Struct of lang_pred and score for a text column."""
        languages, pieces, probs, unknown, prior = self.languages, self.pieces, self.probs, self.unknown, self.log_prior

        def start():
            scorer = Scorer(pieces, probs, unknown)
            return lambda texts: _predict(scorer, languages, prior, texts)

        return over_texts(text, SCORE, KIND, start, TOGETHER)


def _predict(scorer: Scorer, languages: list[str], prior: np.ndarray, texts: list[str | None]) -> list[dict]:
    counted = [Counter(words_of(t)) if languages else Counter() for t in texts]
    out = []
    for words, total in zip(counted, scorer.totals(counted), strict=True):
        if words:
            logs = prior + total
            best = int(np.argmax(logs))
            score = float(1 / np.exp(np.minimum(logs - logs[best], 0)).sum())
            out.append({"lang_pred": languages[best], "score": score})
        else:
            out.append({"lang_pred": UNDETERMINED, "score": 0.0})
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3. A missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(labelled: DataFrame, path: str | None = None, smooth: float = 0.5) -> LanguageModel:
    """A model from rows (text, lang); rows without a language or without letters teach nothing.

    Every labelled row is read. path: a sentencepiece model file, read on the driver and sent to the tasks.
    """
    import sentencepiece

    with open(path or vocabulary_path(), "rb") as f:
        model = f.read()
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = processor.get_piece_size()
    special = [processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) for i in range(size)]

    kinds = pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces: dict[str, np.ndarray] = {}
        texts: Counter = Counter()
        pending: dict[str, Counter] = {}
        for batch in batches:
            parts = (batch.slice(at, PORTION).columns for at in range(0, batch.num_rows, PORTION))
            for text, lang in (row for part in parts for row in zip(*(c.to_pylist() for c in part), strict=True)):
                words = words_of(text)
                if words:
                    texts[lang] += 1
                    pending.setdefault(lang, Counter()).update(words)
                    if len(pending[lang]) > REMEMBERED:
                        _cut(cutter, pending.pop(lang), pieces.setdefault(lang, np.zeros(size)))
            pa.default_memory_pool().release_unused()
        for lang, words in pending.items():
            _cut(cutter, words, pieces.setdefault(lang, np.zeros(size)))
        for lang, counts in pieces.items():
            used = np.flatnonzero(counts)
            rows = [lang] * (len(used) + 1), np.append(used, -1), np.append(counts[used], texts[lang])
            yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds.types, strict=True)], schema=kinds)

    taught = labelled.where("lang is not null and text is not null").select("text", "lang")
    rows = taught.mapInArrow(count, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    languages = sorted(found["lang"].unique())
    column = {lang: i for i, lang in enumerate(languages)}
    counts, texts = np.zeros((size, len(languages))), np.zeros(len(languages))
    for lang, piece, n in zip(found["lang"], found["piece"], found["n"], strict=True):
        if piece < 0:
            texts[column[lang]] = n
        else:
            counts[piece, column[lang]] = n
    kept = [i for i in range(size) if not special[i]]
    return LanguageModel(languages, [processor.id_to_piece(i) for i in kept], counts[kept], texts, smooth)


def _cut(cutter, words: Counter, into: np.ndarray) -> None:
    """Adds the pieces of counted words."""
    listed = list(words)
    for at in range(0, len(listed), 20_000):
        part = listed[at : at + 20_000]
        cut = cutter.encode(part, num_threads=1)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        times = np.repeat(np.fromiter((words[w] for w in part), np.float64, len(part)), sizes)
        into += np.bincount(np.fromiter((i for ids in cut for i in ids), np.int64, sizes.sum()), times, len(into))


def languages(docs: DataFrame, path: str | None = None, smooth: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per row of docs (doc_id, text, lang).

    Learns from rows that aren't held out. Null and empty texts, and texts without a letter, get `und` with score 0, as does
    every text when nothing could be learned. Equal likelihoods go to the language first in alphabetical order. Repeated
    rows are predicted as often as they come; a missing doc_id is not held out; other columns are ignored.
    """
    own = docs.select("doc_id", "text", "lang")
    model = learn(own.where(~held_out(F.col("doc_id"))), path, smooth)
    found = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
