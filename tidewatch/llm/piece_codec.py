"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A merge-type vocabulary joins neighbouring symbols, the best-scored piece first and the leftmost of equals, until nothing
joins. The same tokens come out of a search that never merges the text itself: a sequence of tokens is that result exactly
when each two neighbours, merged anew on their own, come out as the same two tokens. So the search goes from left to right,
takes the longest piece that starts at a position (Aho-Corasick over the reversed text gives it for all positions at once),
goes on to shorter ones while the pair with the token before doesn't hold, and steps back when none does. A bitfield keeps
the positions from which nothing led on, so none is searched twice and the work grows with the text's length.

No piece holds a space mark behind another letter, nor a letter outside its alphabet. A text is parted at these places,
which changes nothing, and short parts are remembered within bounds. One map over the rows; nothing is shuffled; a text is
held whole, so memory follows the longest one. The model is read on the driver from a path and sent to the tasks.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import PORTION, over_texts

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts of texts (twice as many) and pairs of pieces that a process remembers at most; parts up to this length.
REMEMBERED, PAIRS, PART = 250_000, 300_000, 40


def model_path() -> str:
    """Where the installed public tokenizer files keep the model; any other path may be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


class Model:
    """A merge-type model file. It must leave texts as they are but for space marks: others are refused."""

    def __init__(self, path: str | None = None):
        with open(path or model_path(), "rb") as f:
            self.stored = f.read()
        self.codec()

    def codec(self) -> Codec:
        return _codec(self.stored)


@lru_cache(maxsize=2)
def _codec(stored: bytes) -> Codec:
    return Codec(stored)


def _one_by_one(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("tidewatch-one-by-one", _one_by_one)


class Codec:
    """Encodes and decodes single texts; made once in a process."""

    never = math.inf

    def __init__(self, stored: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(stored)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        rules = model.normalizer_spec
        same = rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        spec = model.trainer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix or not same:
            raise ValueError("only merge-type models with bytes for unknown letters and unchanged texts are served")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not served")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.scores: dict[str, float] = {}
        self.ids: dict[str, list[int]] = {}
        self.byte_ids = [0] * 256
        #: What each id is decoded to, and whether it is a control piece or an ordinary one.
        self.surface: list[bytes] = []
        self.control, self.ordinary = set(), set()
        for i, p in enumerate(model.pieces):
            surface = b""
            if p.type == kinds.NORMAL:
                self.scores[p.piece], self.ids[p.piece] = p.score, [i]
                surface = p.piece.replace(SPACE, " ").encode()
                self.ordinary.add(i)
            elif p.type == kinds.BYTE:
                byte = int(p.piece[3:5], 16)
                self.byte_ids[byte], surface = i, bytes([byte])
            elif p.type == kinds.UNKNOWN:
                surface = spec.unk_surface.encode()
            else:
                self.control.add(i)
            self.surface.append(surface)
        pieces = list(self.scores)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces with a space mark behind a letter are not served")
        alphabet = set("".join(pieces))
        for letter in alphabet - set(pieces):
            self.ids[letter] = self._bytes(letter)
        known = "".join(map(re.escape, sorted(alphabet - {SPACE})))
        self.part = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]", re.DOTALL)
        #: Tokens by number: as text, as bytes of ids, and the number of the next shorter one that it begins with, -1 for a letter.
        self.tokens_of = list(self.ids)
        self.token_ids = list(map(self._stored, self.ids.values()))
        self.sizes = list(map(len, self.tokens_of))
        number = {token: i for i, token in enumerate(self.tokens_of)}
        beginnings = ([number.get(token[:n], -1) for n in range(len(token) - 1, 0, -1)] for token in self.tokens_of)
        self.shorter = [next((i for i in shorter if i >= 0), -1) for shorter in beginnings]
        self.longest = ahocorasick.Automaton()
        for token, i in number.items():
            self.longest.add_word(token[::-1], i)
        self.longest.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        #: Ids of remembered parts, as the bytes of 32-bit numbers.
        self.parts: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        #: What ids are decoded to, and behind these, what they are decoded to at the begin of a text.
        at_begin = [x[1:] if i in self.ordinary and x[:1] == b" " else x for i, x in enumerate(self.surface)]
        self.surfaces = pa.array(self.surface + at_begin, pa.binary())
        self.is_control = np.isin(np.arange(len(self.surface)), list(self.control))

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8", "replace")]

    @staticmethod
    def _stored(ids: list[int]) -> bytes:
        return np.array(ids, dtype=np.int32).tobytes()

    def _best(self, parts: list[str]) -> tuple[float, int]:
        """The best score of two neighbours, and where the leftmost with it begin; -1 if nothing merges."""
        best, at, get = -self.never, -1, self.scores.get
        for i in range(len(parts) - 1):
            score = get(parts[i] + parts[i + 1])
            if score is not None and (at < 0 or score > best):
                best, at = score, i
        return best, at

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging, as the vocabulary defines them."""
        parts = list(text)
        while True:
            _, at = self._best(parts)
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _edges(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The symbols at one end of a token while it is merged, each with the lowest score merged until the next is there.

        Empty for a token that merging doesn't give. Merges of lower scores wait, so that score is when the symbol goes.
        """
        kept = self.edges[right]
        found = kept.get(token)
        if found is None:
            parts, found, lowest = list(token), [], self.never
            while True:
                score, at = self._best(parts)
                if at < 0:
                    break
                lowest = min(lowest, score)
                if at == (len(parts) - 2 if right else 0):
                    found.append((parts[-1 if right else 0], lowest))
                    lowest = self.never
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = [*found, (token, -self.never)] if len(parts) == 1 else []
            kept[token] = found
        return found

    def fits(self, before: str, token: str) -> bool:
        """Whether merging leaves two neighbours as they are; with nothing before, the token alone.

        Both tokens' own merges run again side by side, the better score first, the left one of equals. They stay apart
        if at no time the symbols that meet would merge before either is merged away.
        """
        rights, lefts = self._edges(before, True) if before else [("", -self.never)], self._edges(token, False)
        if not rights or not lefts:
            return False
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = rights[i], lefts[j]
            across = self.scores.get(x + y) if x else None
            if across is not None and across > x_goes and across >= y_goes:
                return False
            if x_goes == y_goes == -self.never:
                return True
            if x_goes >= y_goes:
                i += 1
            else:
                j += 1

    def tokens(self, part: str) -> list[int]:
        """The tokens, by number, of a part that has letters of the alphabet only."""
        size = len(part)
        longest, last = [], -1
        for behind, token in self.longest.iter(part[::-1]):  # of each place, the longest token comes first
            if behind != last:
                longest.append(token)
                last = behind
        longest.reverse()
        failed = bytearray(size // 8 + 1)
        sizes, shorter, pairs, many = self.sizes, self.shorter, self.pairs, len(self.sizes)
        taken: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            fits = False
            if not failed[end >> 3] >> (end & 7) & 1:
                key = before * many + token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    names = self.tokens_of
                    fits = pairs[key] = self.fits(names[before] if before >= 0 else "", names[token])
            if fits:
                taken.append(token)
                if end == size:
                    return taken
                at, before, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing leads on from here: go back, where the token that came here is no longer taken
                failed[at >> 3] |= 1 << (at & 7)
                token = taken.pop()
                at -= sizes[token]
                before = taken[-1] if taken else -1

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text, without begin or end; none for null or empty."""
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def encoded(self, text: str | None) -> bytes:
        """Token ids of a whole text as the bytes of 32-bit numbers."""
        if not text:
            return b""
        parts = self.part.findall(self.prefix + text.replace(" ", SPACE))
        out = [*map(self.parts.get, parts)]
        if None in out:
            out = [self._part(part) if ids is None else ids for part, ids in zip(parts, out, strict=True)]
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """Token ids of many texts."""
        found = [*map(self.encoded, texts)]
        offsets = np.zeros(len(found) + 1, dtype=np.int32)
        np.cumsum([len(ids) >> 2 for ids in found], out=offsets[1:])
        return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), np.int32)))

    def _part(self, part: str) -> bytes:
        """Ids of a part, which is remembered if it is short; what was used least lately is forgotten."""
        known = self.parts.get(part)
        if known is not None:
            return known
        ids = self.former.get(part)
        if ids is None:
            if part[-1] == SPACE or part[-1] in self.ids:
                ids = b"".join([self.token_ids[token] for token in self.tokens(part)])
            else:
                ids = self._stored(self._bytes(part))
        if len(part) <= PART:
            if len(self.parts) >= REMEMBERED:
                self.former, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of many lists of token ids, none of them null.

        The pieces of all are joined at once. Texts with control pieces, or with bytes that form no letter, go one by one.
        """
        numbers = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()]
        at = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        if len(numbers) and self.is_control[numbers].any():
            return pa.array([self.decode(x) for x in ids.to_pylist()], pa.string())
        if self.prefix and len(numbers):
            numbers = numbers.copy()
            begins = at[:-1][np.diff(at) > 0]
            numbers[begins] += len(self.surface)
        joined = pc.binary_join(pa.ListArray.from_arrays(at, self.surfaces.take(pa.array(numbers))), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self.decode(x) for x in ids.to_pylist()], pa.string())

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of token ids: the mark before a text goes, bytes that form no letter become U+FFFD one by one."""
        if ids is None:
            return None
        if not self.control.isdisjoint(ids):  # bytes on both sides of a control piece form no letter together
            runs: list[list[int]] = [[]]
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
            runs = [run for run in runs if run]
        else:
            runs = [ids] if len(ids) else []
        out = "".join(self._text(run) for run in runs)
        marked = self.prefix and out.startswith(" ") and runs[0][0] in self.ordinary
        return out[1:] if marked else out

    def _text(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids]).decode("utf-8", "tidewatch-one-by-one")


def _each(one: Callable) -> Callable[[list], list]:
    return lambda values: [one(v) for v in values]


def encode(text: Column, model: Model | None = None) -> Column:
    """Token ids of each text, encoded whole, as an array; an empty one for null and empty texts."""
    model = model or Model()
    return over_texts(text, "array<int>", pa.list_(pa.int32()), lambda: _each(model.codec().encode))


def decode(ids: Column, model: Model | None = None) -> Column:
    """The text of each array of token ids; null for null. An id that the model doesn't have is an error."""
    model = model or Model()
    return over_texts(ids, "string", pa.string(), lambda: _each(model.codec().decode))


def coded(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, ids, decoded: token ids of each row of docs (doc_id, text), and the text that they give again.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are coded as often as they come; rows
    without an id are kept; there are no ties, since equal scores go from the left; other columns are ignored; an empty
    table gives no rows.
    """
    model = model or Model()

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = model.codec()
        for batch in batches:
            parts = []
            for at in range(0, max(1, len(batch)), PORTION):
                ids = codec.encode_all(batch.slice(at, PORTION).to_pylist())
                columns = [ids, codec.decode_all(ids)]
                parts.append(pa.StructArray.from_arrays(columns, ["ids", "decoded"]))
            yield pa.concat_arrays(parts)

    rows = docs.select("doc_id", both.asNondeterministic()(F.col("text")).alias("code"))
    return rows.select("doc_id", "code.ids", "code.decoded")


def digests(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs; rules as in coded."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
