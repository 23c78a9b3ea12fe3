"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mark that stands for a space.
MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class PieceModel:
    """The pieces of a model file: what encoding and decoding need, small enough to broadcast (its vocabulary).

    Models whose pieces reach from one word into the next, and byte-pair models that join spaces before words, are refused
    with a ValueError: words couldn't be encoded on their own.
    """

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        self.scores = [sp.get_score(i) for i in range(len(sp))]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(len(sp))]
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not sp.is_byte(i)}
        self.unk = sp.unk_id()
        # A Viterbi over whole scores is for unigram models; byte-pair models score a piece by its rank, all at most 0 and whole.
        self.ranked = all(self.scores[i] == int(self.scores[i]) and self.scores[i] <= 0 for i in self.ids.values())
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that go beyond a word")
        if self.ranked and any(self.scores[i] > -len(self.pieces) for p, i in self.ids.items() if len(p) > 1 and not p.strip(MARK) and p == MARK * 2):
            raise ValueError("the model joins spaces before words")
        self.longest = max(map(len, self.ids))
        self.lowest = min(self.scores) - 10  # of a character without a piece
        self.surface = [b"" if special[i] else bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.surface[self.unk] = " ⁇ ".encode()


def word_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Splits marked text where no piece can reach across: before marks, and between letters and what never joins them.

    ``apart`` are the characters that are no letter and that stand beside none in any piece (punctuation and digits, if the
    model keeps them to themselves); what joins letters (accents, say) counts as letters, and so on along the pieces.
    """
    near: dict[str, set[str]] = {}
    for piece in pieces:
        for a, b in zip(piece, piece[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    near.pop(MARK, None)
    letters = {c for c in near if c.isalpha()}
    new = set(letters)
    while new:
        new = {b for a in new for b in near.get(a, ()) if b != MARK} - letters
        letters |= new
    apart = ({c for p in pieces for c in p} | {chr(i) for i in range(128)}) - letters - {MARK}
    # Characters of the higher planes slow the pattern down; those that stand alone in pieces may go with either side.
    apart = "".join(sorted(re.escape(c) for c in apart if not c.isalpha() and (c < "\U00010000" or c in near)))
    return re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}*[{apart}]+|{MARK}+")


class SharedPrefixViterbi:
    """Encodes distinct words in sorted order, depth first through their trie.

    A node of the trie is a prefix, and its forward state is the best segmentation of that prefix: the last piece
    and where it starts. The next word keeps the states of the prefix it shares with the last one and adds the rest.
    For a unigram model the best is the largest sum of scores, the forward score of the Viterbi. Byte-pair models have no
    such sums: their scores are ranks of merges, and the best sum isn't what merging gives. For them the method is
    adapted: a state is the segmentation that merging makes, the one whose neighbouring pieces all stay apart when merged alone, of which
    each prefix has exactly one, so its last piece follows from the states before it, and no forward score is kept.
    The trie, its order and the reuse of states along common prefixes are the same. A prefix without any such segmentation raises an AssertionError;
    models that merging made have one for each.
    """

    def __init__(self, model: PieceModel, most: int = 120_000) -> None:
        self.model, self.most = model, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.split = word_pattern(model.ids)

    def merged(self, text: str) -> list[str]:
        """The text's pieces by merging the best-ranked neighbours, leftmost first, until none join."""
        ids, scores = self.model.ids, self.model.scores
        parts, after, before = list(text), [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (joined := parts[i] + parts[after[i]]) in ids:
                heapq.heappush(queue, (-scores[ids[joined]], i, after[i], joined))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def stands(self, piece: str) -> bool:
        if (found := self.whole.get(piece)) is None:
            found = self.whole[piece] = len(self.merged(piece)) == 1
        return found

    def stay_apart(self, left: str, right: str) -> bool:
        if (found := self.apart.get((left, right))) is None:
            if len(self.apart) > 2 * self.most:
                self.apart.clear()
            found = self.apart[left, right] = self.merged(left + right) == [left, right]
        return found

    def extend(self, word: str, last: list[str], total: list[float], i: int) -> None:
        """The state of the prefix of length i from those of shorter ones."""
        ids, best, score = self.model.ids, None, 0.0
        if self.model.ranked:
            apart, whole = self.apart, self.whole
            for n in range(1, min(self.model.longest, i) + 1):
                piece = word[i - n : i]
                if n > 1 and (piece not in ids or not (whole[piece] if piece in whole else self.stands(piece))):
                    continue
                if i > n:
                    pair = (last[i - n], piece)
                    if not (apart[pair] if pair in apart else self.stay_apart(*pair)):
                        continue
                best = piece
                break
        else:
            for n in range(1, min(self.model.longest, i) + 1):
                piece = word[i - n : i]
                if n > 1 and piece not in ids:
                    continue
                # Sums in single precision, and of equal ones the longest last piece.
                s = float(np.float32(total[i - n] + (self.model.scores[ids[piece]] if piece in ids else self.model.lowest)))
                if best is None or s >= score:
                    best, score = piece, s
        if best is None:
            raise AssertionError(f"no segmentation ends {word[:i]!r}")
        last.append(best)
        total.append(score)

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.most:
            # Two generations: words that are still in use move up, the others go with the next change.
            self.older, self.known = self.known, {}
            new = words
        if self.older:
            again = new & self.older.keys()
            self.known |= {w: self.older[w] for w in again}
            new = new - again
        # A run of marks before a word: all but the one that belongs to the word.
        trie = sorted({MARK + w.lstrip(MARK) if w[0] == MARK else w for w in new if w.strip(MARK)})
        coded: dict[str, bytes] = {}
        path, last, total, ids = "", [""], [0.0], self.model.ids
        for word in trie:
            n = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], total[n + 1 :]
            for i in range(n + 1, len(word) + 1):
                self.extend(word, last, total, i)
            path, at, parts = word, len(word), []
            while at:
                piece = last[at]
                at -= len(piece)
                if piece in ids:
                    parts.append(ids[piece])
                else:
                    parts += self.numbers(piece)[::-1]
            parts.reverse()
            coded[word] = array("i", parts).tobytes()
        mark = array("i", [ids[MARK]]).tobytes() if MARK in ids else b""
        for w in new:
            core = w.lstrip(MARK)
            marks = len(w) - len(core)
            if core and marks < 2:
                self.known[w] = coded[w]
                continue
            rest = b""
            if core:
                rest = coded[MARK + core]
                marks -= 1
                if mark and rest.startswith(mark):
                    marks, rest = marks + 1, rest[len(mark) :]
            self.known[w] = array("i", [i for p in self.merged(MARK * marks) for i in self.numbers(p)]).tobytes() + rest

    def numbers(self, piece: str) -> list[int]:
        if (i := self.model.ids.get(piece)) is not None:
            return [i]
        if self.model.byte:
            return [self.model.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.model.unk]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, held, size = [], [], 0

        def flush() -> None:
            self.learn(set(chain.from_iterable(held)))
            known = self.known.__getitem__
            out.extend(np.frombuffer(b"".join(map(known, words)), np.int32) for words in held)

        for text in texts:
            words = self.split.findall(MARK + text.replace(" ", MARK)) if text else []
            held.append(words)
            size += len(words)
            if size > 250_000:
                flush()
                held, size = [], 0
        flush()
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.model.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_encoders: dict[int, SharedPrefixViterbi] = {}


def _encoder(data: bytes) -> SharedPrefixViterbi:
    """One for each model and Python worker: it keeps what it has learnt between batches."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = SharedPrefixViterbi(PieceModel(data))
    return _encoders[key]


def read_model(df: DataFrame, path: str) -> bytes:
    """The model file: read on the driver, the only one that needs it, or by Spark if the path names a file system."""
    if "://" in path:
        return bytes(df.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


#: Rows that are encoded and given on together.
SLICE = 500


def _id_lists(texts: list[str | None], found: list[np.ndarray]) -> pa.ListArray:
    """The ids of a slice as one Arrow array, null where the text is."""
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    missing = np.array([t is None for t in texts] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, mask=missing), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))


def encode_pieces(docs: DataFrame, *, model_path: str = DEFAULT_MODEL, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (those in ``keep``, if given) with ``ids`` array<int>, replacing a column of that name.

    The ids equal the model's own. Empty texts have none; null texts have null; equal texts have equal ids, whatever their row or id.
    Columns of any names may be kept; an empty table gives no rows. One pass without a shuffle: slices of each
    Arrow batch encode their distinct marked words once and are given on, so memory does not grow with a batch's ids.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(docs, model_path))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "ids"]
    rows = docs.select(F.col(text).alias("__text"), *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "__text"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(0).to_pylist()
                found = encoder.encode([t or "" for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], _id_lists(texts, found)], names=[*part.schema.names[1:], "ids"])

    return rows.mapInArrow(coded, schema)


def decode_pieces(coded: DataFrame, *, model_path: str = DEFAULT_MODEL, ids: str = "ids") -> DataFrame:
    """All columns with ``decoded``: the text of the ids, null for null. Only U+2581 itself comes back as a space."""
    held = coded.sparkSession.sparkContext.broadcast(read_model(coded, model_path))

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        encoder = _encoder(held.value)
        return pd.Series([None if x is None else encoder.decode(x) for x in rows])

    rest = [F.col(f"`{c}`") for c in coded.columns if c.lower() != "decoded"]
    return coded.withColumn("__decoded", decode(F.col(ids))).select(*rest, F.col("__decoded").alias("decoded"))


def round_trip(docs: DataFrame, *, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its ids, how many, and whether decoding them gives the text back (null texts: null ids, true).

    doc_id stays as it is; repeated rows and null ids give a row each, and other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(docs, model_path))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_tokens long, round_trip boolean, ids array<int>").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                found = encoder.encode([t or "" for t in texts])
                same = [encoder.decode(x) == (t or "") for t, x in zip(texts, found, strict=True)]
                counts = pa.array(np.array([len(x) for x in found], np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(same, pa.bool_()), _id_lists(texts, found)], names=["doc_id", "n_tokens", "round_trip", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, schema)
