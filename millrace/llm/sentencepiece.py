"""SentencePiece encoding and decoding with a streaming Viterbi search."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memo, batches_of, binaries, by_stretch, kept_by_worker

SPACE = "▁"  # what stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the file format


class Pieces:
    """The pieces of a model file, their ids and scores."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.prefix = model.normalizer_spec.add_dummy_prefix
        if model.normalizer_spec.precompiled_charsmap or (
            model.normalizer_spec.remove_extra_whitespaces
        ):
            raise ValueError("only models that leave texts as they are can be used")
        self.score: dict[str, tuple[float, int]] = {}
        self.of_byte = [0] * 256
        self.text: list[bytes] = []
        for k, piece in enumerate(model.pieces):
            if piece.type in (NORMAL, USER):
                self.score[piece.piece] = (piece.score, k)
                self.text.append(piece.piece.replace(SPACE, " ").encode())
            elif piece.type == BYTE:
                value = int(piece.piece[1:-1], 16)
                self.of_byte[value] = k
                self.text.append(bytes([value]))
            else:
                self.text.append(" ⁇ ".encode() if piece.type == UNKNOWN else b"")
        self.longest = max(map(len, self.score))
        # What a piece can end with; of these, what is no piece itself has a hopeless score.
        ends = {piece[k:] for piece in self.score for k in range(1, len(piece))}
        self.ending = dict.fromkeys(ends, (-np.inf, -1)) | self.score
        self.foreign = min(score for score, _ in self.score.values()) - 10.0
        # Where every segmentation has a boundary: before a space sign that follows another sign,
        # if no piece reaches over such a place; and around a line end, if no piece has one.
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.lines = not any("\n" in p for p in self.score)


class StreamingViterbi:
    """Finds the segmentation with the highest score while the text comes in.

    It holds the boundaries that the next piece can start from, at most ``longest`` of them,
    with their best score and their way back. When the ways back from all of these meet in one
    boundary, the ids before it are final and are given out, and what led to them is forgotten.
    A sign that no piece covers is spelt in bytes, at a score below any piece's. Of equal scores
    the way whose last piece is longest wins.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.start = 0  # the last boundary that is final
        self.text = ""  # signs from there on
        self.best = [0.0]  # the best score at each boundary from there on
        self.back: list[tuple[int, int]] = [(0, -1)]  # from which boundary, by which piece

    def push(self, text: str) -> list[int]:
        """Take more signs; return the ids that are now final."""
        out: list[int] = []
        longest = self.pieces.longest
        for k in range(0, len(text), longest):
            self._extend(text[k : k + longest])
            if len(self.text) >= 2 * longest:
                out += self._commit()
        return out

    def _extend(self, signs: str) -> None:
        """Find the best way to the boundary after each of some signs.

        The last piece is looked for from its end; a stretch that no piece ends with ends the
        search, as longer ones have no such piece either.
        """
        known, foreign, single = self.pieces.ending.get, self.pieces.foreign, self.pieces.score.get
        best, back, done = self.best, self.back, len(self.text)
        text = self.text = self.text + signs
        for end in range(done + 1, len(text) + 1):
            score, piece = single(text[end - 1], (foreign, -1))
            highest, way = best[end - 1] + score, (end - 1, piece)
            for begin in range(end - 2, -1, -1):
                found = known(text[begin:end])
                if found is None:
                    break
                if best[begin] + found[0] >= highest:
                    highest, way = best[begin] + found[0], (begin, found[1])
            best.append(highest)
            back.append(way)

    def finish(self) -> list[int]:
        """The ids of the rest of the text."""
        out = self._ids(len(self.text))
        self.__init__(self.pieces)
        return out

    def change(self, text: str) -> list[int]:
        """The ids of a text in the place of the one that is held, none of which was given out.

        What was found for the beginning that both share depends on nothing after it, and holds.
        """
        shared = 0
        for old, new in zip(self.text, text):
            if old != new:
                break
            shared += 1
        self.text = text[:shared]
        del self.best[shared + 1 :], self.back[shared + 1 :]
        self._extend(text[shared:])
        return self._ids(len(text))

    def _ids(self, end: int) -> list[int]:
        """The ids of the best way to a boundary, from the last to the first."""
        out: list[int] = []
        while end:
            begin, piece = self.back[end]
            if piece < 0:
                spelt = self.text[begin:end].encode()
                out += [self.pieces.of_byte[b] for b in reversed(spelt)]
            else:
                out.append(piece)
            end = begin
        return out[::-1]

    def _commit(self) -> list[int]:
        end = len(self.text)
        survivors = set(range(max(0, end - self.pieces.longest + 1), end + 1))
        while len(survivors) > 1:
            last = max(survivors)
            survivors.remove(last)
            survivors.add(self.back[last][0])
        boundary = survivors.pop()
        if not boundary:
            return []
        out = self._ids(boundary)
        base = self.best[boundary]
        self.text = self.text[boundary:]
        self.best = [x - base for x in self.best[boundary:]]
        self.back = [(0, -1)] + [(b - boundary, p) for b, p in self.back[boundary + 1 :]]
        self.start += boundary
        return out


def segment_ids(pieces: Pieces, text: str) -> list[int]:
    """The ids of a text that begins and ends at a boundary."""
    viterbi = StreamingViterbi(pieces)
    return viterbi.push(text) + viterbi.finish()


def segment_many(pieces: Pieces, texts: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
    """Different texts, each with its ids as by :func:`segment_ids`, in their order as strings.

    So each shares the longest beginning with its neighbour, and only its end is searched.
    """
    viterbi, long = StreamingViterbi(pieces), 2 * pieces.longest
    for text in sorted(texts):
        yield text, viterbi.change(text) if len(text) < long else segment_ids(pieces, text)


def batch_encoder(path: str) -> Callable[[list[bytes | None]], list[np.ndarray]]:
    """A function from texts (UTF-8, null counts as empty) to the ids of each.

    Between two places where every segmentation has a boundary all ways meet, so what is found
    for a stretch of text holds wherever it stands: a worker searches each stretch once.
    """
    pieces = kept_by_worker(f"{path} pieces", lambda: Pieces(path))

    def packed(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def search(stretch: str) -> bytes:
        return packed(segment_ids(pieces, stretch.replace(" ", SPACE)))

    # In stretches and whole texts here a space is a space; in the search it is its sign.
    known = kept_by_worker(f"{path} stretches", lambda: Memo(search, 128 << 20))

    def starts(data: np.ndarray) -> np.ndarray:
        if not pieces.apart:
            return np.zeros(len(data), bool)
        space = data == ord(" ")
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if pieces.lines:
            line = data == ord("\n")
            begins |= line
            begins[1:] |= line[:-1]
        return begins

    def ids_of(stretches: list[str]) -> tuple[np.ndarray, bytes]:
        # Whole texts are not worth keeping.
        found = list(map(known.get if pieces.apart else search, stretches))
        new = {s.replace(" ", SPACE): k for k, s in enumerate(stretches) if found[k] is None}
        for stretch, ids in segment_many(pieces, new):
            k = new[stretch]
            found[k] = packed(ids)
            known.keep(stretches[k], found[k])
        return np.fromiter(map(len, found), np.int64, len(found)) // 4, b"".join(found)

    def prepared(text: bytes | None) -> bytes:
        if not text:
            return b""
        return b" " * pieces.prefix + text.replace(SPACE.encode(), b" ")

    def encode(texts: list[bytes | None]) -> list[np.ndarray]:
        return [x.view(np.int32) for x in by_stretch(list(map(prepared, texts)), starts, ids_of)]

    return encode


def encoder(path: str) -> Callable[[bytes | None], np.ndarray]:
    """A function from a text to its ids, as by :func:`batch_encoder`."""
    encode = batch_encoder(path)
    return lambda text: encode([text])[0]


def decoder(path: str):
    """A function from ids to the text they stand for, as UTF-8; ids out of range are an error."""
    pieces = kept_by_worker(f"{path} pieces", lambda: Pieces(path))
    text = pieces.text

    def decode(ids: np.ndarray) -> bytes:
        out = b"".join([text[i] for i in ids.tolist()])
        return out[1:] if pieces.prefix and out[:1] == b" " else out

    return decode


def encode_documents(
    docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The ids of every whole text by a SentencePiece file: ``doc_id, n_ids, ids, round_trip``.

    The scores of the file's pieces are added up as those of a unigram model. ``round_trip``
    tells whether the ids decode to the text again, which only a text with the space sign
    itself does not. A null text is empty and has no ids; repeated rows and null ids give a row
    each; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = batch_encoder(model), decoder(model)
        for batch in batches_of(batches, "text", 1 << 22):
            texts = binaries(batch.column("text"))
            ids = encode(texts)
            offsets = np.cumsum([0, *map(len, ids)])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            same = [decode(found) == (text or b"") for found, text in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                    pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_ids", "ids", "round_trip"],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, n_ids long, ids array<int>, round_trip boolean"
    )


def decode_documents(
    docs: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """The text that ids stand for: ``doc_id, text``; null ids give a null text.

    Bytes that are no UTF-8 become the replacement sign.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(model)
        for batch in batches:
            texts = [
                None if ids is None else decode(np.array(ids, np.int32)).decode(errors="replace")
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text string")
