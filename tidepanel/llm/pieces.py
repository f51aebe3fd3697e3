"""Encoding and decoding with a merge-type SentencePiece model by a table of prefixes.

Merges always take the best-scored neighbouring pair, leftmost first.  The pieces that come out
have two properties: the pieces of a prefix of the text end in exactly one possible last
piece, and a row of pieces is what merging gives if and only if every two neighbours alone
merge to just those two.  So a text is read once from left to right: an automaton reports
the pieces that end at each place, the one that is compatible with the last piece of what
lies before it is kept in the table, and the ids are recovered from the end backwards.

Texts are cut into words first, at places no piece reaches across; words that come again are
looked up.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import batches, picked
from tidepanel.llm.wordbpe import Recent, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE = 200_000


class PieceModel:
    """Pieces of a model file and the tables the encoder needs."""

    def __init__(self, path: str, limit: int = CACHE):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(size)]
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.ids = {self.pieces[i]: i for i in range(size) if not special[i]}
        self.score = {i: library.get_score(i) for i in self.ids.values()}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(size) if library.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError(f"{path}: characters without a piece need all 256 byte pieces")
        self._check(path, library)
        self.plain: dict[int, bytes] = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.plain |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.control = frozenset(i for i in range(size) if library.is_control(i))
        if library.unk_id() >= 0:
            self.plain[library.unk_id()] = library.decode([library.unk_id()]).encode()
        self.pairs = Recent(self._compatible, 2 * limit)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [i]:  # a piece that merging never forms cannot be a result
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.words = Recent(self.encode_word, limit)

    def _check(self, path: str, library) -> None:  # noqa: ANN001
        """That the model treats white space as the cuts into words suppose."""
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError(f"{path}: a piece reaches from one word into the next")
        probe = " a  b\nÅ "
        if library.decode(library.encode(probe)) != probe or library.encode("") != []:
            raise ValueError(f"{path}: the model changes texts before it encodes them")

    # ---- merging, for single pieces and pairs only

    def merged(self, text: str) -> list[int]:
        """Ids by merging pair after pair; text of known characters."""
        row = list(text)
        while len(row) > 1:
            best, at = None, -1
            for k in range(len(row) - 1):
                i = self.ids.get(row[k] + row[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            row[at : at + 2] = [row[at] + row[at + 1]]
        return [self.ids.get(p, -1) for p in row]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the two pieces side by side stay as they are."""
        left, right = pair
        return self.merged(self.pieces[left] + self.pieces[right]) == [left, right]

    # ---- encoding

    def encode_word(self, word: str) -> bytes:
        """Packed ids of a word by the prefix table."""
        text = word.replace(" ", SPACE)
        count = len(text)
        last = [-1] * (count + 1)  # id of the last piece of each prefix; -1: no piece ends here
        size = [0] * (count + 1)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        for end, found in self.automaton.iter(text):
            ending[end].append(found)
        pairs = self.pairs
        for end in range(count):
            matches = ending[end]
            for piece, length in matches:
                before = end + 1 - length
                left = last[before]
                if before and left != -2:
                    if left == -1:
                        continue
                    if not pairs[left, piece]:
                        continue
                last[end + 1], size[end + 1] = piece, length
                break
            else:
                if text[end] not in self.ids:
                    last[end + 1], size[end + 1] = -2, 1  # its bytes; nothing merges across it
        out: list[int] = []
        at = count
        while at:
            piece = last[at]
            if piece == -2:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
            else:
                out.append(piece)
            at -= size[at]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids of a whole text; an empty text has none."""
        if not text:
            return b""
        # A space is put before the text, and the model's own sign for a space is one.
        return b"".join(map(self.words.__getitem__, WORD.findall(" " + text.replace(SPACE, " "))))

    def decode(self, ids: memoryview | list[int]) -> str:
        """The text of ids: without the space put before it; broken byte runs become U+FFFD, byte by byte."""
        plain = self.plain
        data = b"".join([plain.get(i, b"") for i in ids])
        if data[:1] == b" " and self._leads(ids):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._repaired(ids)

    def _repaired(self, ids: memoryview | list[int]) -> str:
        """Pieces are whole characters; runs of bytes are decoded for themselves."""
        out: list[str] = []
        run = bytearray()

        def end_run() -> None:
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        del run[:size]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]

        values = {i: b for b, i in self.bytes.items()}
        for i in ids:
            if i in values:
                run.append(values[i])
            else:
                end_run()
                out.append(self.plain.get(i, b"").decode())
        end_run()
        text = "".join(out)
        return text[1:] if self._leads(ids) else text

    def _leads(self, ids: memoryview | list[int]) -> bool:
        """Whether the first piece that is text begins with the space put before it."""
        first = next((i for i in ids if i not in self.control), None)
        return first is not None and self.pieces[first].startswith(SPACE)


#: A word with the spaces before it, or a line end, which is part of no piece.
WORD = re.compile(r"\n| *[^ \n]+| +")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per worker process."""
    return PieceModel(path)


def encoded(documents: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null and empty texts have no ids."""
    return _encoded(documents, id, text, model, digests=False)


def round_trip_digests(documents: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every whole text encoded, and its ids decoded again.

    Null and empty texts have no ids and decode to the empty text.  Rows are encoded one by one: repeated
    rows and ids stay as they are, an empty table gives no rows, other columns are ignored.
    """
    return _encoded(documents, id, text, model, digests=True)


def decoded(tokens: DataFrame, id: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """doc_id, text of arrays of ids; null arrays have a null text."""
    path = tokenizer_path(model)
    given = picked(tokens, doc_id=id, ids=ids)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = piece_model(path)
        for part in parts:
            texts = [None if i is None else model_.decode(i) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return given.mapInArrow(work, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, text string")


def _encoded(documents: DataFrame, id: str, text: str, model: str, digests: bool) -> DataFrame:
    path = tokenizer_path(model)
    given = picked(documents, doc_id=id, text=text)
    given = given.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        model_ = piece_model(path)
        for doc, value in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            ids = memoryview(model_.encode(value)).cast("i")
            if digests:
                listed = ",".join(map(str, ids)).encode()
                back = model_.decode(ids).encode()
                yield doc, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(back).hexdigest()
            else:
                yield doc, ids.tolist()

    kind = given.schema["doc_id"].dataType.simpleString()
    rest = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32()))]

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from batches(rows(part), pa.schema([("doc_id", part.schema.field("doc_id").type), *rest]))

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return given.mapInArrow(work, f"doc_id {kind}, {fields}")
