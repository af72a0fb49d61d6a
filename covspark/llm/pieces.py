"""Encoding and decoding with a merge-type piece vocabulary, checked against its own library.

The text becomes the vocabulary's form: a word mark in front, and one for each space. Where a
mark follows another character no piece of the vocabulary can span, so each stretch from there to
the next such place is encoded by itself, and equal stretches once in a worker: adjacent pairs of
symbols wait in an agenda ordered by score, then place; the best pair still standing is merged
and its new neighbours enter. What is left and unknown becomes its UTF-8 bytes.

Each new stretch's ids are compared with the library's in the same Arrow batch, many stretches in
one call, and whole texts are where their end can't be given to the library alone; a difference
fails the job.

Defined results: null and empty texts have no ids and decode to an empty text. A text of any
length is taken whole; a stretch of n characters takes n log n steps. Repeated rows are encoded
alike, and columns beside id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: Stretches that a worker keeps, the first it meets. Stretches compared with the library in one call.
KEPT, AT_ONCE = 500_000, 200


class Vocabulary:
    """Pieces of a merge-type model file, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("the vocabulary has pieces across words")
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary lacks byte pieces")
        self.seen: dict[str, tuple[str, int, str]] = {}

    def merge(self, stretch: str) -> list[int]:
        """Ids of a stretch: the best-scored standing pair is merged until none is left, the leftmost of equals first."""
        ids, scores = self.ids, self.scores
        symbols: list[str | None] = list(stretch)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = stretch[i : i + 2]
            if pair in ids:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = pair + symbols[k]
                if right in ids:
                    heapq.heappush(agenda, (-scores[right], i, k, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                if left in ids:
                    heapq.heappush(agenda, (-scores[left], h, i, left))
        out = []
        for s in symbols:
            if s is None:
                continue
            found = ids.get(s)
            if found is not None:
                out.append(found)
            else:
                out.extend(self.bytes[b] for b in s.encode("utf-8", "replace"))
        return out

    def encode(self, text: str) -> list[int]:
        return [i for s in stretches(text) for i in self.merge(s)] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes gathered into characters, the first mark dropped."""
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(_characters(bytes(raw)))
                raw.clear()
            if i not in self.control:
                parts.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        if raw:
            parts.append(_characters(bytes(raw)))
        text = "".join(parts)
        return text[1:] if text.startswith(" ") else text

    def learn(self, new: list[str]) -> dict[str, tuple[str, int, str]]:
        """Ids as text, their number and the decoded text of new stretches, compared with the library."""
        own = [self.merge(s) for s in new]
        inner = [(s, ids) for s, ids in zip(new, own, strict=True) if s[-1] != MARK]
        for i in range(0, len(inner), AT_ONCE):
            part = inner[i : i + AT_ONCE]
            self._compare("".join([s for s, _ in part]), [x for _, ids in part for x in ids])
        for s, ids in zip(new, own, strict=True):
            if s[-1] == MARK and len(s) > 1:
                self._compare(s, ids)
        return {s: (",".join(map(str, a)), len(a), " " + self.decode(a)) for s, a in zip(new, own, strict=True)}

    def _compare(self, marked: str, ids: list[int]) -> None:
        # the library sets the first mark itself
        theirs = self.library.encode(marked[1:].replace(MARK, " "))
        if theirs != ids:
            raise ValueError(f"ids differ from the library's in {marked[:200]!r}")


def _characters(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that is part of no character becomes one replacement character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def stretches(text: str) -> list[str]:
    return STRETCH.findall(MARK + text.replace(" ", MARK))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and the decoded text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column(1).to_pylist()
                cut = [stretches(t) if t else [] for t in texts]
                parts = [list(map(v.seen.get, c)) for c in cut]
                lacking = [i for i, p in enumerate(parts) if None in p]
                if lacking:
                    new = v.learn(sorted({s for i in lacking for s, p in zip(cut[i], parts[i], strict=True) if p is None}))
                    for i in lacking:
                        parts[i] = [new[s] if p is None else p for s, p in zip(cut[i], parts[i], strict=True)]
                    if len(v.seen) < KEPT:
                        v.seen.update(new)
                n, digest, back, ids, decoded = [], [], [], [], []
                for t, c, found in zip(texts, cut, parts, strict=True):
                    line = ",".join([x[0] for x in found])
                    said = "".join([x[2] for x in found])[1:]
                    if t and c[-1] == MARK:  # a text that ends in one mark, which the library can't see alone
                        if list(map(int, line.split(","))) != v.library.encode(t):
                            raise ValueError("ids differ from the library's for a whole text")
                    n.append(sum([x[1] for x in found]))
                    digest.append(sha256(line.encode()).hexdigest())
                    back.append(sha256(said.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        ids.append(list(map(int, line.split(","))) if line else [])
                        decoded.append(said)
                out = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, schema)
