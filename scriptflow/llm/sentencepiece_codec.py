"""Exact encoding with a merge-type SentencePiece vocabulary by backtracking, and decoding.

A merge-type (BPE) encoding is the only sequence of pieces in which every two neighbours are
compatible: merging the text of both from single characters gives back just these two. The
encoder therefore walks a text from left to right with the longest piece at each place (found
by an Aho-Corasick automaton), takes shorter ones where a piece doesn't fit its left neighbour,
steps back where none fits, and marks places in a bitfield from which no way led on.

Texts are cut at spaces first: no piece holds a space mark after another character, so nothing
merges across such a cut. Runs of space marks have pieces of one shared, lowest score; they are
merged last and from the left, which `_space_run` does.

Null texts count as empty. An empty text has the end id alone. Texts of any length are handled
whole; repeated rows give repeated results; other columns are passed through by `encode`, whatever
their names. There are no ties: an encoding is unique. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel

SPACE = "▁"
#: Segments whose encoding a worker keeps; beyond it the store is emptied, which only costs time.
CACHE_SEGMENTS = 500_000
_MAX_PAIRS = 1_000_000


class PieceCodec:
    """Encoder and decoder for the bytes of a merge-type model with byte fallback."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end_id = sp.eos_id()
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = [0] * 256
        self.ids: dict[str, int] = {}
        self.surface: list[bytes] = [b""] * n
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_id[value], self.surface[i] = i, bytes([value])
            elif sp.is_unknown(i):
                self.surface[i] = " ⁇ ".encode()
            elif not sp.is_control(i) and not sp.is_unused(i):
                self.ids[piece], self.surface[i] = i, piece.replace(SPACE, " ").encode()
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.runs = {len(p): i for p, i in self.ids.items() if not p.strip(SPACE)}
        body = {p: i for p, i in self.ids.items() if p == SPACE or SPACE not in p[1:]}
        if any(c not in body for p in body for c in p):
            raise ValueError("a piece holds a character that is no piece itself")
        self.automaton = ahocorasick.Automaton()
        self.sizes = [len(p) for p in self.pieces]
        for p, i in body.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: The longest piece that is a true prefix of each piece, or -1.
        self.shorter = [-1] * n
        for p, i in body.items():
            self.shorter[i] = next((body[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in body), -1)
        self.body = body
        self.fits: dict[int, bool] = {}
        known = "".join(map(re.escape, {c for p in body for c in p}))
        self.span = re.compile(f"([{known}]+)")
        #: Where no piece goes on from a letter to anything else, a text can be cut after its letters.
        letters, cut = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ""
        letter = re.compile(f"[{letters}]")
        if not any(letter.match(x) and not letter.match(y) for p in body for x, y in zip(p, p[1:], strict=False)):
            cut = f"[^{letters}{SPACE}\n]*[{letters}]+|" if "\n" not in body else f"[^{letters}{SPACE}]*[{letters}]+|"
        if "\n" in body:
            self.segment = re.compile(f"{SPACE}*(?:{cut}[^{SPACE}]+)|{SPACE}+")
        else:  # a line end is bytes: nothing merges with it either
            self.segment = re.compile(f"\n|{SPACE}*(?:{cut}[^{SPACE}\n]+)|{SPACE}+(?=\n|$)")
        self.cache: dict[str, tuple[str, bytes]] = {}

    def remerge(self, text: str) -> list[str]:
        """Merges single characters, best score first and leftmost among equals, while a piece results."""
        parts: list[str | None] = list(text)
        right = list(range(1, len(parts) + 1))
        left = list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, merged = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != merged:
                continue
            parts[i], parts[j] = merged, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of a and b gives a and b again; a may be -1, for none."""
        if len(self.fits) >= _MAX_PAIRS:
            self.fits.clear()
        pair = [self.pieces[i] for i in (a, b) if i >= 0]
        ok = self.fits[a * 65536 + b] = self.remerge("".join(pair)) == pair
        return ok

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text of known characters, without runs of space marks."""
        n, sizes, shorter, fits = len(text), self.sizes, self.shorter, self.fits
        longest = [0] * (n + 1)
        for end, piece in self.automaton.iter(text):  # of the pieces that end here, the longest comes first
            at = end + 1 - sizes[piece]
            if sizes[piece] > sizes[longest[at]] or not longest[at]:
                longest[at] = piece
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, last, trial = 0, -1, longest[0]
        while at < n:
            while trial >= 0:
                if open_at[at + sizes[trial]]:
                    ok = fits.get(last * 65536 + trial)
                    if self.compatible(last, trial) if ok is None else ok:
                        break
                trial = shorter[trial]
            if trial >= 0:
                out.append(trial)
                at += sizes[trial]
                last, trial = trial, longest[at]
            elif last < 0:
                raise ValueError("no sequence of pieces fits")
            else:
                open_at[at] = 0
                trial = shorter[out.pop()]
                at -= sizes[last]
                last = out[-1] if out else -1
        return out

    def _space_run(self, n: int) -> list[int]:
        """n space marks: each merge takes the leftmost pair whose joint length is a piece."""
        most, out = max(self.runs), []
        if n <= 4 * most:
            return [self.ids[p] for p in self.remerge(SPACE * n)]
        while n > 2 * most:
            out.append(self.runs[most])
            n -= most
        return out + [self.ids[p] for p in self.remerge(SPACE * n)]

    def encode_segment(self, text: str) -> list[int]:
        """Ids of space marks and then other characters; either may be missing."""
        rest = text.lstrip(SPACE)
        n = len(text) - len(rest)
        ids: list[int] = []
        for k, part in enumerate(self.span.split(rest)):
            if k % 2:
                first = not ids and n > 0 and k == 1 and rest.startswith(part)
                found = self.backtrack((SPACE if first else "") + part)
                if first:
                    alone = found[0] == self.body[SPACE]
                    ids += self._space_run(n - (not alone)) if n - (not alone) else []
                    found, n = found[alone:], 0
                ids += found
            elif part:
                if n:
                    ids += self._space_run(n)
                    n = 0
                ids += [self.byte_id[b] for b in part.encode()]
        return (self._space_run(n) if n else []) + ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without the end id."""
        if not text:
            return []
        return [i for s in self.segment.findall(SPACE + text.replace(" ", SPACE)) for i in self.encode_segment(s)]

    def decode(self, ids: list[int]) -> str:
        """Joins the pieces' texts, drops the one leading space that encoding adds; broken bytes become U+FFFD."""
        raw = b"".join([self.surface[i] for i in ids])
        first = next((self.pieces[i] for i in ids if self.surface[i]), "")
        return decode_bytes(raw[1:] if first.startswith(SPACE) else raw)

    def parts(self, text: str | None) -> tuple[str, str]:
        """The ids with the end id, in decimal and with single spaces, and the decoded text."""
        if not text:
            return str(self.end_id), ""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        segments = self.segment.findall(SPACE + text.replace(" ", SPACE))
        cache = self.cache
        try:
            found = [cache[s] for s in segments]
        except KeyError:
            if len(cache) + len(segments) > CACHE_SEGMENTS + len(segments) // 2:
                cache.clear()
            for s in segments:
                if s not in cache:
                    ids = self.encode_segment(s)
                    cache[s] = " ".join(map(str, ids)), b"".join([self.surface[i] for i in ids])
            found = [cache[s] for s in segments]
        ids, raw = zip(*found, strict=True)
        return f"{' '.join(ids)} {self.end_id}", decode_bytes(b"".join(raw)[1:])


def decode_bytes(raw: bytes) -> str:
    """UTF-8 in which every byte that is not part of a whole character becomes U+FFFD by itself."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            b = raw[i]
            n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
            try:
                out.append(raw[i : i + n].decode() if n else "�")
                i += n or 1
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


def encode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", ids: bool = True, digests: bool = False) -> DataFrame:
    """Encodes and decodes every text.

    Returns key, n_tokens, then with ids the columns ids (array of int, end id last) and decoded,
    with digests the columns ids_sha256 and decoded_sha256. The model (a file of bounded size) is
    read on the driver and sent along, so that executors need no file of their own.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    out = [docs.schema[key], T.StructField("n_tokens", T.LongType())]
    out += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] * ids
    out += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, columns = [], [[] for _ in range(2 * ids + 2 * digests)]
                for t in part.column(1):
                    line, decoded = codec.parts(t.as_py())
                    counts.append(line.count(" ") + 1)
                    row = ([list(map(int, line.split(" "))), decoded] if ids else []) + ([hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] if digests else [])
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.list_(pa.int32()), pa.string()] * ids + [pa.string(), pa.string()] * digests
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.name for f in out])

    return docs.select(key, docs[text].cast("string").alias("text")).mapInArrow(kernel.releasing(run), T.StructType(out))
