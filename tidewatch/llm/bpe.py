"""Byte-level BPE with a priority queue of merge ranks over a doubly linked symbol list.

Encoding splits a text at added tokens and then into pieces; a piece's bytes are the first symbols of a doubly linked
list. A heap holds the rank and position of every mergeable pair; the lowest is taken, skipped if the pair there
changed since (a stale entry), else merged, and the new neighbours are pushed. Decoding concatenates the
vocabulary strings. Pieces repeat, so a bounded cache keeps their ids.

The vocabulary file's path is a parameter; its content (of fixed size) is broadcast.

The pieces are those of a byte-level vocabulary: a file with another normalizer or pre-tokenizer is refused.

Edge cases: null and empty texts have no ids and decode to an empty text; a null doc_id stays null; repeated rows
are each encoded; a text of any length is encoded whole, and the heap keeps very long pieces at n log n; of equal ranks the
leftmost pair is merged first; an empty table gives no rows; other columns, also ones whose names differ from doc_id or
text in case only, play no part.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, pick

#: Fixed value: the pieces of a byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE = 200_000


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Cache(dict):
    """Piece to ids, in two generations of bounded size: pieces that come again outlive those seen once. Long pieces are not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: dict, specials: bool = True):
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without a normalizer or a prefix space are supported")
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {}
        for s, i in vocab.items():
            self.strings[i] = s.encode() if s in added else to_bytes(s)
            ids[s] = i
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.first = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        # pairs of ids in one integer, to the merge's rank; the rank to the id it makes
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of[ids[x] << 20 | ids[y]] = rank
            self.made.append(ids[x + y])
        self.added = added if specials else {}
        self.split_added = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces = regex.compile(PIECES).findall
        self.cache = _Cache(self._piece)

    def _piece(self, piece: str) -> tuple[int, ...]:
        symbols = list(map(self.first.__getitem__, piece.encode("utf-8", "surrogatepass")))
        n, rank_of, made = len(symbols), self.rank_of.get, self.made
        heap = []
        for i in range(n - 1):
            if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None:
                heap.append(r << 32 | i)
        if not heap:
            return tuple(symbols)
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            # a rank names one pair: any other pair here, or none, makes the entry stale
            if left < 0 or j >= n or rank_of(left << 20 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = one, _ = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(one << 20 | symbols[k])) is not None:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 20 | one)) is not None:
                heappush(heap, r << 32 | h)
        return tuple([s for s in symbols if s >= 0])

    def _plain(self, text: str, out: array) -> None:
        out.extend(chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))

    def encode(self, text: str | None) -> array:
        out = array("I")
        text = text or ""
        at = 0
        if self.split_added is not None:
            for m in self.split_added.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.added[m[0]])
                at = m.end()
        self._plain(text[at:], out)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str | None = None) -> dict:
    with open(path or default_path(), encoding="utf-8") as f:
        return json.load(f)


def send(spark: SparkSession, path: str | None = None):
    """The vocabulary as a broadcast: about 1.5 MB, whatever the data."""
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_MADE: dict[tuple[int, bool], BPE] = {}


def on_worker(sent, specials: bool = True) -> BPE:
    """The encoder of a broadcast, made once in each Python worker."""
    key = (hash(sent.value), specials)
    if key not in _MADE:
        _MADE[key] = BPE(json.loads(sent.value), specials)
    return _MADE[key]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle."""
    sent = send(docs.sparkSession, path)

    def start():
        bpe = on_worker(sent)

        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            ids = bpe.encode(text)
            yield doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

        return row

    return map_rows(pick(docs, "doc_id", "text"), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids as little-endian unsigned 32-bit integers."""
    sent = send(docs.sparkSession, path)

    def start():
        bpe = on_worker(sent)
        return lambda doc_id, text: [(doc_id, bpe.encode(text).tobytes())]

    return map_rows(pick(docs, "doc_id", "text"), start, "doc_id long, ids binary")
