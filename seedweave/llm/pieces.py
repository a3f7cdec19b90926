"""SentencePiece BPE encoding and decoding by vectorized merge rounds.

A text is cut into words that no piece of the vocabulary can span, so merges
inside a word never depend on its neighbours.  The distinct words of a batch
are encoded together: their symbols lie in one flat numpy array, a segmented
minimum finds each word's best pair rank, the leftmost pairs of that rank merge
at once, merged symbols are compacted, and words leave when no pair remains.

Merging several pairs of a word in one round is only done as far as it equals
merging them one at a time: the round of a word ends at the first merge that
gives rise to a pair of the same or a better rank.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NONE = np.iinfo(np.int64).max
# Words kept encoded per Python worker, and the longest word that is kept.
CACHE_WORDS, CACHE_LENGTH = 150_000, 64
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_LONE = re.compile("[\udc80-\udcff]")
# Fixed value: how the library shows the unknown piece.
UNKNOWN = " \u2047 "
_FIRST_BYTE = "<0x00>"


class PieceModel:
    """Vocabulary of a model file, as tables: symbols, pair ranks, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(n)]
        self.first_byte = self.pieces.index(_FIRST_BYTE)
        ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        # Characters that only occur inside longer pieces get numbers after the vocabulary.
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbols[c] = n + len(symbols) - len(ids)
        self.n, self.size = n, n + len(symbols) - len(ids) + 1
        self.other = self.size - 1  # any character that no piece has
        self.char_of_symbol = {v: k for k, v in symbols.items() if v >= n}
        chars = {c: symbols[c] for p in ids for c in p}
        self.codes = np.array(sorted(map(ord, chars)), dtype=np.uint32)
        self.code_symbols = np.array([chars[chr(c)] for c in self.codes], dtype=np.int64)
        levels = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in ids.values()}, reverse=True))}
        pairs = [
            (symbols[p[:k]] * self.size + symbols[p[k:]], levels[lib.get_score(i)], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        table = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.ascontiguousarray(table[:, i]) for i in range(3))
        bigrams = {chars[a] * self.size + chars[b] for p in ids for a, b in zip(p, p[1:])}
        self.bigrams = np.array(sorted(bigrams), dtype=np.int64)
        self.texts = [p.replace(SPACE, " ") if plain[i] else "" for i, p in enumerate(self.pieces)]
        for b in range(256):  # bytes beyond ASCII stay apart until they are joined to characters
            self.texts[self.first_byte + b] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.names = [str(i) for i in range(n)]
        self.texts[lib.unk_id()] = UNKNOWN
        self.cache: dict[str, tuple[int, ...]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (lower is better, NONE if no piece) and piece of each pair of symbols."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == keys
        return np.where(known, self.pair_ranks[at], NONE), self.pair_ids[at]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Piece ids of each word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        symbols = np.where(self.codes[at] == codes, self.code_symbols[at], self.other)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # A segment is a stretch of a word all of whose neighbours occur side by side in some piece.
        bigrams = symbols[:-1] * self.size + symbols[1:]
        spot = np.minimum(np.searchsorted(self.bigrams, bigrams), len(self.bigrams) - 1)
        cut = (word[1:] != word[:-1]) | (self.bigrams[spot] != bigrams)
        segment = np.concatenate([[0], np.cumsum(cut)]) if len(symbols) else np.zeros(0, np.int64)
        place = np.arange(len(symbols))
        ids, places = self._merge(symbols, segment, place)
        order = np.argsort(places, kind="stable")
        ids, places = ids[order], places[order]
        bounds = np.searchsorted(word[places], np.arange(len(words) + 1)).tolist()
        flat = ids.tolist()
        for at in np.flatnonzero(ids >= self.n).tolist():
            # Symbols that are no pieces become the bytes of their character.
            flat[at] = tuple(self.first_byte + b for b in chr(int(codes[places[at]])).encode("utf-8"))
        out = []
        for a, b in zip(bounds, bounds[1:]):
            own = tuple(flat[a:b])
            if any(type(i) is tuple for i in own):
                own = tuple(x for i in own for x in (i if type(i) is tuple else (i,)))
            out.append(own)
        return out

    def _merge(self, symbols: np.ndarray, segment: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair of a segment remains, with the places where they begin."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(symbols):
            return symbols, place
        # Rank and piece of the pair that begins at each symbol; only pairs next to a merge change.
        rank, piece = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(segment[1:] == segment[:-1])
        rank[inner], piece[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            start = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            index = np.cumsum(np.concatenate([[0], segment[1:] != segment[:-1]]))
            best = np.minimum.reduceat(rank, start)
            alive = best[index] != NONE
            if not alive.all():
                done.append((symbols[~alive], place[~alive]))
                symbols, segment, place, rank, piece = (x[alive] for x in (symbols, segment, place, rank, piece))
                continue
            chosen = rank == best[index]
            # Of overlapping pairs every other one merges, from the left.
            position = np.arange(len(chosen))
            run = np.maximum.accumulate(np.where(chosen & ~np.concatenate([[False], chosen[:-1]]), position, -1))
            merges = position[chosen & ((position - run) % 2 == 0)]
            merged, limit = piece[merges], best[index[merges]]
            left = np.where(merges > 0, symbols[np.maximum(merges - 1, 0)], self.other)
            touching = np.concatenate([[False], merges[1:] - merges[:-1] == 2])
            left[touching] = merged[:-1][touching[1:]]
            left_ok = (merges > 0) & (segment[np.maximum(merges - 1, 0)] == segment[merges])
            after = np.minimum(merges + 2, len(symbols) - 1)
            right_ok = (merges + 2 < len(symbols)) & (segment[after] == segment[merges])
            new = np.minimum(
                np.where(left_ok, self.ranks(left, merged)[0], NONE), np.where(right_ok, self.ranks(merged, symbols[after])[0], NONE)
            )
            # A merge stays if no merge before it in its segment made such a pair.
            bad = np.cumsum(new <= limit)
            before = np.concatenate([[0], bad[:-1]])
            of = index[merges]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            base = np.repeat(before[first], np.diff(np.append(first, len(of))))
            stays = before == base
            merges, merged = merges[stays], merged[stays]
            symbols = symbols.copy()
            symbols[merges] = merged
            keep = np.ones(len(symbols), dtype=bool)
            keep[merges + 1] = False
            symbols, segment, place, rank, piece = (x[keep] for x in (symbols, segment, place, rank, piece))
            spots = merges - np.arange(len(merges))
            spots = np.unique(np.concatenate([spots, spots[spots > 0] - 1]))
            inner = spots[(spots + 1 < len(symbols)) & (segment[np.minimum(spots + 1, len(symbols) - 1)] == segment[spots])]
            rank[spots] = NONE
            rank[inner], piece[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        done.append((symbols, place))
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the library gives them without begin and end marks."""
        words = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        fresh = list({w for ws in words for w in ws} - self.cache.keys())
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            self.cache.update(zip(part, self.encode_words(part)))
        out = [list(chain.from_iterable(map(self.cache.__getitem__, ws))) for ws in words]
        for w in fresh:
            if len(w) > CACHE_LENGTH:
                del self.cache[w]
        return out

    def show(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of piece ids: bytes join to characters, and the first word's space is taken off."""
        if not ids:
            return ""
        # A control piece shows nothing, but bytes do not join across it.
        parts = [ids] if min(ids) >= self.first_byte else [list(own) for shown, own in groupby(ids, lambda i: self.texts[i] != "") if shown]
        text = "".join(_characters("".join(map(self.texts.__getitem__, own))) for own in parts)
        first = next((self.pieces[i] for i in ids if self.texts[i]), "")
        return text[1:] if first.startswith(SPACE) else text


def _characters(text: str) -> str:
    """The text with its runs of bytes joined to characters; every byte of no valid character is one U+FFFD."""
    if not _LONE.search(text):
        return text
    return _LONE.sub("\ufffd", text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file that every executor has, read once per Python worker."""
    return PieceModel(path)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` columns plus ``ids`` (array of int) and ``decoded`` (text of these ids).

    A null or empty text has no ids and decodes to the empty text.  Rows are
    independent: repeated rows get equal results, and an empty table stays empty.
    """
    schema = docs.drop("ids", "decoded").schema
    out = docs.drop("ids", "decoded").limit(0).selectExpr("*", "cast(null as array<int>) as ids", "cast(null as string) as decoded").schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in _slices(batch, at):
                ids = model.encode([t or "" for t in part.column(at).to_pylist()])
                arrays = [*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, "ids", "decoded"])

    return docs.drop("ids", "decoded").mapInArrow(run, out)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for part in _slices(batch, 1):
                ids = model.encode([t or "" for t in part.column(1).to_pylist()])
                shown = [hashlib.sha256(model.show(x).encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]
                arrays = [part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(shown), pa.array(back)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col("doc_id").cast("bigint"), "text")
    return narrow.mapInArrow(run, "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING")


def _slices(batch: pa.RecordBatch, text_column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` text bytes, one row at least."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
