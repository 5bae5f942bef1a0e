"""Encoding and decoding with a SentencePiece BPE model, in vectorised merge rounds.

Texts are cut into segments that no piece of the model can straddle.  All new
segments of a batch become one flat numpy array of symbols.  A round looks up
the rank of every adjacent pair, takes the minimum rank of each segment
(segmented minimum), merges the leftmost non-overlapping pairs of that rank at
once, and compacts the array; it ends when no segment has a pair left.

A rank is shared by pieces with equal scores, and the library merges one pair
at a time from the left.  Merging several pairs of one round at once gives the
same result only if the new symbol cannot form a pair that is due before or
together with the rest; for all other pieces a round merges the leftmost pair.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.runtime import portions, text_rows, tidy

SPACE = "▁"
#: Encoded segments that a worker remembers; it starts anew when this is full.
CACHE_SEGMENTS = 150_000
NO_RANK = np.int32(2**31 - 1)


class PieceModel:
    """Tables of a BPE model file, and the codec built on them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model's normalisation is not the identity with a dummy prefix")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece has a space mark after another character")
        self.names = [p.piece for p in proto.pieces]
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        # Symbols: the ids of normal pieces, and from len(names) on the characters without a piece.
        self.id_of = {p: i for p, (i, _) in normal.items()}
        self.symbol_of = np.arange(len(self.names), len(self.names) + 0x110000, dtype=np.int32)
        for piece, (i, _) in normal.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        rank = {i: order[s] for i, s in normal.values()}
        keys, merged = [], []
        at_once = np.ones(len(self.names), bool)
        for piece, (i, _) in normal.items():
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                # a part that is no piece can only be a lone character, and lone characters without a piece merge with nothing
                if a is not None and rank[i] <= rank[a]:
                    at_once[a] = False
                if b is not None and rank[i] <= rank[b]:
                    at_once[b] = False
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
                elif (a is None and cut == 1) or (b is None and cut == len(piece) - 1):
                    raise ValueError("a piece has a character without a piece of its own")
        self._build_pairs(np.array(keys, np.int64), np.array(merged, np.int32), np.array([rank[i] for i in merged], np.int32))
        self.at_once = at_once
        self.line_alone = not any("\n" in p for p in normal)
        self.bytes_of = [b"" if t.type in (2, 3) else bytes([int(t.piece[1:-1], 16)]) if t.type == 6 else t.piece.replace(SPACE, " ").encode() for t in proto.pieces]
        self.id_text = [str(i) for i in range(len(self.names))]
        self.unknown_id = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.control = np.array([p.type == 3 for p in proto.pieces])
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.cache: dict[str, tuple[str, bytes]] = {}

    # -- merge rounds -------------------------------------------------------------------------

    def _build_pairs(self, keys: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> None:
        """An open-addressing table of pairs that is read with numpy gathers; slot -1 is empty."""
        bits = max(4, int(8 * len(keys)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        table = np.full(self.slots, -1, np.int32)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while True:
            free = left[table[at[left]] < 0]
            table[at[free]] = free
            left = left[table[at[left]] != left]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (self.slots - 1)
            self.probes += 1
        filled = table >= 0
        self.slot_key, self.slot_piece, self.slot_rank = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32), np.full(self.slots, NO_RANK)
        self.slot_key[filled], self.slot_piece[filled], self.slot_rank[filled] = keys[table[filled]], piece[table[filled]], rank[table[filled]]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols; no rank where ``joined`` is false."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        found = self.slot_key[at]
        for _ in range(self.probes - 1):
            onward = np.flatnonzero((found != key) & (found >= 0))
            if not len(onward):
                break
            at[onward] = (at[onward] + 1) & (self.slots - 1)
            found[onward] = self.slot_key[at[onward]]
        return np.where((found == key) & joined, self.slot_rank[at], NO_RANK), self.slot_piece[at]

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that each symbol forms with the next one."""
        rank, piece = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], piece[:-1] = self._lookup(sym[:-1], sym[1:], word[:-1] == word[1:])
        return rank, piece

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words, in order of words (``word`` ascends)."""
        done_sym, done_word = [], []
        rank, piece = self._pairs(sym, word)
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NO_RANK, length)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, piece, length, least = sym[~over], word[~over], rank[~over], piece[~over], length[least != NO_RANK], least[least != NO_RANK]
                if not len(sym):
                    break
            due = np.flatnonzero(rank == np.repeat(least, length))
            lead = np.r_[True, word[due[1:]] != word[due[:-1]]]
            due = due[lead | self.at_once[piece[due]]]
            # of pairs that overlap in a chain, every second one from the left
            chain = np.r_[True, due[1:] != due[:-1] + 1]
            start = np.maximum.accumulate(np.where(chain, np.arange(len(due)), 0))
            due = due[(np.arange(len(due)) - start) % 2 == 0]
            sym[due] = piece[due]
            keep, fresh = np.ones(len(sym), bool), np.zeros(len(sym), bool)
            keep[due + 1] = False
            fresh[due] = True
            sym, word, rank, piece, fresh = sym[keep], word[keep], rank[keep], piece[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]
            touched = np.flatnonzero(fresh)
            right = np.minimum(touched + 1, len(sym) - 1)
            rank[touched], piece[touched] = self._lookup(sym[touched], sym[right], (word[touched] == word[right]) & (touched < right))
        if not done_sym:
            return sym, word
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _learn(self, segments: list[str]) -> None:
        """Encodes segments that the cache lacks, all in the same rounds."""
        base = len(self.names)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym = self.symbol_of[points]
        word = np.repeat(np.arange(len(segments)), np.fromiter(map(len, segments), np.int64, len(segments)))
        sym, word = self.merge(sym, word)
        cuts = np.searchsorted(word, np.arange(len(segments) + 1)).tolist()
        if (lone := np.flatnonzero(sym >= base)).size:  # byte fallback
            wide = np.array([len(chr(c).encode()) for c in (sym[lone] - base).tolist()])
            times = np.ones(len(sym), np.int64)
            times[lone] = wide
            cuts = np.r_[0, np.cumsum(times)][cuts].tolist()
            at = np.r_[0, np.cumsum(times)][lone]
            flat = np.repeat(sym, times)
            raw = np.frombuffer("".join(map(chr, (sym[lone] - base).tolist())).encode(), np.uint8)
            flat[np.repeat(at - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(len(raw))] = np.array([self.byte_id[b] for b in range(256)], np.int32)[raw]
            sym = flat
        flat, table, text, cache = sym.tolist(), self.bytes_of, self.id_text, self.cache
        for s, a, b in zip(segments, cuts, cuts[1:], strict=False):
            ids = flat[a:b]
            cache[s] = (",".join([text[i] for i in ids]), b"".join([table[i] for i in ids]))

    # -- texts --------------------------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """Parts of the normalised text that no piece straddles; together they are that text."""
        if not text:
            return []
        out: list[str] = []
        lines = (SPACE + text.replace(" ", SPACE)).split("\n") if self.line_alone else [SPACE + text.replace(" ", SPACE)]
        for n, line in enumerate(lines):
            if n:
                out.append("\n")
            head, *rest = line.split(SPACE)
            if head:
                out.append(head)
            if "" in rest:
                run = 0
                for x in rest:
                    run += 1
                    if x:
                        out.append(SPACE * run + x)
                        run = 0
                if run:
                    out.append(SPACE * run)
            else:
                out += [SPACE + x for x in rest]
        return out

    def encoded(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and what they decode to, with the dummy prefix.

        All texts share the merge rounds, so give a batch of them at once.
        Segments hold whole characters, so they can be decoded one by one.
        """
        parts = [self.segments(text) for text in texts]
        missing = set().union(*parts).difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_SEGMENTS:
            self.cache.clear()
            missing = set().union(*parts)
        if missing:
            gc.disable()  # many small tuples and no cycles
            self._learn(list(missing))
            gc.enable()
        found = self.cache
        for own in parts:
            codes = [found[p] for p in own]
            yield ",".join([c[0] for c in codes]), b"".join([c[1] for c in codes])

    def encode(self, text: str) -> list[int]:
        joined = next(self.encoded([text]))[0]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids) -> str:
        """As the library's decode(): pieces joined, byte runs as UTF-8, the dummy prefix dropped."""
        ids = np.asarray(ids, np.int64)
        table, unknown = self.bytes_of, self.unknown_id
        parts = [table[i] for i in ids.tolist()] if not (ids == unknown).any() else [" ⁇ ".encode() if i == unknown else table[i] for i in ids.tolist()]
        shown = np.flatnonzero(~self.control[ids]) if len(ids) else ids
        if len(shown) and not self.is_byte[ids[shown[0]]] and ids[shown[0]] != unknown and parts[shown[0]].startswith(b" "):
            parts[shown[0]] = parts[shown[0]][1:]
        # a stray byte shows as U+FFFD by itself, and never takes a piece beside it along
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            out, run = [], b""
            for i, part in zip([*ids.tolist(), -1], [*parts, b""], strict=True):
                if i >= 0 and self.is_byte[i]:
                    run += part
                    continue
                while run:
                    width = next((n for n in range(1, 5) if _is_char(run[:n])), 0)
                    out.append(run[:width].decode() if width else "�")
                    run = run[width or 1 :]
                out.append(part.decode())
            return "".join(out)


def _is_char(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(maxsize=2)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = True, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded].

    A null or empty text has no ids and decodes to the empty text.  Very long
    texts and very long words are encoded whole.  Repeated rows give repeated
    results, further columns are ignored, an empty table gives an empty one.
    ``model_path`` has to be readable on every executor.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in chain.from_iterable(portions(whole, "text") for whole in batches):
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for joined, decoded in model.encoded(batch.column("text").to_pylist()):
                text = decoded[decoded.startswith(b" ") :]
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
                if keep_ids:
                    all_ids.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
                if keep_text:
                    texts.append(text.decode())
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            cols += [pa.array(all_ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(texts, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(cols, names=[f for f, _ in fields])
        model.cache.clear()  # the worker process lives on

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return text_rows(df, id_col, text_col).mapInArrow(tidy(run), schema)
