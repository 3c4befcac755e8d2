"""Token ids of whole texts, with an encoder that remembers the ids of pieces it has seen.

Both kinds of vocabulary that are remembered cut a text into pieces before any merge, and no piece crosses
certain white space: a byte-level vocabulary glues a single space to what follows it and takes a line end by
itself, a word vocabulary drops white space. A column of texts is cut at just these places by Arrow, each
distinct piece goes through the tokenizer once, and the ids are gathered from a table of pieces, which equals
the tokenizer's own result. Texts with other white space are cut with more care, and other vocabularies encode
whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single space between two characters that are no white space.
_GLUE = re.compile(r"(?<=\S) (?=\S)")
#: Two signs of white space side by side (as RE2 spells it), or the mark of a text's first piece.
_CARE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x00"
_FIRST = "\x00"
#: Longer pieces are not remembered.
_LONG = 64
#: Characters of text that are cut and looked up at once, about.
CHUNK = 3_000_000

# Letters below U+0100; an apostrophe may begin an ending that the patterns cut off, so words with one go through the tokenizer whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[!-&(-~{_LETTERS}]*")
_PARTS = {"glued": re.compile(rf"[{_LETTERS}]+|[0-9]+|[^{_LETTERS}0-9]+"), "dropped": re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")}


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b], more = chr(more), more + 1
    return [signs[b] for b in range(256)]


_SIGNS = _byte_signs()
#: Characters below U+0100 as their UTF-8 bytes' signs.
_AS_SIGNS = {i: "".join(_SIGNS[b] for b in chr(i).encode()) for i in range(256)}


def _offsets(a: pa.Array) -> np.ndarray:
    """The offsets of a list or binary array, as they stand in its buffer."""
    wide = pa.types.is_large_list(a.type) or pa.types.is_large_binary(a.type) or pa.types.is_large_string(a.type)
    return np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1]


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian bytes of `dtype` (16 bits where the vocabulary fits)."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # in a text, their strings are text
        self.model = self.tok.model
        narrow = self.tok.get_vocab_size(True) <= 1 << 16
        self.dtype, self.code, self.most = np.dtype("<u2" if narrow else "<u4"), "H" if narrow else "I", most
        spec = json.loads(self.tok.to_str())
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        glued = norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        # here the pattern matches words only, and what it does not match is removed
        dropped = [x.get("behavior") == "Removed" and x.get("invert") for x in pre.get("pretokenizers", []) if x["type"] == "Split"]
        lower = [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.kind = "glued" if glued else "dropped" if dropped and all(dropped) and lower else "whole"
        # the table of pieces: their strings, their ids, and the number of the chunk that used each last
        self.keys, self.ids, self.used, self.chunk = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> pa.Array:
        """Ids of pieces. Of simple ones, the parts that the pattern makes take their merges directly."""
        tokenize, parts, simple, lower, code = self.model.tokenize, _PARTS[self.kind].findall, _SIMPLE.fullmatch, self.kind == "dropped", self.code
        space = "" if lower else _SIGNS[32]
        line = b"" if lower else array(code, self._whole(["\n"])[0]).tobytes()  # a line end between two signs is a piece by itself
        known: dict[str, bytes] = {"": b""}
        out: list[bytes] = []
        rest: list[tuple[int, str]] = []
        for p in pieces:
            if p.isalpha() and p.isascii():  # a word, as most are
                s = space + p
                ids = known.get(s)
                if ids is None:
                    ids = known[s] = array(code, [t.id for t in tokenize(s)]).tobytes()
                out.append(ids)
                continue
            lead, ids = space, b""
            if not lower and p[:1] in ("\n", _FIRST):
                lead, ids, p = "", line if p[0] == "\n" else b"", p[1:]
            if simple(p):
                for w in parts(p.lower() if lower else p) or ("",):
                    s = lead + (w if w.isascii() else w.translate(_AS_SIGNS))
                    got = known.get(s)
                    if got is None:
                        got = known[s] = array(code, [t.id for t in tokenize(s)]).tobytes()
                    ids, lead = ids + got, ""
            else:
                rest.append((len(out), " " + p if lead else p))
            out.append(ids)
        for (i, _), ids in zip(rest, self._whole([p for _, p in rest])):
            out[i] += array(code, ids).tobytes()
        return pa.array(out, pa.large_binary())

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, one after another, and where each text's begin (one entry more than texts)."""
        if self.kind == "dropped":
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # no cast before: lowering misreads a slice that was cast
        else:
            care = pc.match_substring_regex(texts, _CARE)
            if pc.any(care).as_py():  # in the order of the texts, those with care apart
                n = np.zeros(len(texts), np.int64)
                where = care.to_numpy(zero_copy_only=False)
                hard = [[_FIRST + x[0], *x[1:]] for x in ([t] if _FIRST in t else _GLUE.split(t) for t in texts.filter(care).to_pylist())]
                easy, at = self._cut(texts.filter(pc.invert(care)))
                n[where], n[~where] = [len(x) for x in hard], np.diff(at)
                starts = np.concatenate([[0], np.cumsum(n)])
                both = pa.concat_arrays([easy, pa.array([p for x in hard for p in x], pa.string())])
                place = np.empty(int(starts[-1]), np.int64)
                is_hard = np.repeat(where, n)
                place[~is_hard], place[is_hard] = np.arange(len(easy)), np.arange(len(easy), len(both))
                return both.take(pa.array(place)), starts
            lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(_FIRST, texts.type), texts, pa.scalar("", texts.type)), "\n", " \n"), " ")
        at = _offsets(lists).astype(np.int64)
        return lists.values.slice(at[0], at[-1] - at[0]), at - at[0]

    def _slots(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Each piece's row in a table of ids, and that table (with rows that are not remembered at its end)."""
        self.chunk += 1
        found = pc.index_in(pieces, value_set=self.keys)
        ids = self.ids
        if found.null_count:
            missing = pc.is_null(found)
            unknown = pieces.filter(missing)
            new = unknown.unique()
            learnt = self._learn(new.to_pylist())
            at = found.fill_null(0).to_numpy().astype(np.int64)
            at[missing.to_numpy(zero_copy_only=False)] = len(ids) + pc.index_in(unknown, value_set=new).to_numpy()
            short = pc.less_equal(pc.binary_length(new), _LONG)
            if not pc.all(short).as_py():  # long ones behind
                order = np.argsort(~short.to_numpy(zero_copy_only=False), kind="stable")
                move = np.empty(len(order), np.int64)
                move[order] = np.arange(len(order))
                late = at >= len(ids)
                at[late] = len(ids) + move[at[late] - len(ids)]
                new, learnt = new.take(pa.array(order)), learnt.take(pa.array(order))
            ids = pa.concat_arrays([ids, learnt])
            stay = int(pc.sum(short).as_py())
            self.keys = pa.concat_arrays([self.keys, new.slice(0, stay)])
            self.ids = ids.slice(0, len(self.keys))
            self.used = np.concatenate([self.used, np.zeros(stay, np.int64)])
        else:
            at = found.to_numpy().astype(np.int64)
        self.used[at[at < len(self.used)]] = self.chunk
        return at, ids

    def _forget(self) -> None:
        """Half of the table, what was used longest ago."""
        if len(self.keys) > self.most:
            stay = pa.array(np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2]))
            self.keys, self.ids, self.used = self.keys.take(stay), self.ids.take(stay), self.used[stay.to_numpy()]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.Array:
        """A binary array of the ids of texts without nulls, each with end_id behind it where one is given."""
        end = b"" if end_id is None else np.asarray([end_id], self.dtype).tobytes()
        if self.kind == "whole":
            return pa.array([array(self.code, x).tobytes() + end for x in self._whole(texts.to_pylist())], pa.binary())
        pieces, starts = self._cut(texts)
        at, ids = self._slots(pieces)
        if end:
            at = np.insert(at, starts[1:], len(ids))
            starts = starts + np.arange(len(starts))
            ids = pa.concat_arrays([ids, pa.array([end], pa.large_binary())])
        out = ids.take(pa.array(at))
        cut = _offsets(out)[starts]
        self._forget()
        pa.default_memory_pool().release_unused()
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((cut - cut[0]).astype(np.int32)), out.buffers()[2].slice(int(cut[0]))])


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary."""
    return PieceEncoder(path)


def in_chunks(batches, text: int = 0, most: int = CHUNK):
    """Arrow batches whose text column (null texts become empty) has about `most` bytes: small ones are put together, large ones cut; a longer text has one of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        b = b.set_column(text, b.schema.field(text).with_nullable(False), b.column(text).fill_null(""))
        while b.num_rows:
            length = np.cumsum(pc.binary_length(b.column(text)).to_numpy())
            n = int(np.searchsorted(length, most - size, side="right"))
            if n < b.num_rows and not (n or held):
                n = 1
            if n:
                held.append(b.slice(0, n))
                size += int(length[n - 1])
            b = b.slice(n)
            if b.num_rows or size >= most:
                yield _one(held)
                held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
