"""Whole texts to token ids through the tokenizers library, many texts at a time.

Encoding is the dearest step of a corpus job, and most words recur. A text is
cut where the vocabulary's pre-tokenizer must cut as well (before a single
space, around a single line end, between a letter and a sentence mark), so the
ids of the text are those of its pieces in order. Each distinct piece is encoded
once and remembered. Texts whose white space is not of that plain form, or that
have a letter before a mark which the vocabulary's own normaliser does not leave
a letter, are encoded whole, and so are all texts where the tokenizer file is of
neither form that these cuts hold for.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that may join its neighbour, at an end or beside other white space, or the mark itself.
_IRREGULAR = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARK = "\x00"
#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_BYTES = dict(zip((b for b in range(256) if b not in _PRINTABLE), range(256, 512), strict=False))
_SPACE = chr(_AS_BYTES[0x20])
_MARKS = ".,;:!?"


def _steps(part: dict | None, inner: str) -> list[tuple]:
    """The steps of a normaliser or pre-tokenizer of a tokenizer file: type, and what decides its effect."""
    steps = part[inner] if part and part["type"] == "Sequence" else [part] if part else []
    return [(x["type"], *(json.dumps(x[k]) for k in ("pattern", "content", "behavior", "invert", "add_prefix_space", "use_regex") if k in x)) for x in steps]


def form_of(spec: dict) -> str | None:
    """``bytes`` for byte-level BPE without a normaliser, ``lower`` for lower-cased words without white space, None for any other tokenizer file."""
    model = spec["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or any(c in t["content"] for c in (" ", "\n", *_MARKS)) for t in spec["added_tokens"]):
        return None
    normal, pre = _steps(spec["normalizer"], "normalizers"), _steps(spec["pre_tokenizer"], "pretokenizers")
    if not normal and pre == [("ByteLevel", "false", "true")]:
        return "bytes"
    words = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    lower = [("NFC",), ("Replace", json.dumps({"Regex": r"\s+"}), '" "'), ("Lowercase",)]
    return "lower" if normal == lower and pre == [("Split", json.dumps(words), '"Removed"', "true"), ("ByteLevel", "false", "false")] else None


def letters(tokenizer) -> tuple[str, frozenset[str]]:
    """(letters that a cut from a following mark may change, letters whose normal form is their lower case or themselves), found with the tokenizer itself."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = [c for c, yes in zip(points, pc.match_substring_regex(pa.array(points), r"^\pL$").to_pylist(), strict=True) if yes]
    text = " ".join(c + "." for c in own)
    normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
    begins = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(normal)}
    forms = normal.split(" ")
    odd, plain, at = [], [], 0
    for c, form in zip(own, forms, strict=True):
        if not form.endswith(".") or at + len(form) - 1 not in begins:
            odd.append(c)
        elif form[:-1] in (c, c.lower()) and len(form) == 2 and c < "\U00010000" and c.isalpha() and c not in "\u03a3\u0130":
            plain.append(c)
        at += len(form) + 1
    return "".join(odd), frozenset(plain)


@functools.lru_cache(8)
def rules(path: str) -> tuple[str | None, str, frozenset[str]]:
    """Form of a tokenizer file and its ``letters``: worked out once, on the driver, and sent along with the tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    form = form_of(json.loads(tokenizer.to_str()))
    return form, *(letters(tokenizer) if form else ("", frozenset()))


class PieceEncoder:
    """Encodes Arrow string columns; remembers at most ``most_pieces`` pieces, or those of one slice of texts where they are more."""

    def __init__(self, path: str, most_pieces: int = 500_000, known: tuple | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_pieces = most_pieces
        self.form, odd, self.plain = known or rules(path)
        self.direct = {"bytes": self._as_is, "lower": self._lowered}.get(self.form)
        self.irregular = f"^{_IRREGULAR}|{_IRREGULAR}{_IRREGULAR}|{_IRREGULAR}$|{_MARK}" + (f"|[{odd}][{_MARKS}]" if odd else "")
        self._forget()

    @staticmethod
    def _as_is(piece: str) -> str:
        if piece.isascii():
            return piece.replace(" ", _SPACE)
        return piece.encode().decode("latin-1").translate(_AS_BYTES)

    @staticmethod
    def _lowered(piece: str) -> str:
        if piece.isascii():
            return piece.strip(" ").lower()
        return piece.strip(" ").lower().encode().decode("latin-1").translate(_AS_BYTES)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Pieces that are one word of letters go to the merges directly, without the pre-tokenizer."""
        out: list = [None] * len(pieces)
        rest = []
        tokenize, direct = self.tokenizer.model.tokenize, self.direct
        for i, p in enumerate(pieces):
            word = p[1:] if p[:1] == " " else p
            if direct and word.isalpha() and (word.isascii() or (self.plain.issuperset(word) and unicodedata.is_normalized("NFC", word))):
                out[i] = [t.id for t in tokenize(direct(p))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _make_room(self) -> None:
        """Forget the less used half of the remembered pieces; what stays counts half from then on."""
        n = len(self.place)
        if n < 2:
            return self._forget()
        keep = np.sort(np.argpartition(self.uses[:n], n - n // 2)[n - n // 2 :])
        pieces, count, start, uses = list(self.place), self.count[keep], self.start[keep], self.uses[keep] // 2
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        self.place = {pieces[k]: i for i, k in enumerate(keep.tolist())}
        self.count[: len(keep)], self.start[: len(keep)], self.uses[: len(keep)] = count, ends - count, uses
        self.ids[: len(ids)] = ids
        self.used = len(ids)

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            encoded = self._encode_pieces(some)
            n, total = len(self.place), sum(map(len, encoded))
            while n + len(some) > len(self.start):
                self.start, self.count, self.uses = (np.resize(x, 2 * len(x)) for x in (self.start, self.count, self.uses))
            while self.used + total > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.count[n : n + len(some)] = counts
            self.uses[n : n + len(some)] = 0
            self.start[n : n + len(some)] = self.used + np.cumsum(counts) - counts
            self.ids[self.used : self.used + total] = np.fromiter((i for ids in encoded for i in ids), np.uint32, total)
            self.used += total
            self.place.update(zip(some, range(n, n + len(some)), strict=True))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts of plain form, and how many each has."""
        marked = pc.replace_substring_regex(texts, rf"(\pL)([{_MARKS}])", "\\1\x00\\2")
        marked = pc.replace_substring(marked, " ", _MARK + " ")
        marked = pc.replace_substring(marked, "\n", _MARK + "\n" + _MARK)
        lists = pc.split_pattern(marked, _MARK)
        each = np.diff(np.asarray(lists.offsets))
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        place = self.place
        new = [p for p in pieces if p not in place]
        if len(place) + len(new) > self.most_pieces:
            self._make_room()
            place = self.place
            new = [p for p in pieces if p not in place]
        if new:
            self._learn(new)
        known = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        self.uses[known] += 1
        at = known[np.asarray(coded.indices)]
        count = self.count[at]
        ends = np.cumsum(count)
        take = np.repeat(self.start[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.ids[take]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])]
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array, end_id: int, most_bytes: int = 1 << 21):
        """Yields (first row, ids, n + 1 offsets) for runs of rows; each text's ids end with ``end_id``. Null: empty."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.fill_null("") if texts.null_count else texts
        odd = np.asarray(pc.match_substring_regex(texts, self.irregular).to_numpy(zero_copy_only=False)) if self.form else np.ones(len(texts), bool)
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        from .common import text_slices

        for first, last in text_slices(size, most_bytes):
            rows = texts.slice(first, last - first)
            strange = np.flatnonzero(odd[first:last])
            if len(strange):
                plain = pc.if_else(pa.array(odd[first:last]), "", rows)
            else:
                plain = rows
            ids, count = self._pieces(plain)
            if len(strange):
                runs = np.split(ids, np.cumsum(count)[:-1])
                for i in strange:
                    runs[i] = np.array(self.tokenizer.encode(rows[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
                count = np.array([len(x) for x in runs], np.int64)
                ids = np.concatenate(runs) if runs else ids
            bounds = np.concatenate([[0], np.cumsum(count)])
            ids = np.insert(ids, bounds[1:], np.uint32(end_id)).astype(np.uint32)
            yield first, ids, bounds + np.arange(len(bounds))


def encoder(path: str, known: tuple | None = None) -> PieceEncoder:
    """One encoder for each vocabulary and worker; ``known`` are the driver's ``rules``."""
    from .common import CACHES

    if path not in CACHES:
        CACHES[path] = PieceEncoder(path, known=known)
    return CACHES[path]
