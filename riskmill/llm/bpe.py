"""Byte-pair encoding and decoding with a given byte-level vocabulary.

The encoder never simulates merges. All vocabulary tokens that occur in a pre-tokenised piece come from one
Aho-Corasick pass, which leaves the longest token at every position. Reading from the left, the longest token is
tried first; a token may follow its predecessor only if merging would really have left the border between the
two (the pair-compatibility table). Where no token fits, the last one is taken back for a shorter one, and
positions that were proved dead are not visited again, so a piece takes linear time. The outcome is the one
of the merge rules, exactly.

Of a slice of texts, Arrow numbers the words, so that each different one is looked up once, whatever the number of its
occurrences. Pieces of words that are new are encoded together: one automaton pass over all of them, then the same
backtracking in lock step, one NumPy operation for all pieces at a time. Pieces longer than ``TOGETHER`` bytes
would keep the others waiting and go one by one. The ids of all texts are then gathered by the numbers of their words.

Decoding gathers token bytes through an offset table into one flat byte array.

Defined cases: a null text is empty; an empty text has no ids; strings of the added tokens in a text become
their ids; repeated rows are encoded each for itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from riskmill.llm.shared import WordCache, documents, in_slices, kept

# The pre-tokeniser pattern that belongs to byte-level vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")
ODD_SPACE = regex.compile(r" (?!\S)")
#: Arrow's expression finds all texts that ``ODD_SPACE`` finds, and those with a space before any control character.
MAYBE_ODD = r" (?:[\pZ\x00-\x1f\x7f-\xa0]|$)"
MARKS = frozenset(".,!?;:")
#: Bytes of a piece that is encoded together with others; entries of the pair table's direct-mapped part.
TOGETHER, PAIRS = 64, 1 << 20
SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def runs(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of runs one after another, and the place where each run begins (with the end as last place)."""
    places = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(length, out=places[1:])
    return np.arange(places[-1]) + np.repeat(begin - places[:-1], length), places


class OffsetTable:
    """Byte strings by id in one flat array, found through their offsets."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64)

    def gather(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of ``ids`` in a row, and the place where each begins (with the end as last place)."""
        begin = self.offsets[ids]
        at, places = runs(begin, self.offsets[ids + 1] - begin)
        return self.flat[at].tobytes(), places


class Codec:
    """Encoder and decoder of one vocabulary file (JSON of a byte-level merge vocabulary)."""

    def __init__(self, content: bytes, cached: int = 200_000):
        data = json.loads(content)
        model, alphabet = data["model"], byte_alphabet()
        raw = {t: "".join(chr(alphabet[c]) for c in t) for t in model["vocab"]}
        # Tokens are numbered in the order in which the rules make them; ``self.out`` has the public ids.
        order = {chr(b): b for b in range(256)}
        public = {raw[t]: i for t, i in model["vocab"].items()}
        self.parts = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for rule in model["merges"]:
            left, right = (raw[t] for t in (rule if isinstance(rule, list) else rule.split(" ")))
            if left + right in order:
                raise ValueError("two merge rules make the same token")
            pair = (order[left], order[right])
            self.joined[pair] = order[left + right] = len(self.parts)
            self.parts.append(pair)
        self.names = sorted(order, key=order.get)
        self.sizes = [len(n) for n in self.names]
        self.out = [public[t] for t in self.names]
        self.order = order
        # Tokens of one or two bytes are found by their bytes alone, longer ones by the automaton.
        self.finder = ahocorasick.Automaton()
        self.two_bytes = np.repeat(np.arange(256), 256)
        for name, number in order.items():
            if len(name) == 2:
                self.two_bytes[ord(name[0]) << 8 | ord(name[1])] = number
            elif len(name) > 2 and "\xff" not in name:  # 0xFF lies between pieces, and never in UTF-8
                self.finder.add_word(name, (len(name) - 1) << SHIFT | number)
        self.finder.make_automaton()
        self.short = self.two_bytes.tolist()
        # The longest token that is a proper prefix of a token.
        self.shorter = [next((order[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in order), -1)
                        for n in self.names]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        for t in data["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = added
        either = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))
        self.added_split = re.compile(f"({either})") if added else None
        table = [b""] * (max([*model["vocab"].values(), *added.values()]) + 1)
        for t, i in model["vocab"].items():
            table[i] = raw[t].encode("latin-1")
        for t, i in added.items():
            table[i] = t.encode()
        self.bytes_of = OffsetTable(table)
        self.decimals = OffsetTable([b"%d," % i for i in range(len(table))])
        self.findall = regex.compile(PIECES).findall
        self.fits: dict[int, bool] = {}
        self.most_pairs = 2 * cached
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        made = sorted((a << SHIFT | b, n) for (a, b), n in self.joined.items())
        # With a last key that no pair has, so that a search always ends inside.
        self.joined_keys = np.array([k for k, _ in made] + [1 << 62], np.int64)
        self.joined_numbers = np.array([n for _, n in made] + [len(self.parts)], np.int64)
        self.part_arrays = np.array(self.parts, np.int64).T.copy()
        self.size_array, self.shorter_array = np.array(self.sizes, np.int64), np.array(self.shorter, np.int64)
        self.out_array = np.array(self.out, "<u4")
        self.pieces = WordCache(self._piece, cached // 4)
        self.words = WordCache(self._word, 2 * cached)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between two neighbouring tokens.

        The later made of the two is opened step by step along the border. If any pair of tokens met there
        would have been joined before the token now closed over it was made, the border does not survive.
        """
        bound = len(self.parts)
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < bound:
                return False
            if left < 256 and right < 256:
                return True
            if right < 256 or (left > right and left >= 256):
                bound, left = left, self.parts[left][1]
            else:
                # At equal age the left one is joined first, so the right one's rule still counts.
                bound, right = right + 1, self.parts[right][0]

    def _compatible_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_compatible`` of many pairs in lock step."""
        fit, own = np.ones(len(left), bool), np.arange(len(left))
        bound = np.full(len(left), len(self.parts))
        first, second = self.part_arrays
        while len(own):
            key = left << SHIFT | right
            at = np.searchsorted(self.joined_keys, key)
            joined = (self.joined_keys[at] == key) & (self.joined_numbers[at] < bound)
            fit[own[joined]] = False
            on = ~joined & ((left >= 256) | (right >= 256))
            own, left, right = own[on], left[on], right[on]
            open_left = (right < 256) | ((left > right) & (left >= 256))
            bound = np.where(open_left, left, right + 1)
            left, right = np.where(open_left, second[left], left), np.where(open_left, right, first[right])
        return fit

    def _fits_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pair compatibility through the table; pairs that it doesn't hold are worked out and stored."""
        key = left << SHIFT | right
        at = (key * 0x9E3779B1 >> 7) & (PAIRS - 1)
        fit, unknown = self.pair_fits[at], np.flatnonzero(self.pair_keys[at] != key)
        if len(unknown):
            new, where = np.unique(key[unknown], return_inverse=True)
            found = self._compatible_all(new >> SHIFT, new & ((1 << SHIFT) - 1))
            fit[unknown] = found[where]
            # One at a time per place: of keys that share one, the last is held with its own answer.
            place = (new * 0x9E3779B1 >> 7) & (PAIRS - 1)
            _, last = np.unique(place[::-1], return_index=True)
            last = len(new) - 1 - last
            self.pair_keys[place[last]], self.pair_fits[place[last]] = new[last], found[last]
        return fit

    def _together(self, pieces: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of pieces of at most ``TOGETHER`` bytes, all worked on side by side: the ids of all in a row, and the
        byte where each piece's begin (with the end as last one).

        Positions are those in the joined pieces, with one place between two of them. ``chosen`` holds the token taken at
        a position, ``back`` where the token that ends at a position began.
        """
        if not pieces:
            return b"", np.zeros(1, np.int64)
        # This lone surrogate becomes the byte 0xFF, which no UTF-8 has.
        joined = "\udcff".join(pieces).encode("utf-8", "surrogateescape")
        data = np.frombuffer(joined, np.uint8).astype(np.int64)
        border = data == 0xFF
        end = np.append(np.flatnonzero(border), len(joined))
        begin = np.append(0, end[:-1] + 1)
        longest = data.copy()
        inner = np.flatnonzero(~(border[:-1] | border[1:]))
        longest[inner] = self.two_bytes[data[inner] << 8 | data[inner + 1]]
        found = np.fromiter(chain.from_iterable(self.finder.iter(joined.decode("latin-1"))), np.int64).reshape(-1, 2)
        # Ends ascend, so the longest of a start comes last, and the last one counts.
        longest[found[:, 0] - (found[:, 1] >> SHIFT)] = found[:, 1] & ((1 << SHIFT) - 1)
        places = len(joined) + 1
        alive, chosen, back = np.ones(places, bool), np.zeros(places, np.int64), np.zeros(places, np.int64)
        own, at, before = np.arange(len(pieces)), begin.copy(), np.full(len(pieces), -1)
        token = longest[at]
        while len(own):
            to = at + self.size_array[token]
            fit = alive[to]
            asked = np.flatnonzero(fit & (before >= 0))
            fit[asked] = self._fits_all(before[asked], token[asked])
            # Taken: on to the longest token at its end.
            taken = np.flatnonzero(fit)
            chosen[at[taken]], back[to[taken]] = token[taken], at[taken]
            before[taken], at[taken] = token[taken], to[taken]
            # Not taken: the next shorter one, or the last taken one is taken back for its next shorter one.
            left = np.flatnonzero(~fit)
            token[left] = self.shorter_array[token[left]]
            ended = at[taken] == end[own[taken]]
            on = taken[~ended]
            token[on] = longest[at[on]]
            stuck = left[token[left] < 0]
            while len(stuck):
                alive[at[stuck]] = False
                at[stuck] = last = back[at[stuck]]
                token[stuck] = self.shorter_array[chosen[last]]
                before[stuck] = np.where(last == begin[own[stuck]], -1, chosen[back[last]])
                stuck = stuck[token[stuck] < 0]
            if ended.any():
                rest = np.ones(len(own), bool)
                rest[taken[ended]] = False
                own, at, before, token = own[rest], at[rest], before[rest], token[rest]
        starts, at, first = np.zeros(places, bool), end, begin
        while len(at):
            at = back[at]
            starts[at] = True
            more = at != first
            at, first = at[more], first[more]
        before = np.concatenate([[0], np.cumsum(starts)])
        return self.out_array[chosen[starts]].tobytes(), 4 * before[np.append(begin, end[-1])]

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-tokenised piece, as little-endian 32-bit numbers."""
        name = piece.encode().decode("latin-1")
        whole = self.order.get(name)
        if whole is not None:
            return self.out[whole].to_bytes(4, "little")
        data = piece.encode()
        longest = [self.short[a << 8 | b] for a, b in zip(data, data[1:], strict=False)] + [data[-1]]
        for end, match in self.finder.iter(name):  # ends ascend, so the longest of a start comes last
            longest[end - (match >> SHIFT)] = match & ((1 << SHIFT) - 1)
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        size, alive, made, at, before, token = len(data), bytearray(b"\x01") * (len(data) + 1), [], 0, -1, longest[0]
        while at < size:
            while token >= 0:
                end = at + sizes[token]
                if alive[end]:
                    if before < 0:
                        break
                    fit = fits.get(before << SHIFT | token)
                    if fit is None:
                        fit = self._compatible(before, token)
                        if len(fits) >= self.most_pairs:
                            fits.clear()
                        fits[before << SHIFT | token] = fit
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                made.append(token)
                at, before = end, token
                token = longest[at] if at < size else -1
            else:
                alive[at] = 0
                token = made.pop()
                at -= sizes[token]
                token, before = shorter[token], made[-1] if made else -1
        out = self.out
        return array("I", [out[t] for t in made]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word. The common forms, letters and letters with one mark, need no pattern."""
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[word[-1]]
        return self._pieces(" " + word)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.findall(text)))

    def _plain(self, text: str) -> bytes:
        """Text without added tokens. A piece always begins at a space before a non-space, so text is cut there."""
        if ODD_SPACE.search(text):
            return self._pieces(text)
        head, *words = text.split(" ")
        return self._pieces(head) + b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Public ids, unsigned 32-bit."""
        if self.added_split is None or not any(t in text for t in self.added):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.added_split.split(text)
        return np.frombuffer(b"".join(
            self.added[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts)
        ), "<u4")

    def _ids_of(self, words: list[str], lists: list[list[str]]) -> tuple[list[bytes], list[bytes]]:
        """Ids of different ``words``, each behind a space, and of ``lists`` of pieces; what no slice before has had is
        encoded together."""
        held, known = self.words, self.pieces
        old = held.old
        ids = [*map(held.get, words)]
        new = [i for i, value in enumerate(ids) if value is None]
        batch, simple, counts, others = [], [], [], []
        for i in new:
            word = words[i]
            value = old.get(word)
            if value is not None:
                ids[i] = value
            elif len(word) >= TOGETHER // 4 and (len(word) >= TOGETHER or not word.isascii()):
                others.append(i)
            elif word.isalpha():
                batch.append(" " + word)
                simple.append(i)
                counts.append(1)
            elif word[-1:] in MARKS and word[:-1].isalpha():
                batch += (" " + word[:-1], word[-1])
                simple.append(i)
                counts.append(2)
            else:
                others.append(i)
        lists = [self.findall(" " + words[i]) for i in others] + lists
        pieces = [p for p in set(chain.from_iterable(lists))
                  if p not in known and p not in known.old and len(p.encode()) <= TOGETHER]
        flat, cuts = self._together(batch + pieces)
        ends = cuts[np.cumsum([0, *counts])].tolist()
        for i, a, b in zip(simple, ends, ends[1:], strict=False):
            ids[i] = flat[a:b]
        ends = cuts[len(batch):].tolist()
        fresh = {p: flat[a:b] for p, a, b in zip(pieces, ends, ends[1:], strict=False)}
        known.hold_all(fresh)
        joined = [b"".join([fresh.get(p) or known[p] for p in part]) for part in lists]
        for i, value in zip(others, joined, strict=False):
            ids[i] = value
        held.hold_all({words[i]: ids[i] for i in new if len(words[i]) <= held.longest})
        return ids, joined[len(others):]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of every text. Each different word of the slice is looked up once, then its ids are gathered."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, MAYBE_ODD).to_pylist()
        out: list = [None] * len(texts)
        plain, apart = [], []
        for i, text in enumerate(texts):
            if any(t in text for t in self.added):
                out[i] = self.encode(text)
            else:
                (apart if odd[i] else plain).append(i)
        split = pc.split_pattern(column.take(pa.array(plain, pa.int64())), " ")
        values, starts = split.values, split.offsets.to_numpy()
        head = np.zeros(len(values), bool)
        head[starts[:-1]] = True
        coded = values.filter(pa.array(~head)).dictionary_encode()
        lists = [*values.take(pa.array(starts[:-1])).to_pylist(), *[texts[i] for i in apart]]
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids, more = self._ids_of(words, [self.findall(t) for t in lists])
        # The heads, which have no space before them, are numbered behind the words.
        codes = np.empty(len(values), np.int64)
        codes[~head] = coded.indices.to_numpy()
        codes[head] = len(ids) + np.arange(len(plain))
        ids += more[: len(plain)]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, places = runs((np.cumsum(length) - length)[codes], length[codes])
        gathered = np.frombuffer(b"".join(ids), "<u4")[at]
        ends = places[starts].tolist()
        for i, a, b in zip(plain, ends, ends[1:], strict=False):
            out[i] = gathered[a:b]
        for i, value in zip(apart, more[len(plain):], strict=True):
            out[i] = np.frombuffer(value, "<u4")
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.bytes_of.gather(np.asarray(ids, np.int64))[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, added tokens included; bytes that are no UTF-8 become the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(content: bytes) -> Codec:
    """One codec per worker process, until another operator runs there."""
    return kept(("codec", content), lambda: Codec(content))


def vocabulary(path: str) -> bytes:
    """The vocabulary file's content (about 1.5 MB), read where the job is built and broadcast from there."""
    with open(path, "rb") as f:
        return f.read()


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make(ids, texts):
        rows = codec(content.value).encode_many(texts)
        return {"doc_id": ids, "n_tokens": [len(r) for r in rows], "ids": [r.astype(np.int32) for r in rows]}

    return documents(docs).mapInArrow(in_slices(make, ENCODED), "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    content = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        own = codec(content.value)
        for batch in batches:
            for one in range(batch.num_rows):
                ids = batch.column("ids")[one].values
                text = own.decode(ids.to_numpy() if ids is not None else np.empty(0, np.int64))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [batch.column("doc_id")[one].as_py()], "text": [text]}, schema=schema
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the text decoded from them.

    Encoding and decoding run in the same pass, so that neither ids nor texts are moved.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make(doc_ids, texts):
        own = codec(content.value)
        rows = own.encode_many(texts)
        ids = np.concatenate(rows).astype(np.int64)
        ends = np.cumsum([0, *map(len, rows)])
        decimals, at = own.decimals.gather(ids)
        decoded, to = own.bytes_of.gather(ids)
        return {
            "doc_id": doc_ids, "n_tokens": [len(r) for r in rows],
            "ids_sha256": [hashlib.sha256(decimals[at[a] : max(at[a], at[b] - 1)]).hexdigest()
                           for a, b in zip(ends, ends[1:], strict=False)],
            "decoded_sha256": [
                hashlib.sha256(decoded[to[a] : to[b]].decode("utf-8", "replace").encode()).hexdigest()
                for a, b in zip(ends, ends[1:], strict=False)
            ],
        }

    return documents(docs).mapInArrow(
        in_slices(make, DIGESTS, 1_000_000), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
