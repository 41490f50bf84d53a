"""BPE encoding and decoding by tree concatenation.

A text is cut into halves, and these again, down to leaves of at most LEAF characters, wherever the cuts fall. What white
space keeps apart is encoded for itself; of a chunk that cuts go through, each leaf has a fragment, encoded as if it stood
alone but for the end of a word that goes on. The leaves of several texts are encoded side by side in one batch. Going up
the tree, two fragments are joined: a window of pre-tokens around the join, growing twofold, is split anew until its first
and last pre-tokens are those that both sides have. If the join lies inside a pre-token, its tokens are joined likewise:
two encodings stand if the pair of tokens at the join is what its own text encodes to, since an encoding is right if and
only if all its neighbouring pairs are; otherwise a window of tokens, growing twofold, is encoded anew until the pairs at
both of its ends agree. A pre-token longer than a leaf is such a tree of its own.

Chunks between white space and fragments come from bounded caches of the library's own results. Texts that need no cut are
encoded by slices: Arrow finds a slice's distinct chunks, whose pre-tokens are merged side by side, a pair of each in a
round, in numpy. Chunks with an apostrophe, a control character or a long pre-token come from the caches. Texts that hold a special
token's string or characters outside a checked range are normalised by the library first, and their chunks split by it.
For a tokenizer of another build the library encodes all but long pre-tokens.

Defined results: a null or empty text has no tokens and decodes to the empty string. Texts of any length are read to
their end. Repeated rows are encoded each; other columns pass through unchanged.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RELEASE, slices, table, tidied

#: Characters of the largest leaf, of a text and of a pre-token.
LEAF, PIECE_LEAF = 512, 1024
#: Chunks between white space kept by a worker; fragments, and pairs and windows of tokens.
CACHE, FEW = 300_000, 50_000
#: Letters with one-character lower case that normalisation leaves alone; ASCII but for rare control characters.
PLAIN = "\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-įı-ňŊ-ž"
OTHER = re.compile(f"[^{PLAIN}]|<\\|")
#: White space of ASCII that the tokenizer and str.split() may see differently; texts with cuts encoded side by side, and characters of those without.
ODD_SPACES, TOGETHER, UNCUT = "\x0b\x0c\x1c\x1d\x1e\x1f", 8, 1 << 22
#: Bytes of a pre-token that is merged beside others; the rank of a pair that has none.
SHORT, NO_RANK = 64, 1 << 30
#: Of the bytes of a chunk in lower case: 0 a letter (all characters but ASCII that are let through), 1 a digit, 2 another, 3 one that the splitter may see differently.
KIND = np.array([3 if b <= 32 or b in (39, 127) else 1 if 48 <= b < 58 else 0 if 97 <= b < 123 or b >= 128 else 2 for b in range(256)], np.uint8)
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-z0-9ß-öø-ž]+")
#: Those letters in the byte-level alphabet, in which printable bytes stand for themselves and the others follow U+0100 in order.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: chr(b) for b in PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
BYTES = "".join(" " if b == 32 else ALPHABET[b] for b in range(256))
#: The normaliser and splitter that PIECE stands for.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def halves(size: int, leaf: int) -> list[int]:
    """Where leaves of at most so many characters begin and end."""
    leaves = 1
    while size / leaves > leaf:
        leaves *= 2
    return [size * i // leaves for i in range(leaves + 1)]


def lettered(text: str) -> str:
    """A text in the byte-level alphabet; spaces stay."""
    return charmap_decode(text.encode(), "strict", BYTES)[0]


class Cut:
    """A chunk that cuts go through, as its fragments."""

    __slots__ = ("fragments",)

    def __init__(self, first: str):
        self.fragments = [first]


class Merges:
    """Encodes many pre-tokens side by side. Pairs of tokens are found in a table by their hash and, if another pair is there, in the next places."""

    #: Places of the table; pre-tokens at a time, so that arrays stay in a core's cache.
    SLOTS, GROUP = 1 << 18, 16384

    def __init__(self, tree: Tree):
        vocab = tree.spec["vocab"]
        letters = [ALPHABET[b] for b in range(256)]
        self.inner, self.last = (np.array([vocab.get(x + end, -1) for x in letters], np.int64) for end in ("", tree.suffix))
        pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in tree.merges], np.int64).reshape(-1, 3)
        self.made = pairs[:, 2]
        self.keys, self.ranks = np.full(self.SLOTS, -1, np.int64), np.full(self.SLOTS, NO_RANK, np.int64)
        keys, at = self.placed(pairs[:, 0], pairs[:, 1])
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.ranks[at[mine]] = left[mine]
            left, keys, at = left[~mine], keys[~mine], (at[~mine] + 1) & (self.SLOTS - 1)

    def placed(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of pairs and the places where the search for them begins."""
        keys = left << 20 | right
        return keys, (keys * 0x9E3779B97F4A7C1 >> 20) & (self.SLOTS - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, at = self.placed(left, right)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NO_RANK)
        on = (there != keys) & (there >= 0)
        other = np.flatnonzero(on)
        while len(other):
            at, keys = (at[on] + 1) & (self.SLOTS - 1), keys[on]
            there = self.keys[at]
            mine = there == keys
            out[other[mine]] = self.ranks[at[mine]]
            on = ~mine & (there >= 0)
            other = other[on]
        return out

    def encode(self, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places of their first bytes) of pre-tokens, given as the tokens of their bytes and where each begins."""
        ends = np.append(starts[self.GROUP :: self.GROUP], len(tokens))
        out = [self.merged(tokens[a:b], starts[i * self.GROUP : (i + 1) * self.GROUP] - a) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]
        out = np.concatenate(out) if out else np.empty(0, np.int64)
        places = np.flatnonzero(out >= 0)
        return out[places].astype(np.int32), places

    def merged(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each token at the place of its first byte, else -1."""
        out = np.full(len(tokens), -1, np.int64)
        place, sizes = np.arange(len(tokens)), np.diff(starts, append=len(tokens))
        rank = np.full(len(tokens), NO_RANK, np.int64)
        rank[:-1] = self.rank(tokens[:-1], tokens[1:])
        rank[starts + sizes - 1] = NO_RANK
        while True:
            # of equal ranks the first pair is the least
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            goes = least >> 32 < NO_RANK
            on = np.repeat(goes, sizes)
            out[place[~on]] = tokens[~on]
            if not goes.any():
                return out
            at, first, end = least[goes] & 0xFFFFFFFF, starts[goes], (starts + sizes)[goes]
            tokens[at] = self.made[rank[at]]
            on[at + 1] = False
            after = at + 2 < end
            rank[at] = NO_RANK
            rank[at[after]] = self.rank(tokens[at[after]], tokens[at[after] + 2])
            before = at[at > first]
            rank[before - 1] = self.rank(tokens[before - 1], tokens[before])
            tokens, rank, place, sizes = tokens[on], rank[on], place[on], sizes[goes] - 1
            starts = np.cumsum(sizes) - sizes


@dataclass
class Fragment:
    """Pre-tokens and their ids; the last one has no suffix unless the chunk ends with it (`closed`)."""

    texts: list[str]
    ids: list[list[int]]
    closed: bool


class Tree:
    """Encodes one unsplit pre-token, already in the model's alphabet."""

    def __init__(self, spec: dict):
        model = self.spec = spec["model"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.text = {i: t for t, i in model["vocab"].items()}
        self.seen: dict[tuple[str, bool], list[int]] = {}

    @cached_property
    def inner(self):
        from tokenizers import Tokenizer

        return Tokenizer(self.model(False))

    @cached_property
    def final(self):
        from tokenizers import Tokenizer

        return Tokenizer(self.model(True))

    def model(self, last: bool, **more):
        """The merges, with or without the suffix of a last character."""
        from tokenizers import models

        kept = {k: self.spec[k] for k in ("unk_token", "fuse_unk", "byte_fallback") if self.spec.get(k)} | more
        return models.BPE(vocab=self.spec["vocab"], merges=self.merges, **kept, **({"end_of_word_suffix": self.suffix} if last and self.suffix else {}))

    def of(self, ids: list[int]) -> str:
        return "".join(self.text[i] for i in ids).removesuffix(self.suffix) if self.suffix else "".join(self.text[i] for i in ids)

    def direct(self, text: str, last: bool) -> list[int]:
        if len(text) > 64:
            return (self.final if last else self.inner).encode(text, add_special_tokens=False).ids
        found = self.seen.get((text, last))
        if found is None:
            if len(self.seen) >= FEW:
                self.seen.clear()
            found = self.seen[text, last] = (self.final if last else self.inner).encode(text, add_special_tokens=False).ids
        return found

    def agree(self, left: int, right: int, last: bool) -> bool:
        return self.direct(self.of([left]) + self.of([right]), last) == [left, right]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """last: right ends the pre-token, so its last token may hold the suffix."""
        if self.agree(left[-1], right[0], last and len(right) == 1):
            return left + right
        k = 1
        while True:
            head, tail = left[:-k], right[k:]
            window = self.direct(self.of(left[-k:]) + self.of(right[:k]), last and not tail)
            if (not head or self.agree(head[-1], window[0], last and not tail and len(window) == 1)) and (not tail or self.agree(window[-1], tail[0], last and len(tail) == 1)):
                return head + window + tail
            k *= 2

    def close(self, ids: list[int]) -> list[int]:
        """An encoding without the suffix, as that of a whole pre-token."""
        k = 1
        while True:
            head, window = ids[:-k], self.direct(self.of(ids[-k:]), True)
            if not head or self.agree(head[-1], window[0], len(window) == 1):
                return head + window
            k *= 2

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_LEAF:
            return self.direct(text, True)
        cuts = halves(len(text), PIECE_LEAF)
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        level = [e.ids for e in self.inner.encode_batch(parts[:-1], add_special_tokens=False)] + [self.direct(parts[-1], True)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1], i + 2 == len(level)) for i in range(0, len(level), 2)]
        return level[0]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.spec = path, json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        n = self.spec["normalizer"] or {}
        p = self.spec["pre_tokenizer"] or {}
        kinds = [x["type"] for x in n.get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in p.get("pretokenizers", [])]
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and splits == [SPLIT, None]
        self.special = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in self.library.get_vocab(True).items()}
        self.known: dict[str, bytes] = {}  # int32 ids; bytes, unlike tuples, cost the garbage collector nothing
        self.opened: dict[str, list[int]] = {}  # of pre-tokens that go on
        self.joins = 0
        end = self.spec["model"].get("end_of_word_suffix") or ""
        self.table = np.full(max(self.names) + 1, None, object)
        self.table[list(self.names)] = list(self.names.values())
        self.ends = np.array([bool(end) and (t or "").endswith(end) for t in self.table])
        self.plain &= bool(end)
        del self.spec  # the trees and the library have what they need; decoding needs no tree

    @cached_property
    def tree(self) -> Tree:
        return Tree(json.load(open(self.path, encoding="utf-8")))

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.tree)

    @cached_property
    def spaced(self):
        """The merges alone, over pieces between white space, each of which comes once."""
        from tokenizers import Tokenizer, pre_tokenizers

        out = Tokenizer(self.tree.model(True, cache_capacity=0))
        out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return out

    def unsplit(self, text: str) -> list[int]:
        """A text with long pre-tokens: special tokens, then normaliser and splitter, then each pre-token."""
        out: list[int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if self.library.normalizer:
                part = self.library.normalizer.normalize_str(part)
            pieces = [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(part)] if self.library.pre_tokenizer else [part]
            for piece in pieces:
                out += self.tree.encode(piece) if len(piece) > PIECE_LEAF else [t.id for t in self.library.model.tokenize(piece)]
        return out

    def whole(self, text: str) -> np.ndarray:
        """By the library alone, but for long pre-tokens."""
        if re.search(rf"\S{{{PIECE_LEAF // 3},}}", text):
            return np.array(self.unsplit(text), np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens of a normalised chunk."""
        if OTHER.search(chunk):
            return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return PIECE.findall(chunk)

    def learn(self, chunks: list[str]) -> None:
        """Adds unknown chunks, as their pieces' ids. Unknown pieces are encoded many at a time: white space keeps them apart, and each one's last token has the suffix."""
        known = self.known
        if len(known) + 2 * len(chunks) > CACHE:
            known.clear()  # what is learnt now stays, however much it is
        new, mixed = set(), []
        for x in chunks:
            if x.isalpha() and not OTHER.search(x):
                new.add(x)
                continue
            head = x[:-1]
            pieces = (head, x[-1]) if head.isalpha() and not x[-1].isalnum() and not OTHER.search(x) else self.split(x)
            mixed.append((x, pieces))
            new.update(y for y in pieces if y not in known)
        for x in [x for x in new if len(x) > PIECE_LEAF]:
            known[x] = np.array(self.tree.encode(lettered(x)), np.int32).tobytes()
            new.discard(x)
        short = list(new)
        for at in range(0, len(short), 500):
            part = short[at : at + 500]
            ids = np.array(self.spaced.encode_batch_fast([lettered(" ".join(part))], add_special_tokens=False)[0].ids, np.int32)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            flat = ids.tobytes()
            for x, a, b in zip(part, [0, *cuts], cuts, strict=False):
                known[x] = flat[a:b]
        for x, pieces in mixed:
            known[x] = b"".join([known[y] for y in pieces])

    def open(self, pieces: set[str]) -> None:
        """Adds unknown pre-tokens that go on."""
        if len(self.opened) + len(pieces) > FEW:
            self.opened.clear()
        listed = list(pieces)
        for x, e in zip(listed, self.tree.inner.encode_batch_fast(list(map(lettered, listed)), add_special_tokens=False), strict=True):
            self.opened[x] = e.ids

    def piece(self, x: str, closed: bool) -> list[int]:
        if closed:
            if x not in self.known:
                self.learn([x])
            return np.frombuffer(self.known[x], np.int32).tolist()
        if x not in self.opened:
            self.open({x})
        return self.opened[x]

    def join(self, p: Fragment, q: Fragment) -> Fragment:
        self.joins += 1
        k = 1
        while True:
            left, right = p.texts[-k:], q.texts[:k]
            now = self.split("".join(left + right))
            if (k >= len(p.texts) or now[0] == left[0]) and (k >= len(q.texts) or now[-1] == right[-1]):
                break
            k *= 2
        # pieces that stay: those of the left before the one that went on, and those of the right
        a = b = 0
        while a < len(left) - 1 and a < len(now) and now[a] == left[a]:
            a += 1
        while b < len(right) and a + b < len(now) and now[-1 - b] == right[-1 - b]:
            b += 1
        new = now[a : len(now) - b]
        ends = b > 0 or len(q.texts) > k or q.closed
        if a == len(left) - 1 and b == len(right) - 1 and new == [left[-1] + right[0]]:
            ids = [self.tree.join(p.ids[-1], q.ids[0], len(q.texts) > 1 or q.closed)]
        elif a == len(left) - 1 and b == len(right) and new == left[-1:]:
            ids = [self.tree.close(p.ids[-1])]
        else:
            ids = [self.piece(x, i < len(new) - 1 or ends) for i, x in enumerate(new)]
        before, after = len(p.texts) - len(left) + a, len(right) - b
        return Fragment(p.texts[:before] + new + q.texts[after:], p.ids[:before] + ids + q.ids[after:], q.closed)

    def concatenated(self, fragments: list[str]) -> bytes:
        """The ids of a chunk that cuts go through."""
        level, last = [], len(fragments) - 1
        for i, x in enumerate(fragments):
            texts = self.split(x)
            level.append(Fragment(texts, [self.piece(t, j < len(texts) - 1 or i == last) for j, t in enumerate(texts)], i == last))
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return np.array([i for x in level[0].ids for i in x], np.int32).tobytes()

    def slots(self, text: str, space: str | None, leaf: int) -> list:
        """Chunks of a normalised text in order; those that a leaf's ends go through as Cut."""
        if len(text) <= leaf:
            return text.split(space) if space is None else [x for x in text.split(space) if x]
        out: list = []
        cuts, cut = halves(len(text), leaf), None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:  # leaves of a single character
                continue
            words = text[a:b].split(space)
            if space is not None:
                words = [x for x in words if x]
            goes_on = b < len(text) and not (text[b - 1].isspace() or text[b].isspace()) if space is None else b < len(text) and space not in text[b - 1 : b + 1]
            if cut:
                cut.fragments.append(words.pop(0))
                if not words and goes_on:
                    continue
                cut = None
            if goes_on:
                cut = Cut(words.pop())
            out += words
            if cut:
                out.append(cut)
        return out

    def simple(self, text: str) -> bool:
        """Whether lower case is all that normalisation does to a text, and white space of ASCII all that keeps its chunks apart."""
        # of ASCII only what would split chunks is looked for here, the rest in unknown chunks
        return "<|" not in text and (not any(c in text for c in ODD_SPACES) if text.isascii() else not OTHER.search(text))

    def parts(self, text: str, leaf: int) -> list:
        """Slots of a text, and special tokens as their ids."""
        if self.simple(text):
            return self.slots(text.lower(), None, leaf)
        out: list = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.slots(self.library.normalizer.normalize_str(part), " ", leaf)
        return out

    def uncut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of simple texts in lower case: those of each distinct chunk are found once and taken wherever it stands."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        chunks = words.flatten().dictionary_encode()
        listed, n = chunks.dictionary, len(chunks.dictionary)
        begins = np.frombuffer(listed.buffers()[1], np.int32, n + 1, 4 * listed.offset).astype(np.int64)
        content = np.frombuffer(listed.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
        begins -= begins[0]
        kind = KIND[content]
        start = kind == 1
        start[1:] |= kind[1:] != kind[:-1]
        start[begins[:-1][begins[:-1] < len(start)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(start))[: len(starts)] - 1
        tokens = self.merges.inner[content]
        tokens[ends] = self.merges.last[content[ends]]
        odd = (kind == 3) | (tokens < 0)
        odd[starts[ends - starts >= SHORT]] = True
        odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[begins]) > 0
        kept = np.flatnonzero(~np.repeat(odd, np.diff(begins)))
        flat, places = self.merges.encode(tokens[kept], np.flatnonzero(start[kept]))
        of = np.searchsorted(kept[places], begins)
        first, sizes = of[:-1], np.diff(of)
        if odd.any():
            which = np.flatnonzero(odd)
            strange = listed.take(pa.array(which)).to_pylist()
            self.learn([x for x in strange if x not in self.known])
            ids = [np.frombuffer(self.known[x], np.int32) for x in strange]
            sizes[which] = [len(x) for x in ids]
            first[which] = len(flat) + np.cumsum(sizes[which]) - sizes[which]
            flat = np.concatenate([flat, *ids])
        at = chunks.indices.to_numpy()
        counts = sizes[at]
        to = np.concatenate([[0], np.cumsum(counts)])
        out = flat[np.repeat(first[at] - to[:-1], counts) + np.arange(to[-1])]
        return np.split(out, to[words.offsets.to_numpy()[1:-1]])

    def encode_uncut(self, texts: list[str | None], leaf: int, out: list[np.ndarray]) -> list[int]:
        """Fills in the ids of texts that need no cut; the places of the others."""
        others, held, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > leaf or not self.simple(text):
                others.append(i)
                continue
            held.append(i)
            size += len(text)
            if size >= UNCUT:
                for j, ids in zip(held, self.uncut([texts[j].lower() for j in held]), strict=True):
                    out[j] = ids
                held, size = [], 0
        if held:
            for j, ids in zip(held, self.uncut([texts[j].lower() for j in held]), strict=True):
                out[j] = ids
        return others

    def encode_all(self, texts: list[str | None], leaf: int = LEAF) -> list[np.ndarray]:
        """Ids of each text; null is empty. What a few texts have in unknown chunks and fragments is learnt at once."""
        known, out = self.known, [np.empty(0, np.int32)] * len(texts)
        if not self.plain:
            return [self.whole(text) if text else x for text, x in zip(texts, out, strict=True)]
        cut = self.encode_uncut(texts, leaf, out)
        for at in range(0, len(cut), TOGETHER):
            held, missing, going = [], set(), set()
            for i in cut[at : at + TOGETHER]:
                slots = self.parts(texts[i], leaf)
                ids = list(map(known.get, slots))
                places = [j for j, v in enumerate(ids) if v is None]
                for j in places:
                    x = slots[j]
                    if isinstance(x, str):
                        missing.add(x)
                    elif isinstance(x, Cut):
                        for n, fragment in enumerate(x.fragments):
                            pieces = self.split(fragment)
                            if n < len(x.fragments) - 1:
                                going.add(pieces.pop())
                            missing.update(y for y in pieces if y not in known)
                held.append((i, slots, ids, places))
            if missing:
                self.learn(list(missing))
            if going := {x for x in going if x not in self.opened}:
                self.open(going)
            for i, slots, ids, places in held:
                for j in places:
                    x = slots[j]
                    ids[j] = known[x] if isinstance(x, str) else self.concatenated(x.fragments) if isinstance(x, Cut) else np.int32(x).tobytes()
                out[i] = np.frombuffer(b"".join(ids), np.int32)
        return out

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        return self.encode_all([text], leaf)[0]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        if self.library.decoder is None:
            ids = np.asarray(ids, np.int64)
            names = self.table[ids[(ids >= 0) & (ids < len(self.table))]].tolist()
            return " ".join(names if None not in names else [x for x in names if x is not None])
        return self.library.decode(list(ids), skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _added(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [i for i, x in enumerate(batch.schema.names) if x != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], [*(batch.schema.names[i] for i in keep), name])


RELEASE["bpe"] = encoder.cache_clear


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, decoded: str | None = None) -> DataFrame:
    """df with the token ids of a text column, array<int>, and if `decoded` names a column, with their text; columns of these names are replaced."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for whole in batches:
            for b in slices(whole):
                found = tok.encode_all(b.column(text).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                out = _with(b, ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))))
                yield _with(out, decoded, pa.array(list(map(tok.decode, found)), pa.string())) if decoded else out

    schema = _added(df.schema, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(tidied(run, "bpe"), _added(schema, decoded, T.StringType()) if decoded else schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of an id column."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for whole in batches:
            for b in slices(whole):
                yield _with(b, text, pa.array([tok.decode([i for i in x or [] if i is not None]) for x in b.column(ids).to_pylist()], pa.string()))

    return df.mapInArrow(tidied(run, "bpe"), _added(df.schema, text, T.StringType()))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens and decoded text, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, decoded="decoded").drop("text")
    digest = F.sha2(F.array_join("ids", " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
