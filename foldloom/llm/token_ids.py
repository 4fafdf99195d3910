"""Token ids of many texts with a public tokenizer file, each distinct word tokenized once for a stretch of texts.

Two kinds of files are known by their normaliser and pre-tokenizer, byte-level BPE and lower-case words. Neither joins what
stands on both sides of a space or line feed, nor a letter with punctuation that follows, if the letter is one that the
normaliser leaves a single letter whatever stands beside it: those of Latin alphabets that do so are found at load. So the
ids of a text whose white space is single spaces and line feeds between words are those of its words, and a word's those of
what ends with such a letter and of the punctuation after it. Arrow splits texts and finds the distinct words; only those
reach Python, new ones the tokenizer, many at a time: words of letters alone without its pre-tokenizer, told apart by the tokens
that begin or end a word, others with a mark between them that is a token of its own. Any other text, and
every text of a file of another kind, is tokenized whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered in a generation, of which two are held; longer words aren't kept; new words in one call's text.
GENERATION, LONG, TOGETHER = 250_000, 40, 1000
#: White space that isn't a single space or line feed between two other characters.
ODD_SPACE = "[ \n]{2}|^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The first character after those of Latin alphabets: below it nothing combines.
BEYOND_LATIN = "\u0250"
#: A space in a byte-level vocabulary.
SPACE = "\u0120"
TRAILING = ".,;:!?#$%&*|"
#: The normaliser and pre-tokenizer of the two kinds of files.
BYTES = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class Known:
    """Words and their ids: ``places`` has a word's number, ``at`` and ``n`` where in ``ids`` its own begin and how many they are."""

    def __init__(self, kind: np.dtype):
        self.places: dict[str, int] = {}
        self.ids, self.at, self.n = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's number, -1 where it isn't known."""
        return np.fromiter(map(self.places.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def add(self, words: list[str], ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        self.places.update(zip(words, range(len(self.n), len(self.n) + len(words)), strict=False))
        self.at = np.concatenate([self.at, at + len(self.ids)])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, ids])


class Memory:
    """Words and ids that are forgotten: what wasn't asked for while a generation filled up goes with the one before it."""

    def __init__(self, generation: int, kind: np.dtype):
        self.generation, self.kind = generation, kind
        self.now, self.before = Known(kind), Known(kind)

    def ids(self, words: pa.Array, learned: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct ``words`` begin and how many they are; ``learned`` gives them of words that
        no generation knows."""
        if len(self.now.n) >= self.generation:
            self.now, self.before = Known(self.kind), self.now
        keys = _strings(words)
        row, now = self.now.find(keys), self.now
        at, n = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        here, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        at[here], n[here] = now.at[row[here]], now.n[row[here]]
        asked = [keys[i] for i in new.tolist()]
        row = self.before.find(asked)
        old, row = row >= 0, row[row >= 0]
        own = self.before.n[row]
        kept = self.before.ids[_ranges(self.before.at[row], own)]
        ids, first, size = learned(words.take(pa.array(new[~old])))
        ids = np.concatenate([kept, ids])
        at[new[old]], n[new[old]] = np.cumsum(own) - own, own
        at[new[~old]], n[new[~old]] = first + len(kept), size
        out = np.concatenate([now.ids, ids])
        short = np.fromiter(map(len, asked), dtype=np.int64, count=len(asked)) <= LONG
        if short.all():
            now.add(asked, ids, at[new], n[new])
        else:
            own, size = at[new[short]], n[new[short]]
            now.add([w for w, s in zip(asked, short.tolist(), strict=True) if s], ids[_ranges(own, size)], np.cumsum(size) - size, size)
        at[new] += len(out) - len(ids)
        return out, at, n


class Ids:
    """``spaced``: a word's ids depend on the space before it, and a line feed is a token (byte-level BPE); else white
    space is dropped by the tokenizer. ``whole``: the file is of neither kind. ``kind``: the type of ids in memory."""

    def __init__(self, path: str, generation: int = GENERATION):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer.from_file(path)  # for lower-case Latin letters and ASCII, which no normaliser changes
        self.plain.encode_special_tokens = True
        if self.plain.normalizer is not None:
            self.plain.normalizer = None
        own = json.loads(self.tokenizer.to_str())
        parts = own["normalizer"], own["pre_tokenizer"]
        self.spaced = parts == BYTES
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.memory = Memory(generation, self.kind)
        self.mark = "\n" if self.spaced else "0"
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.whole = parts not in (BYTES, WORDS) or own["model"]["type"] != "BPE" or bool(own["model"].get("dropout")) or len(mark) != 1
        self.mark_id = mark[0] if mark else 0
        form = (lambda c: c) if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str
        latin = [c for c in map(chr, range(ord(BEYOND_LATIN))) if c.isalpha()]
        self.letters = "[" + "".join(c for c in latin if len(form(c)) == 1 and form(c).isalpha()) + "]$"
        # words of letters that no normaliser changes, and the tokens that begin such a word after its space, or else end one
        self.lone = f"^{' ' * self.spaced}[{''.join(c for c in latin if form(c) == c)}]+$"
        vocabulary, suffix = self.tokenizer.get_vocab(), own["model"].get("end_of_word_suffix")
        self.edge = np.zeros(max(vocabulary.values(), default=-1) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(SPACE) if self.spaced else suffix and t.endswith(suffix))]] = True
        self.apart = Tokenizer.from_file(path)  # for such words, which it needn't look into
        self.apart.encode_special_tokens = True
        if self.apart.normalizer is not None:
            self.apart.normalizer = None
        split = pre_tokenizers.Split(" ", "merged_with_next") if self.spaced else pre_tokenizers.WhitespaceSplit()
        self.apart.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encoded(self, texts: list[str], tokenizer) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=self.kind) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, each with its leading space if it has one, where each word's begin, and how many they are."""
        lone = pc.match_substring_regex(words, self.lone).to_numpy(zero_copy_only=False)
        found = self._lone(words.filter(pa.array(lone)))
        if found is None:  # not each of them has its edge
            lone, found = np.zeros(len(words), dtype=bool), self._lone(words.slice(0, 0))
        ids, at, n = found
        texts = _strings(words.filter(pa.array(~lone)))
        known = self._marked(texts)
        raw = [known[t] for t in texts]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // self.kind.itemsize
        begins, sizes = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        begins[lone], sizes[lone] = at, n
        begins[~lone], sizes[~lone] = len(ids) + np.cumsum(size) - size, size
        return np.concatenate([ids, np.frombuffer(b"".join(raw), dtype=self.kind)]), begins, sizes

    def _lone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The same of words of letters alone, which their tokens' edges tell apart."""
        lists = pa.LargeListArray if pa.types.is_large_string(words.type) else pa.ListArray
        calls = pc.binary_join(lists.from_arrays([*range(0, len(words), TOGETHER), len(words)], words), "" if self.spaced else " ")
        ids = np.concatenate([np.zeros(0, self.kind), *self._encoded(calls.to_pylist(), self.apart)])
        edge = np.flatnonzero(self.edge[ids])
        if len(edge) != len(words):
            return None
        if self.spaced:
            return ids, edge, np.diff(edge, append=len(ids))
        n = np.diff(edge, prepend=-1)
        return ids, edge + 1 - n, n

    def _marked(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of words, each with its leading space if it has one."""
        found: dict[str, bytes] = {}
        odd = [t for t in texts if self.mark in t]
        found.update(zip(odd, (x.tobytes() for x in self._encoded(odd, self.tokenizer)), strict=True))
        rest = [t for t in texts if t and self.mark not in t]
        found[""] = b""
        if self.spaced:
            groups = [(False, [t for t in rest if t[:1] == " "]), (False, [t for t in rest if t[:1] != " "])]
        else:
            plain = [max(t) < BEYOND_LATIN and t.lower() == t for t in rest]
            groups = [(True, [t for t, x in zip(rest, plain, strict=True) if x]), (False, [t for t, x in zip(rest, plain, strict=True) if not x])]
        between = self.mark if self.spaced else f" {self.mark} "
        for plain, own in groups:
            calls = [own[i : i + TOGETHER] for i in range(0, len(own), TOGETHER)]
            for group, ids in zip(calls, self._encoded([between.join(g) for g in calls], self.plain if plain else self.tokenizer), strict=True):
                raw, at = ids.tobytes(), 0
                for t, to in zip(group, [*(self.kind.itemsize * np.flatnonzero(ids == self.mark_id)).tolist(), len(raw)], strict=True):
                    found[t] = raw[at:to]
                    at = to + self.kind.itemsize
        return found

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the distinct ``texts``, where each text's begin, and how many they are."""
        own = texts.dictionary_encode()
        ids, at, n = self.memory.ids(own.dictionary, self._learned)
        which = own.indices.to_numpy(zero_copy_only=False)
        return ids, at[which], n[which]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one after another, and how many each has. In a spaced vocabulary words follow a space, unless they
        begin with a line feed."""
        line = pc.starts_with(words, "\n") if self.spaced else pa.array(np.zeros(len(words), dtype=bool))
        if self.spaced:
            space = pc.if_else(pc.equal(words, ""), "", " ")
            words = pc.if_else(line, pc.utf8_slice_codeunits(words, 1), pc.binary_join_element_wise(space, words, ""))
        core = pc.utf8_rtrim(words, TRAILING)
        apart = pc.match_substring_regex(core, self.letters)
        tail = pc.if_else(apart, pc.fill_null(pc.struct_field(pc.extract_regex(words, f"(?P<t>[{TRAILING}]+)$"), "t"), ""), "")
        line = line.to_numpy(zero_copy_only=False)
        a_ids, a_at, a_n = self._ids(pc.if_else(apart, core, words))
        b_ids, b_at, b_n = self._ids(tail)
        size = line + a_n + b_n
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=self.kind)
        out[at[line]] = self.mark_id
        out[_ranges(at + line, a_n)] = a_ids[_ranges(a_at, a_n)]
        out[_ranges(at + line + a_n, b_n)] = b_ids[_ranges(b_at, b_n)]
        return out, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one entry more than texts). Nulls are empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if self.whole:
            each = self._encoded(texts.to_pylist(), self.tokenizer)
            return np.concatenate([np.zeros(0, self.kind), *each]), np.cumsum([0, *map(len, each)]).astype(np.int64)
        if not self.spaced:
            # the tokenizer lowers letters in any case; here it makes more words alike
            parts = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
            ids, sizes = self._joined(parts)
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        # each line begins with a feed, the first with one too many
        parts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", texts.type), plain, pa.scalar("", texts.type)), "\n", " \n"), " ")
        ids, sizes = self._joined(parts)
        first = np.cumsum(sizes) - sizes
        ids = np.delete(ids, first)
        sizes = sizes - 1
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        own = iter(self._encoded(texts.filter(pa.array(odd)).to_pylist(), self.tokenizer))
        split = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        each = [next(own) if o else next(split) for o in odd.tolist()]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64).reshape(n + 1)

    def _joined(self, parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of words, and how many each list has."""
        words = parts.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary)
        which = words.indices.to_numpy(zero_copy_only=False)
        own = size[which]
        total = np.concatenate([[0], np.cumsum(own)])
        offsets = parts.offsets.to_numpy()
        return ids[_ranges((np.cumsum(size) - size)[which], own)], np.diff(total[offsets - offsets[0]])


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, and so on."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


_loaded: dict[str, Ids] = {}


def ids_of(path: str, generation: int = GENERATION) -> Ids:
    """One for each file and worker."""
    if path not in _loaded:
        _loaded[path] = Ids(path, generation)
    return _loaded[path]
