"""BPE encoding and decoding by speculation and verification.

Each distinct piece of text is first cut greedily into the longest vocabulary entries. That guess is the true BPE result
exactly if every adjacent pair of tokens is one that BPE itself would leave apart, so all pairs of a batch are looked up at
once in a table of compatible pairs (a pair's verdict is worked out once and remembered). Only pieces with a failing pair
go through exact merging in rank order.

A null or empty text has no tokens; a very long text is encoded whole, word by word. Of equal pairs in a word the left one merges first. Repeated rows are
encoded each; an empty table gives no rows; extra columns are ignored. Files with settings other than SETTINGS are refused.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

ENCODED = "doc_id long, ids array<int>, decoded string"
#: Distinct words and pairs remembered in a worker.
MOST_WORDS = 900_000
MOST_PAIRS = 2_000_000
#: Letters below this (Latin, Greek, Cyrillic) are letters in every Unicode version.
OLD_LETTERS = "\u0530"
#: Marks special tokens among words; a blank, so no word starts with it.
SPECIAL = " "
#: Stands for the word end while guessing; no byte's letter.
END = "\uffff"
#: What str.split() takes for blanks beyond Unicode's white space.
_NOT_BLANK = re.compile("[\x1c-\x1f]")


#: Settings of a file that this encoder reproduces (fixed values of the format): normaliser, what follows the split, model, decoder.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "bytes": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    "split": ("Removed", True),
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    "decoder": None,
}


class Unsupported(ValueError):
    """A tokenizers file asks for something that this encoder does not do."""


def check(j: dict) -> None:
    steps = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
    asked = {
        "normalizer": j["normalizer"], "bytes": steps[-1] if len(steps) == 2 else steps, "split": (steps[0].get("behavior"), steps[0].get("invert")) if steps else None,
        "model": {k: j["model"].get(k) for k in SETTINGS["model"]}, "decoder": j["decoder"],
    }
    for k, want in SETTINGS.items():
        if asked[k] != want:
            raise Unsupported(f"{k}: {asked[k]}")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in j["added_tokens"]):
        raise Unsupported("added tokens that are stripped, normalised or whole words")


def load(path: str) -> dict:
    """What encoding needs from a tokenizers file: vocabulary, merges, special tokens, pattern, word-end mark. Bounded by the file."""
    with open(path, "rb") as f:
        raw = f.read()
    j = json.loads(raw)
    check(j)
    model = j["model"]
    split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": model["vocab"], "merges": [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]],
        "special": {t["content"]: t["id"] for t in j["added_tokens"]}, "pattern": same_classes(split["pattern"]["Regex"]), "plain": split["pattern"]["Regex"], "end": model["end_of_word_suffix"] or "",
        "odd": odd_letters(), "digest": hashlib.sha256(raw).hexdigest(),
    }


def code_points() -> Iterator[str]:
    """All code points but surrogates, some at a time, so that the driver holds few of them."""
    for first in range(0, 0x110000, 0x2000):
        if not 0xD800 <= first < 0xE000:
            yield "".join(chr(c) for c in range(first, first + 0x2000) if not 0xD800 <= c < 0xE000)


def same_classes(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s adjusted to the characters that the tokenizers library counts among them.

    The two regular-expression libraries follow different Unicode versions, so the newest characters' classes can differ.
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    for name, ours in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        only_mine, only_theirs, shown = set(), set(), ours
        for some in code_points():
            theirs = {c for run, _ in pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(some) for c in run}
            mine = set(regex.findall(ours, some))
            only_mine |= mine - theirs
            only_theirs |= theirs - mine
        for op, odd in (("--", only_mine), ("||", only_theirs)):
            if odd:
                shown = f"[{shown}{op}[{''.join(map(span, ranges(odd)))}]]"
        pattern = pattern.replace(name, shown)
    return pattern


def odd_letters() -> tuple[dict[str, str], dict[str, str]]:
    """(letters that the tokenizers library lower-cases otherwise than Python, with its result; letters that only Python takes apart, with their parts).

    The two follow different Unicode versions. What only the library takes apart is none of today's versions and is refused.
    """
    from tokenizers import normalizers

    lower, apart = {}, {}
    for some in code_points():
        every = [c for c in some if c != "\n"]
        joined = "\n".join(every)
        lower |= {c: x for c, x in zip(every, normalizers.Lowercase().normalize_str(joined).split("\n"), strict=True) if x != c.replace("Σ", "σ").lower()}
        apart |= {c: unicodedata.normalize("NFD", c) for c, x in zip(every, normalizers.NFD().normalize_str(joined).split("\n"), strict=True) if x != unicodedata.normalize("NFD", c)}
    if wrong := [c for c, x in apart.items() if x == c] + [c for c in [*lower, *(x[0] for x in apart.values())] if c < "\u0100"]:
        raise Unsupported(f"letters that Python treats otherwise: {wrong}")
    return lower, apart


def beyond_latin(text: str) -> bool:
    """Whether a text has letters beyond Latin-1, before which none is odd."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def ranges(letters: set[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for c in sorted(map(ord, letters)):
        out[-1:] = [(out[-1][0], c)] if out and out[-1][1] == c - 1 else [*out[-1:], (c, c)]
    return out


def span(r: tuple[int, int]) -> str:
    return f"\\U{r[0]:08X}-\\U{r[1]:08X}"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, spec: dict):
        import regex

        self.vocab, self.end, self.special = spec["vocab"], spec["end"], spec["special"]
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in reversed([*enumerate(spec["merges"])])}
        self.findall, self.find_old = regex.compile(spec["pattern"], regex.V1).findall, regex.compile(spec["plain"]).findall
        lower, apart = spec["odd"]
        self.lower, self.apart = {ord(c): x for c, x in lower.items()}, list(apart.values())
        first = {*lower, *(x[0] for x in self.apart)}
        self.odd = re.compile(f"[{''.join(map(re.escape, sorted(first)))}]" if first else "(?!)")
        self.blank = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = dict(enumerate(byte_letters()))
        self.unit = {t: i for t, i in self.vocab.items() if len(t) == 1}
        marked = lambda t: t[: -len(self.end)] + END if self.end and t.endswith(self.end) and len(t) > len(self.end) else t
        self.entries = {marked(t): i for t, i in self.vocab.items()}
        self.reach: dict[str, int] = {}  # longest entry by its first three letters
        for t in self.entries:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 2), len(t))
        self.size = len(self.names) + 1
        self.words: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.pairs: dict[int, bool] = {}
        self.symbols: dict[int, list[int]] = {}
        self.merged = 0
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.none = len(spec["merges"])
        self.results = np.array([self.vocab[a + b] for a, b in spec["merges"]], np.int64)

    def find(self, word: str) -> list[str]:
        """The pieces of a word without blanks; with letters of old scripts only, any Unicode version gives the same."""
        if max(word) >= OLD_LETTERS:
            return self.findall(word)
        return [word] if word.isalpha() else self.find_old(word)

    def units(self, piece: str) -> list[int]:
        """The single-unit tokens of a piece (those that the vocabulary has)."""
        s = self.spelled(piece)
        return [t for c in s[:-1] if (t := self.unit.get(c)) is not None] + [t for t in [self.vocab.get(s[-1] + self.end)] if t is not None]

    def spelled(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def greedy(self, piece: str) -> list[int]:
        """Longest vocabulary entries from left to right; the word end counts as a letter of its own."""
        s = self.spelled(piece) + END
        n, out, i, get, reach = len(s), [], 0, self.entries.get, self.reach.get
        while i < n:
            for j in range(min(n, i + reach(s[i : i + 3], 2)), i, -1):
                t = get(s[i:j])
                if t is not None and j != n - 1:  # the last letter carries the word end
                    out.append(t)
                    i = j
                    break
            else:  # no entry, not even of one unit: left out, as without an unknown token
                i += 1
        return out

    def exact(self, ids: list[int]) -> list[int]:
        """Merges in rank order, leftmost first."""
        if len(ids) > 64:
            return self.exact_long(ids)
        ids, rank = list(ids), self.rank
        while len(ids) > 1:
            found = [rank[p] for p in zip(ids, ids[1:], strict=False) if p in rank]
            if not found:
                break
            best = min(found)
            i = 0
            while i < len(ids) - 1:
                if rank.get((ids[i], ids[i + 1])) == best:
                    ids[i : i + 2] = [best[1]]
                i += 1
        return ids

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links between neighbours, for very long pieces."""
        import heapq

        ids, n = list(ids), len(ids)
        left, right, rank = [*range(-1, n - 1)], [*range(1, n), -1], self.rank
        heap = [(*rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heap = [(r, i, a, b, t) for r, t, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = t, -1, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (p := (ids[k], ids[right[k]])) in rank:
                    heapq.heappush(heap, (rank[p][0], k, *p, rank[p][1]))
        return [t for t in ids if t >= 0]

    def exact_many(self, words: list[list[int]]) -> list[list[int]]:
        """Exact merging of many words side by side: in each round every word merges its leftmost pair of lowest rank."""
        out: list[list[int]] = [[]] * len(words)
        short = sorted((k for k, w in enumerate(words) if len(w) <= 64), key=lambda k: len(words[k]))
        for k in (k for k, w in enumerate(words) if len(w) > 64):
            out[k] = self.exact_long(words[k])
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            width = max(2, len(words[part[-1]]))
            ids = np.full((len(part), width + 1), -1, np.int64)
            for r, k in enumerate(part):
                ids[r, : len(words[k])] = words[k]
            ranks = self.ranks(ids[:, :-1], ids[:, 1:])
            live = np.arange(len(part))
            columns = np.arange(width)
            while len(live):
                at_best = ranks[live].argmin(axis=1)
                best = ranks[live, at_best]
                going = best < self.none
                live, at_best, best = live[going], at_best[going], best[going]
                if not len(live):
                    break
                ids[live, at_best] = self.results[best]
                move = columns[None, :] + (columns[None, :] > at_best[:, None])  # closes the gap right of the merged token
                ids[live, :-1] = np.take_along_axis(ids[live], move, axis=1)
                ranks[live, :-1] = np.take_along_axis(ranks[live], move[:, :-1], axis=1)
                ranks[live, -1] = self.none
                ranks[live, at_best] = self.ranks(ids[live, at_best], ids[live, at_best + 1])
                inner = at_best > 0
                rows, cols = live[inner], at_best[inner]
                ranks[rows, cols - 1] = self.ranks(ids[rows, cols - 1], ids[rows, cols])
            for r, k in enumerate(part):
                row = ids[r].tolist()
                out[k] = row[: row.index(-1)]
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, elementwise; `none` where the pair does not merge."""
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.key_ranks[i], self.none)

    def base(self, token: int) -> list[int]:
        """The single-unit tokens that a token's text consists of."""
        if token not in self.symbols:
            name = self.names[token]
            stem = name[: -len(self.end)] if self.end and name.endswith(self.end) and len(name) > len(self.end) else name
            units = [*stem[:-1], stem[-1] + name[len(stem) :]]
            self.symbols[token] = [self.vocab[u] for u in units]
        return self.symbols[token]

    def check(self, keys: list[int]) -> None:
        """Remembers for pairs a * size + b, and for single tokens -1 - a, whether BPE leaves them as they are."""
        new = [k for k in keys if k not in self.pairs]
        tokens = [[-1 - k] if k < 0 else [*divmod(k, self.size)] for k in new]
        merged = self.exact_many([[u for t in pair for u in self.base(t)] for pair in tokens])
        self.pairs.update((k, got == pair) for k, got, pair in zip(new, merged, tokens, strict=True))

    def learn(self, pieces: set[str]) -> None:
        """Encodes new pieces: all guesses, then one look-up of all adjacent pairs, then exact merging of what fails."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        new = list(pieces)
        guess = list(map(self.greedy, new))
        lengths = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(new)), lengths)
        inside = owner[:-1] == owner[1:]
        # A guess stands if BPE gives each token for its own text and leaves each adjacent pair apart.
        singles, of_single = np.unique(-1 - flat, return_inverse=True)
        pairs, of_pair = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        self.check([*singles.tolist(), *pairs.tolist()])
        good = lambda keys: np.fromiter(map(self.pairs.__getitem__, keys.tolist()), bool, len(keys))
        failing = np.zeros(len(new), bool)
        failing[owner[~good(singles)[of_single]]] = True
        failing[owner[:-1][inside][~good(pairs)[of_pair]]] = True
        again = np.flatnonzero(failing).tolist()
        for i, g in zip(again, self.exact_many([self.units(new[i]) for i in again]), strict=True):
            guess[i] = g
        self.merged += len(again)
        for p, ids in zip(new, guess, strict=True):
            self.words[p], self.shown[p] = array("i", ids).tobytes(), self.decode(ids)

    def split(self, text: str) -> list[str]:
        """The normalised words of a text; blanks part pieces, so each word can be cut into pieces on its own."""
        odd = beyond_latin(text) and self.odd.search(text)
        if not unicodedata.is_normalized("NFC", text):
            text = self.composed(text, self.apart) if odd else unicodedata.normalize("NFC", text)
        if odd:
            text = text.translate(self.lower)
        low = text.replace("Σ", "σ").lower()  # letter by letter: no word-final sigma
        return [w for w in self.blank.split(low) if w] if _NOT_BLANK.search(low) else low.split()

    def composed(self, text: str, apart: list[str]) -> str:
        """NFC, but for sequences that the library leaves apart."""
        if not apart:
            return unicodedata.normalize("NFC", text)
        return apart[0].join(self.composed(x, apart[1:]) for x in text.split(apart[0]))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(ids, np.int32).tolist() for ids, _ in self.packed(texts)]

    def packed(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as 32-bit integers, decoded text) of each text; both are remembered by word."""
        plans: list[list[str]] = []
        new: set[str] = set()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
            self.shown.clear()
        for t in texts:
            plan: list[str] = []
            for part, special in self.parts(t or ""):
                plan += self.split(part)
                if special is not None:
                    plan.append(special)
            plans.append(plan)
            new.update(plan)
        new = new.difference(self.words)  # goes through the new words and not through all known ones
        cut = {w: self.find(w) for w in new if w[0] != SPECIAL}
        self.learn({p for found in cut.values() for p in found if p not in self.words})  # a piece is a word of one piece
        words, names = self.words, self.shown
        for w in new.difference(words):
            if w[0] == SPECIAL:
                words[w], names[w] = array("i", [self.special[w[1:]]]).tobytes(), w[1:]
            else:
                words[w], names[w] = b"".join(map(words.__getitem__, cut[w])), " ".join(map(names.__getitem__, cut[w]))
        ids, shown = self.words.__getitem__, self.shown.__getitem__
        return [(b"".join(map(ids, plan)), " ".join(filter(None, map(shown, plan)))) for plan in plans]

    def parts(self, text: str):
        """(ordinary text, the special token after it, marked, or None)."""
        last = 0
        for m in self.cut.finditer(text) if self.cut and any(s in text for s in self.special) else ():
            yield text[last : m.start()], SPECIAL + m[0]
            last = m.end()
        yield text[last:], None

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by blanks as they are."""
        return " ".join(map(self.names.__getitem__, ids))


#: One for each file's contents, kept for the worker's life.
_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, the token ids of the whole text, and what decoding those ids gives."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches):
        spec, collected = shared.value, gc.isenabled()
        gc.disable()  # the tables of known words hold very many lists and no cycles; for this task only
        try:
            if spec["digest"] not in _ENCODERS:
                _ENCODERS[spec["digest"]] = Encoder(spec)
            e = _ENCODERS[spec["digest"]]
            for b in batches:
                packed = e.packed(b.column(1).to_pylist())
                ids, decoded = [x for x, _ in packed], [x for _, x in packed]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        finally:
            if collected:
                gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)
