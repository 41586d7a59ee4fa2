"""Substring dedup: repeated-phrase automata over words.

A window is `width` consecutive words of one document. The pass has four steps.

1. Documents are dealt into blocks by their id. Each block sends every distinct window's 64-bit hash with the smallest id of the
   block to a shard of the hash space, packed (sorted deltas, compressed). Blocks and shards grow with the table, so the exchange costs some 9.5 bytes a window at 0.5 GB and 10.5 at a terabyte (simulated).
2. A shard confirms which windows recur in other blocks and asks the block of the smallest id (the owner) to show them to the others.
3. The owner's block joins windows that are asked for and follow each other to passages, and sends these word sequences, with the
   owner's id, to the blocks that asked: every block is the shard of all phrases that its documents can contain, and of no others.
4. Each block compiles its passages (those it was sent, and those of its own owners), cut where its texts part, with pyahocorasick; letters of the
   automaton are words. All its documents stream through the automaton, which locates every occurrence. A word is removed if
   an occurrence's window that covers it has an owner with a smaller id.

Hashes only choose who is shown what; a word goes only if the automaton finds the owner's very words. (Of two different windows with equal hashes
one may lack its owner and stay: some 0.0005 such pairs are expected among 140 million windows.) Every document meets one automaton, its size
follows the block and not the corpus. Memory of a task is that of one block with its passages or of one shard; a very frequent passage is one
hash and one passage for a block.

A null text has no words. Repeated rows of one id do not count against each other (no smaller id); texts below `width` words lose
nothing; null ids own nothing and lose nothing, and are not dealt to any block. Very long texts are blocks of their own; there is no limit on
distinct words. An empty table gives no rows. Extra columns are kept by `remove_repeats`; those named like its results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_bytes, mix64, pack, pack_sorted, prepare, raw_words, rolling, unpack, unpack_sorted

WIDTH = 13
#: Bytes of a table from which blocks and shards grow, megabytes of a block at most.
GROWS_FROM, MOST_BLOCK_MB = 0.5e9, 64.0
#: First of the letters that stand for words; two blocks of surrogates are skipped. With more distinct words than letters, words are numbers.
FIRST, SURROGATES, LETTERS = 16, (0xD800, 0xE000), 1_100_000
#: Windows of one phrase at most: longer passages are several phrases, so that the automaton stays shallow.
PHRASE = 256
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
#: Base of the words' polynomial hashes.
BASE = 0xD6E8FEB86659FD93


def plain(text: str | None) -> bytes:
    """The words joined by one blank."""
    return b" ".join(raw_words(text))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words text[begin:end]: polynomials in an odd base, from one running sum, mixed with the lengths."""
    up, down = powers(BASE, len(text)), powers(pow(BASE, -1, 1 << 64), len(text))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


class Block:
    """The words and windows of some documents (given as their words joined by one blank), end to end."""

    def __init__(self, ids: list, texts: list[bytes], width: int):
        self.ids, self.text = np.array(ids, np.int64).reshape(-1), b"\n".join([*texts, b""])
        raw = np.frombuffer(self.text, np.uint8)
        stops = np.flatnonzero((raw == 32) | (raw == 10))  # words hold neither
        begin = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
        real = stops > begin
        of = np.cumsum(raw[stops] == 10) - (raw[stops] == 10)
        self.begin, self.end = begin[real], stops[real]
        self.lengths = np.bincount(of[real], minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.word = word_hashes(raw, self.begin, self.end)
        starts = np.arange(max(0, len(self.begin) - width + 1))
        doc = of[real][: len(starts)]
        inside = starts + width <= self.first[doc + 1]
        self.starts, self.doc = starts[inside], doc[inside]  # of windows: first word and document
        self.window = rolling(self.word, width)[inside]

    def owners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct windows, smallest id of each, which distinct window each window is)."""
        order = np.argsort(self.window)
        first = np.flatnonzero(np.concatenate(([True] * bool(len(order)), np.diff(self.window[order]) != 0)))
        back = np.empty(len(order), np.int64)
        back[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return self.window[order[first]], np.minimum.reduceat(self.ids[self.doc[order]], first) if len(first) else np.empty(0, np.int64), back

    def slice(self, word: int, n: int) -> bytes:
        """n words that follow each other."""
        return self.text[self.begin[word] : self.end[word + n - 1]]


def passages(order: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains of windows that always occur together.

    order: the window number at each recurring position, in text order; follows[i]: position i + 1 continues position i.
    Returns for each chain (in pieces of PHRASE windows) the first position of its first occurrence and its length, so that each window is in
    exactly one piece.
    """
    n = int(order.max()) + 1 if len(order) else 0
    low, high = np.full(n, n + 1), np.full(n, -2)
    before_low, before_high = np.full(n, n + 1), np.full(n, -2)
    after = np.where(follows, np.append(order[1:], -1), -1)
    before = np.where(np.concatenate(([False], follows[:-1])), np.concatenate(([-1], order[:-1])), -1)
    np.minimum.at(low, order, after)
    np.maximum.at(high, order, after)
    np.minimum.at(before_low, order, before)
    np.maximum.at(before_high, order, before)
    # A link stands if its left window has one successor, its right window one predecessor.
    linked = follows & (low[order] == high[order]) & (low[order] >= 0)
    right = np.append(order[1:], 0)
    linked &= (before_low[right] == before_high[right]) & (before_low[right] == order) & (right != order)
    heads = ~np.concatenate(([False], linked[:-1]))
    begin = np.flatnonzero(heads)
    length = np.diff(np.append(begin, len(order)))
    _, once = np.unique(order[begin], return_index=True)
    begin, length = begin[once], length[once]
    pieces = -(-length // PHRASE)
    skip = PHRASE * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return np.repeat(begin, pieces) + skip, np.minimum(PHRASE, np.repeat(length, pieces) - skip)


class Phrases:
    """An Aho-Corasick automaton over the words of a block: phrases are given by their first words and lengths."""

    def __init__(self, b: Block, at: np.ndarray, length: np.ndarray):
        import ahocorasick

        self.b, self.length = b, length.tolist()
        self.phrase = [b.slice(a, n) for a, n in zip(at.tolist(), self.length, strict=True)]
        used = np.unique(np.concatenate([b.word[a : a + n] for a, n in zip(at.tolist(), self.length, strict=True)]))
        rank = np.minimum(np.searchsorted(used, b.word), len(used) - 1)
        self.letters = np.where(used[rank] == b.word, rank + 1, 0)  # 0: a word that no phrase has
        self.plain = len(used) < LETTERS
        if self.plain:
            self.letters += FIRST
            self.letters += np.where(self.letters >= SURROGATES[0], SURROGATES[1] - SURROGATES[0], 0)
            self.letters = self.letters.astype(np.uint32)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, *([] if self.plain else [ahocorasick.KEY_SEQUENCE]))
        for k, (a, n) in enumerate(zip(at.tolist(), self.length, strict=True)):
            self.machine.add_word(self.spelt(a, n), k)
        self.machine.make_automaton()

    def spelt(self, word: int, n: int):
        letters = self.letters[word : word + n]
        return letters.tobytes().decode("utf-32-le") if self.plain else tuple(letters.tolist())

    def occurrences(self, word: int, n: int) -> Iterator[tuple[int, int]]:
        """(first word, phrase) of every occurrence in n words: letters are words' hashes, so what is found is compared byte by byte."""
        for end, k in self.machine.iter(self.spelt(word, n)):
            at = word + end - self.length[k] + 1
            if self.b.slice(at, self.length[k]) == self.phrase[k]:
                yield at, k


def wanted_passages(b: Block, asked: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """For every block that asked (hashes, blocks): the owners and the word sequences of what it asked for; the ids of b have to rise."""
    hashes, to = (np.concatenate(x) for x in zip(*asked, strict=True))
    wanted = np.unique(hashes)
    at = np.minimum(np.searchsorted(wanted, b.window), len(wanted) - 1)
    here = np.flatnonzero(wanted[at] == b.window)
    found, first = np.unique(at[here], return_index=True)  # the first occurrence is the owner's
    window = here[first][np.searchsorted(found, np.searchsorted(wanted, hashes))]
    order = np.lexsort((window, to))
    window, to = window[order], to[order]
    runs = np.flatnonzero(np.concatenate(([True], (np.diff(to) != 0) | (np.diff(window) != 1) | (np.diff(b.doc[window]) != 0))))
    ends = np.append(runs[1:], len(window))
    cut = np.flatnonzero(np.concatenate(([True], np.diff(to[runs]) != 0)))
    word, size, owner, to = b.starts[window[runs]].tolist(), (ends - runs + width - 1).tolist(), b.ids[b.doc[window[runs]]].tolist(), to[runs]
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(runs)], strict=True):
        yield int(to[i]), owner[i:j], [b.slice(a, n) for a, n in zip(word[i:j], size[i:j], strict=True)]


def removed_words(ids: list[int], texts: list[bytes], shown: list[tuple[int, bytes]], width: int) -> list[np.ndarray]:
    """For each document a mask of the words under an occurrence of a window that has an owner with a smaller id.

    ids have to rise; texts are words joined by one blank; shown: passages of other blocks with their owners' ids.
    """
    shown = sorted(shown, key=lambda x: x[0])
    b = Block([*(i for i, _ in shown), *ids], [*(t for _, t in shown), *texts], width)
    own = int(b.first[len(shown)])  # the first word of the block's own documents
    gone = np.zeros(len(b.begin) + 1, np.int64)
    values, least, back = b.owners()
    recurs = np.zeros(len(values), bool)
    recurs[back[(b.starts >= own) & (least[back] < b.ids[b.doc])]] = True
    positions = np.flatnonzero(recurs[back])
    if len(positions):
        kinds, order = np.unique(back[positions], return_inverse=True)
        follows = np.append((np.diff(positions) == 1) & (np.diff(b.doc[positions]) == 0), False)
        begin, length = passages(order, follows)  # first occurrences: in what was shown, else in the owner's own text
        phrases, owner = Phrases(b, b.starts[positions[begin]], length + width - 1), least[kinds]
        for d, i in enumerate(ids, len(shown)):  # every document streams through the automaton
            f, n = int(b.first[d]), int(b.lengths[d])
            if n >= width and (found := list(phrases.occurrences(f, n))):
                at, which = np.array(found, np.int64).T
                n = length[which]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # each window of each occurrence
                lost = (np.repeat(at, n) + within)[owner[order[np.repeat(begin[which], n) + within]] < i]
                np.add.at(gone, lost, 1)
                np.add.at(gone, lost + width, -1)
    mask = np.cumsum(gone[:-1]) > 0
    return [mask[a:z] for a, z in zip(b.first[len(shown) : -1].tolist(), b.first[len(shown) + 1 :].tolist(), strict=True)]


def kept_text(text: str | None, words: bytes, mask: np.ndarray, layout: bool) -> str | None:
    if not mask.any():
        return text if layout else words.decode("utf-8", "surrogatepass")
    gone = mask.tolist()
    if layout:
        raw = text.encode("utf-8", "surrogatepass")
        pieces = list(_WORD.finditer(raw))
        out = raw[: pieces[0].start()] + b"".join(m[0] for m, out in zip(pieces, gone, strict=True) if not out)
    else:
        out = b" ".join([x for x, out in zip(words.split(b" "), gone, strict=True) if not out])
    return out.decode("utf-8", "surrogatepass")


def dealing(size: int, block_mb: float, shard_mb: float) -> tuple[int, int]:
    """(shards, blocks) of a table of so many bytes. A block sends a message to every shard: from GROWS_FROM bytes on blocks grow with the square root of the table, up to MOST_BLOCK_MB, and shards with its fourth root, so that messages stay full."""
    more = max(1.0, size / GROWS_FROM)
    block, shard = max(block_mb, min(MOST_BLOCK_MB, block_mb * more**0.5)), shard_mb * more**0.25
    return max(12, int(size / (shard * 1e6)) + 1), max(32, int(size / (block * 1e6)) + 1)


def remove_repeats(docs: DataFrame, width: int = WIDTH, block_mb: float = 0.4, shard_mb: float = 4.0, layout: bool = False) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the kept words joined by one blank, or (layout) the text without the removed words and the white space after each."""
    import zstandard

    prepare(docs.sparkSession)
    n_shards, blocks = dealing(input_bytes(docs), block_mb, shard_mb)
    docs = docs.drop("_block", "_id", "n_words", "n_removed", "kept_text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    # The block comes first, so that all uses of the dealt documents can share one exchange.
    number = F.col("doc_id").cast("long")
    block = F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int")
    dealt = docs.filter(number.isNotNull()).select(block.alias("_block"), number.alias("_id"), "*")

    def block_of(pdf: pd.DataFrame) -> Block:
        pdf = pdf.sort_values("_id", kind="stable")
        return Block(pdf["_id"].tolist(), [plain(t) for t in pdf["text"]], width)

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        values, least, _ = block_of(pdf).owners()
        cut = np.searchsorted(values, np.array([(s << 64) // n_shards for s in range(1, n_shards)], np.uint64))
        out = [(s, int(pdf["_block"].iloc[0]), pack_sorted(v), pack(o)) for s, (v, o) in enumerate(zip(np.split(values, cut), np.split(least, cut), strict=True)) if len(v)]
        return pd.DataFrame(out, columns=["shard", "_from", "hashes", "owners"])

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [unpack_sorted(x) for x in pdf["hashes"]]
        every = np.concatenate(hashes)
        order = np.argsort(every)
        same = np.diff(every[order]) == 0
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        every, ids = every[order], np.concatenate([unpack(x, np.int64) for x in pdf["owners"]])[order]
        sender = np.repeat(pdf["_from"].to_numpy(), [len(h) for h in hashes])[order]
        first = np.flatnonzero(np.diff(every, prepend=every[:1] + np.uint64(1)) != 0)
        n = np.diff(np.append(first, len(every)))
        owns = ids == np.repeat(np.minimum.reduceat(ids, first), n) if len(first) else np.zeros(0, bool)  # one block for each window: all other blocks ask it
        owner, every, sender = np.repeat(sender[owns], n)[~owns], every[~owns], sender[~owns]
        order = np.argsort(owner, kind="stable")
        owner, every, sender = owner[order], every[order], sender[order]
        cut = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        out = [(int(owner[a]), pack_sorted(every[a:z]), pack(sender[a:z].astype(np.uint32))) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame(out, columns=["_owner", "hashes", "blocks"])

    def show(pdf: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(asked):
            asked = [(unpack_sorted(h), unpack(x, np.uint32)) for h, x in zip(asked["hashes"], asked["blocks"], strict=True)]
            for to, owners, texts in wanted_passages(block_of(pdf), asked, width):
                out.append((to, np.array(owners, np.int64).tobytes(), zstandard.ZstdCompressor(level=1).compress(b"\n".join(texts))))
        return pd.DataFrame(out, columns=["_to", "owners", "texts"])

    def remove(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=schema.names)
        pdf = pdf.sort_values("_id", kind="stable")
        words = [plain(t) for t in pdf["text"]]
        shown = [x for o, t in zip(sent["owners"], sent["texts"], strict=True) for x in zip(np.frombuffer(o, np.int64).tolist(), zstandard.ZstdDecompressor().decompress(t).split(b"\n"), strict=True)]
        masks = removed_words(pdf["_id"].tolist(), words, shown, width)
        kept = [kept_text(t, w, m, layout) for t, w, m in zip(pdf["text"], words, masks, strict=True)]
        return pdf.drop(columns=["_block", "_id"]).assign(n_words=list(map(len, masks)), n_removed=[int(m.sum()) for m in masks], kept_text=kept)

    def unchanged(batches):
        for pdf in batches:
            words = [raw_words(t) for t in pdf["text"]]
            yield pdf.assign(n_words=list(map(len, words)), n_removed=0, kept_text=[kept_text(t, plain(t), np.zeros(0), layout) for t in pdf["text"]])

    sent = dealt.groupBy("_block").applyInPandas(send, "shard int, _from int, hashes binary, owners binary")
    asked = sent.groupBy("shard").applyInPandas(confirm, "_owner int, hashes binary, blocks binary")
    shown = dealt.groupBy("_block").cogroup(asked.groupBy("_owner")).applyInPandas(show, "_to int, owners binary, texts binary")
    out = dealt.groupBy("_block").cogroup(shown.groupBy("_to")).applyInPandas(remove, schema)
    return out.unionAll(docs.filter(number.isNull()).mapInPandas(unchanged, schema))
