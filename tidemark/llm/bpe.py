"""Byte-level BPE by speculation: propose greedily, verify pairs, merge only what fails.

A word's greedy longest-match tokens are its BPE tokens exactly if every adjacent
pair of them is: two neighbours are compatible if merging their joined bytes by
rank gives the same two tokens. Pairs are checked with one array look-up for all
words of a batch; a pair not met before is decided once, by exact merging. Words
with a failing pair, and those only, are merged from bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pattern that cuts text into words in this family of tokenizers.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A space before anything but white space always begins a word, so texts without
# other spaces can be cut there and each piece looked up as a whole; pieces not met
# before are cut into words as one text again.
UNSAFE = r" (?=\p{White_Space}|$)"
LONG_WORD = 200
NO_MERGE = (1 << 60, 0)
NO_RANK = (1 << 31) - 1
SHORT_WORD = 64  # bytes of words that are merged together
FEW = 8  # so many are not worth it
TOGETHER = 1 << 16  # words merged, or tokens spelt out, at once
REMEMBERED = 32 << 20  # bytes, about, of the words a worker remembers; then it starts afresh
PAIRS = 1 << 20  # pairs remembered, likewise
ENTRY = 200  # bytes of one remembered word besides its letters
CHUNK = 1 << 20  # bytes of text encoded at once, about


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files spell bytes: printable ones as they are, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("the file is not of byte-level BPE without a normaliser")

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.token = {i: raw(t) for t, i in model["vocab"].items()}
        self.number = {t: i for i, t in self.token.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token[i] = content.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge = {}
        number = model["vocab"]
        for rank, (left, right) in enumerate(pairs):
            self.merge.setdefault((number[left], number[right]), (rank, number[left + right]))
        self.single = [self.number[bytes([b])] for b in range(256)]
        # the same merges for look-ups of many pairs at once, by pair and by rank
        merges = sorted(((a << 32) | b, rank, made) for (a, b), (rank, made) in self.merge.items())
        self.pair, self.rank = np.array([m[0] for m in merges], np.int64), np.array([m[1] for m in merges], np.int32)
        self.made = np.zeros(len(pairs) + 1, np.int32)
        self.made[self.rank] = [m[2] for m in merges]
        self.first = np.array(self.single, np.int32)
        # tokens that merging can make: only these are proposed
        tokens = list(self.number)
        self.proposed = {t: self.number[t] for t, ids in zip(tokens, self.exact_all(tokens), strict=True) if len(t) == 1 or list(ids) == [self.number[t]]}
        self.edge, self.next, self.accepted = prefix_tree(self.proposed)
        spelt = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.letters = np.frombuffer(b"".join(spelt), np.uint8)
        self.n_letters = np.array([len(t) for t in spelt], np.int32)
        self.letters_from = np.cumsum(self.n_letters, dtype=np.int64) - self.n_letters
        self.good_pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs met, in order, and whether they are compatible
        self.pattern, self.unsafe = regex.compile(PATTERN), regex.compile(UNSAFE)
        self.forget()
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def exact(self, word: bytes) -> list[int]:
        """Merge from single bytes, always the pair of least rank, leftmost first."""
        if len(word) > LONG_WORD:
            return self.exact_long(word)
        ids, merge = [self.single[b] for b in word], self.merge.get
        ranks = [merge(pair, NO_MERGE)[0] for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            rank = min(ranks)
            if rank == NO_MERGE[0]:
                break
            i = ranks.index(rank)
            ids[i] = merge((ids[i], ids[i + 1]))[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge((ids[i - 1], ids[i]), NO_MERGE)[0]
            if i < len(ranks):
                ranks[i] = merge((ids[i], ids[i + 1]), NO_MERGE)[0]
        return ids

    def exact_long(self, word: bytes) -> list[int]:
        """The same with a queue and linked neighbours: time grows as n log n."""
        ids, merge, n = [self.single[b] for b in word], self.merge.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (m := merge((ids[left], ids[right]))):
                    heapq.heappush(queue, (m[0], left, m[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def exact_all(self, words: list[bytes]) -> list[np.ndarray]:
        """``exact`` of many words. Words of one length are merged together: a round
        merges the leftmost pair of least rank of each, so they stay of one length."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes).tolist():
            alike = np.flatnonzero(sizes == size)
            if size > SHORT_WORD or len(alike) < FEW:
                for i in alike.tolist():
                    out[i] = np.array(self.exact(words[i]), np.int32)
                continue
            for begin in range(0, len(alike), TOGETHER):
                self.exact_alike(words, alike[begin : begin + TOGETHER], size, out)
        return out

    def exact_alike(self, words: list[bytes], which: np.ndarray, size: int, out: list) -> None:
        data = np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8).reshape(len(which), size)
        ids = self.first[data]
        ranks = self.ranks_of(ids[:, :-1], ids[:, 1:])
        while len(which):
            n, size = ids.shape
            at = ranks.argmin(axis=1) if size > 1 else np.zeros(n, np.int64)
            rows = np.arange(n)
            live = ranks[rows, at] < NO_RANK if size > 1 else np.zeros(n, bool)
            if not live.all():
                for i, done in zip(which[~live].tolist(), ids[~live], strict=True):
                    out[i] = done
                which, ids, ranks, at = which[live], ids[live], ranks[live], at[live]
                n = len(which)
                rows = np.arange(n)
                if not n:
                    return
            ids[rows, at] = self.made[ranks[rows, at]]
            keep = np.ones((n, size), bool)
            keep[rows, at + 1] = False
            ids = ids[keep].reshape(n, size - 1)
            keep = np.ones((n, size - 1), bool)
            keep[rows, at] = False
            ranks = ranks[keep].reshape(n, size - 2)
            for beside in (at - 1, at):  # the pairs that the new token is in
                there = np.flatnonzero((beside >= 0) & (beside < size - 2))
                j = beside[there]
                ranks[there, j] = self.ranks_of(ids[there, j], ids[there, j + 1])

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``NO_RANK`` if there is none."""
        if not len(self.pair):
            return np.full(left.shape, NO_RANK, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NO_RANK)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: tokens of all, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        stop = np.cumsum(sizes)
        tokens = np.full(len(data), -1, np.int32)  # by the place where they begin
        begin, stops = (stop - sizes)[sizes > 0], stop[sizes > 0]
        at, node = begin, np.zeros(len(begin), np.int32)
        found, end = self.first[data[begin]], begin + 1
        while len(begin):
            key = (node << 8) | data[np.minimum(at, len(data) - 1)]
            place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = (self.edge[place] == key) & (at < stops)
            node, at = self.next[place], at + 1
            token = self.accepted[node]
            longer = on & (token >= 0)
            found, end = np.where(longer, token, found), np.where(longer, at, end)
            if on.all():
                continue
            off = ~on
            tokens[begin[off]] = found[off]
            begin = np.where(off, end, begin)
            left = begin < stops
            begin, stops, at, node, found, end, off = begin[left], stops[left], at[left], node[left], found[left], end[left], off[left]
            at, node = np.where(off, begin, at), np.where(off, 0, node).astype(np.int32)
            found, end = np.where(off, self.first[data[begin]], found), np.where(off, begin + 1, end)
        starts = np.flatnonzero(tokens >= 0)
        return tokens[starts], np.bincount(np.searchsorted(stop, starts, "right"), minlength=len(words))

    def tokens_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, by speculation, and how many each has."""
        spelt = [w.encode() for w in words]
        flat, lengths = self.propose(spelt)
        last = np.cumsum(lengths) - 1
        pair = (flat[:-1].astype(np.int64) << 32) | flat[1:]
        within = np.ones(len(pair), bool)
        within[last[:-1]] = False
        bad = np.zeros(len(flat), bool)
        bad[:-1][within] = ~self.compatible(pair[within])
        failing = np.flatnonzero(np.add.reduceat(bad, last - lengths + 1, dtype=np.int64))
        if len(failing):
            merged = self.exact_all([spelt[i] for i in failing.tolist()])
            keep = np.ones(len(words), bool)
            keep[failing] = False
            owner = np.repeat(np.arange(len(words)), lengths)
            lengths[failing] = [len(m) for m in merged]
            owners = np.concatenate([owner[keep[owner]], np.repeat(failing, lengths[failing])])
            flat = np.concatenate([flat[keep[owner]], *merged])[np.argsort(owners, kind="stable")]
        return flat, lengths

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes gives the same two tokens."""
        distinct, where = np.unique(pairs, return_inverse=True)
        place = np.searchsorted(self.good_pairs, distinct)
        met = np.zeros(len(distinct), bool)
        inside = place < len(self.good_pairs)
        met[inside] = self.good_pairs[place[inside]] == distinct[inside]
        verdict = np.zeros(len(distinct), bool)
        verdict[met] = self.good[place[met]]
        if not met.all():
            new = distinct[~met]
            two = [(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()]
            merged = self.exact_all([self.token[a] + self.token[b] for a, b in two])
            verdict[~met] = [len(ids) == 2 and ids[0] == a and ids[1] == b for ids, (a, b) in zip(merged, two, strict=True)]
            if len(self.good_pairs) > PAIRS:
                self.good_pairs, self.good = new, verdict[~met]
            else:
                place = np.searchsorted(self.good_pairs, new)
                self.good_pairs, self.good = np.insert(self.good_pairs, place, new), np.insert(self.good, place, verdict[~met])
        return verdict[where]

    def forget(self) -> None:
        """Words and pieces start afresh; special tokens stay."""
        self.words: dict[str, int] = {}  # entry of each word
        self.pieces: dict[str, int] = {}  # the same by text after a space
        self.held = 0  # bytes remembered, about
        self.entries = 0
        self.begin, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int32)  # an entry's tokens in ``flat``
        self.flat, self.used = np.zeros(4096, np.int32), 0
        self.specials = dict(zip(self.special, self.remember(np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64)), strict=True))

    def remember(self, tokens: np.ndarray, lengths: np.ndarray) -> range:
        """New entries of these tokens."""
        n, used = self.entries + len(lengths), self.used + len(tokens)
        if n > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros(n, np.int32)]) for x in (self.begin, self.size))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.int32)])
        self.begin[self.entries : n] = self.used + np.cumsum(lengths) - lengths
        self.size[self.entries : n] = lengths
        self.flat[self.used : used] = tokens
        made, self.entries, self.used = range(self.entries, n), n, used
        return made

    def tokens_at(self, entries: np.ndarray) -> np.ndarray:
        return gathered(self.flat, self.begin[entries], self.size[entries])

    def learn(self, words: set[str], pieces: list[str]) -> None:
        """Entries of words, and of pieces not met before."""
        found = self.pattern.findall(" " + " ".join(pieces)) if pieces else []
        words = list(words.union(found).difference(self.words))
        if words:
            self.words.update(zip(words, self.remember(*self.tokens_of(words)), strict=True))
        self.held += ENTRY * (len(words) + len(pieces)) + 2 * (sum(map(len, words)) + sum(map(len, pieces)))
        if not pieces:
            return
        entries = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        first = np.flatnonzero(np.fromiter((w[0] == " " for w in found), bool, len(found)))  # of each piece
        counts = np.diff(first, append=len(found))
        mine, several = entries[first], counts > 1
        if several.any():
            parts = entries[np.repeat(several, counts)]
            lengths = np.add.reduceat(self.size[entries], first, dtype=np.int64)[several]
            mine[several] = self.remember(self.tokens_at(parts), lengths)
        self.pieces.update(zip(pieces, mine.tolist(), strict=True))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and the last one's end; the
        strings of special tokens are those tokens."""
        if self.held > REMEMBERED:
            self.forget()
        rows: list[list] = []
        words: set[str] = set()
        met: set[str] = set()  # pieces
        cut = self.pattern.findall
        for text in texts:
            row: list = []
            for part in self.cut.split(text) if self.cut else [text]:
                if part in self.special:
                    row.append((self.specials, [part]))
                elif part and (" " not in part or self.unsafe.search(part)):
                    row.append((self.words, found := cut(part)))
                    words.update(found)
                elif part:
                    first, *pieces = part.split(" ")
                    row.append((self.words, found := cut(first)))
                    words.update(found)
                    row.append((self.pieces, pieces))
                    met.update(pieces)
            rows.append(row)
        self.learn(words, list(met.difference(self.pieces)))
        entries: list[int] = []
        ends = [0]
        for row in rows:
            for where, keys in row:
                entries += map(where.__getitem__, keys)
            ends.append(len(entries))
        at = np.array(entries, np.int64)
        del entries
        return self.tokens_at(at), np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])[ends]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts; bytes that are no UTF-8 become U+FFFD."""
        parts = [ids[i : i + TOGETHER] for i in range(0, len(ids), TOGETHER)]
        data = b"".join([gathered(self.letters, self.letters_from[p], self.n_letters[p]).tobytes() for p in parts])
        bounds = np.concatenate([[0], np.cumsum(self.n_letters[ids], dtype=np.int64)])[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(begin - ends + size, size)
    return flat[at]


def prefix_tree(tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges as ``node << 8 | byte`` in order, the nodes they lead to, and the token that
    ends in each node, or -1."""
    edges: dict[int, int] = {}
    ending = {}
    for token, number in tokens.items():
        node = 0
        for byte in token:
            node = edges.setdefault((node << 8) | byte, len(edges) + 1)
        ending[node] = number
    accepted = np.full(len(edges) + 1, -1, np.int32)
    accepted[list(ending)] = list(ending.values())
    keys, nodes = np.array(list(edges), np.int32), np.array(list(edges.values()), np.int32)
    order = np.argsort(keys)
    return keys[order], nodes[order], accepted


def vocabulary_text(path: str) -> str:
    """The file is small, of one size whatever the input, and travels with the plan."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def kept_vocabulary(path: str, text: str) -> Vocabulary:
    """The vocabulary a worker process has built, with the words it has met."""
    held = sys.modules.setdefault("tidemark_vocabularies", types.ModuleType("tidemark_vocabularies")).__dict__
    key = f"{path}:{hashlib.sha256(text.encode()).hexdigest()}"
    if key not in held:
        held[key] = Vocabulary(text)
    return held[key]


def tokenised(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with ``token``: a struct of ``n_tokens``, ``ids`` and ``decoded``, or their digests.

    Null text is empty text: no tokens. Texts of any length are encoded whole; a
    word is what the pattern cuts, however long. A column named ``token`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))
    fields = "n_tokens long"
    fields += ", ids array<int>, decoded string" if keep_ids else ""
    fields += ", ids_sha256 string, decoded_sha256 string" if digests else ""

    def coded(vocabulary: Vocabulary, texts: list[str]) -> pa.StructArray:
        ids, ends = vocabulary.encode_flat(texts)
        decoded = vocabulary.decode_flat(ids, ends)
        out = [pa.array(np.diff(ends), pa.int64())]
        if keep_ids:
            out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
        if digests:
            ids, bounds = ids.astype("<u4", copy=False), ends.tolist()
            out.append(pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]))
            out.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]))
        return pa.StructArray.from_arrays(out, [name.split()[0] for name in fields.split(", ")])

    # texts are taken and given back chunk by chunk, so that a worker never holds a batch but in Arrow
    @F.arrow_udf(fields)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = kept_vocabulary(path, shared.value)
        for texts in batches:
            for chunk in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", CHUNK):
                yield coded(vocabulary, [t or "" for t in chunk.column(0).to_pylist()])

    keep = [docs[f"`{c}`"] for c in docs.columns if c.lower() != "token"]
    return docs.select(*keep, tokens(docs[f"`{text}`"]).alias("token"))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token.n_tokens``, ``token.ids`` and ``token.decoded``."""
    return tokenised(docs, path, text)


def token_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; ids are little-endian 32 bits each."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = tokenised(rows, path, "text", keep_ids=False, digests=True)
    return out.select("doc_id", "token.n_tokens", "token.ids_sha256", "token.decoded_sha256")
