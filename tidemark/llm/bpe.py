"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. Its states are the tokens (the one read last), and it accepts
exactly the sequences that the merges produce. It is compiled on the driver by one gadget per merge, in order of
priority, into flat integer arrays. The gadget of (a, b) -> c

* removes the arc a -> b, since the two are merged wherever they meet (`rank`, an open-addressed table of removed arcs);
* adds a state c that copies the arcs out of b as they were before the removal (`right`, `made`);
* gives c the arcs into a as they are after it (`left`; this order makes a run of equal symbols merge from the left).

Later gadgets only remove arcs between older states, so `Automaton.arcs` reads an arc off the gadgets that made its ends, for whole
arrays of arcs at a time; answers stay in a table of fixed size. The labels of the states are a double-array
trie over bytes (`base`, `check`, `token`). Pre-split words are encoded together, one position at a time: the trie yields the
labels that begin there, and those with an arc from the one state that the position has give the states of later positions. No
position has two, so nothing is tried twice or taken back, and a word's tokens are read from its end. Decoding
emits the arcs' labels.

Normalisation and pre-splitting are those of the tokenizers library, as its Unicode tables are older than Python's. Free style:
Arrow batches through mapInArrow, map-only, with no shuffle. A worker keeps recent chunks (stretches without white space) in a
bounded cache; only those not in it are encoded.

Defined results: a null or empty text has no tokens, and neither has one of white space alone; special tokens within a text are
read as the library reads them; lone surrogates can't occur in Spark's strings; repeated rows stay; an empty table gives no rows;
texts and words of any length are read whole.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of

#: Chunks in a worker's cache before the older half goes, chunk length beyond which none is kept, slots of the arc table (a power of two).
CACHE, LONG, SLOTS = 150_000, 64, 1 << 20
#: Words of up to this many bytes are encoded together, longer ones one at a time.
TOGETHER = 96
NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in own else spare)
        spare += b not in own
    return out


def slots_of(keys: np.ndarray, size: int) -> np.ndarray:
    """Slots of a table of `size` (a power of two) for keys of 64 bits."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def double_array(children: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base and check of a trie given as (symbol, child) lists, and the place of each node; node 0 is at place 0."""
    room = 2 * sum(map(len, children)) + 4096
    base, check, place = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.zeros(len(children), np.int64)
    free = np.ones(room, bool)
    free[:512] = False
    low = 512
    # parents before children, so that each node has its place before its own children get theirs
    for node, own in enumerate(children):
        if not own:
            continue
        symbols = np.array([s for s, _ in own])
        while not free[low]:
            low += 1
        if len(own) == 1:
            first = low - own[0][0]
        at, width = low, 64
        while len(own) > 1:
            spots = at + np.flatnonzero(free[at : at + width])
            fits = free[spots[:, None] + (symbols - symbols[0])[None, :]].all(axis=1)
            if fits.any():
                first = int(spots[np.argmax(fits)]) - int(symbols[0])
                break
            at, width = at + width, min(4096, 2 * width)
        here = int(place[node])
        base[here] = first
        for s, child in own:
            free[first + s] = False
            check[first + s] = here
            place[child] = first + s
    return base, check, place


def compiled(spec: dict) -> dict:
    """The automaton's flat arrays from a vocabulary file of the tokenizers library (BPE with word ends)."""
    model = spec["model"]
    ids: dict[str, int] = model["vocab"]
    end = model["end_of_word_suffix"]
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    n = max([*ids.values(), *special.values()]) + 1
    labels = [""] * n
    for text, i in [*ids.items(), *special.items()]:
        labels[i] = text
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    # the trie, breadth first by length of label: symbols are bytes, plus 256 for the last of a word
    words = []
    for text, i in ids.items():
        bare = text.removesuffix(end) if text.endswith(end) and text != end else text
        symbols = [byte_of[c] for c in bare]
        if len(bare) < len(text):
            symbols[-1] += 256
        words.append((symbols, i))
    nodes: dict[tuple[int, int], int] = {}
    children: list[list[tuple[int, int]]] = [[]]
    ends: list[int] = [-1]
    front = [(0, symbols, i) for symbols, i in words]
    depth = 0
    while front:
        left = []
        for node, symbols, i in front:
            child = nodes.get(key := (node, symbols[depth]))
            if child is None:
                child = nodes[key] = len(children)
                children.append([])
                ends.append(-1)
                children[node].append((symbols[depth], child))
            if depth + 1 == len(symbols):
                ends[child] = i
            else:
                left.append((child, symbols, i))
        front, depth = left, depth + 1
    base, check, place = double_array([sorted(x) for x in children])
    token = np.full(len(base), -1, np.int32)
    token[place] = ends
    # the gadgets
    made, left_of, right_of = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    pairs = np.zeros(len(model["merges"]), np.int64)
    for k, (a, b) in enumerate(model["merges"]):
        ia, ib, ic = ids[a], ids[b], ids[a + b]
        if made[ic] >= 0:
            raise ValueError(f"two merges make {labels[ic]!r}")
        if max(made[ia], made[ib]) >= k:
            raise ValueError("a merge uses what a later one makes")
        made[ic], left_of[ic], right_of[ic], pairs[k] = k, ia, ib, ia << 20 | ib
    size = 1 << max(4, (4 * len(pairs)).bit_length())
    keys, ranks = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
    for k, (pair, slot) in enumerate(zip(pairs.tolist(), slots_of(pairs, size).tolist(), strict=True)):
        while keys[slot] >= 0:
            slot = (slot + 1) & (size - 1)
        keys[slot], ranks[slot] = pair, k
    split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    return {"base": base, "check": check, "token": token, "made": made, "left": left_of, "right": right_of, "keys": keys, "ranks": ranks, "labels": labels, "special": special, "split": split}


class Automaton:
    """The compiled automaton with the answers it keeps."""

    def __init__(self, tables: dict) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.base, self.check, self.token = tables["base"], tables["check"], tables["token"]
        self.made, self.left, self.right, self.keys, self.ranks = (tables[k] for k in ("made", "left", "right", "keys", "ranks"))
        self.labels, self.special = tables["labels"], tables["special"]
        self.asked, self.answer = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.parts = pre_tokenizers.Split(Regex(tables["split"]), "removed", invert=True).pre_tokenize_str

    def rank(self, pairs: np.ndarray) -> np.ndarray:
        """The merges that remove these arcs, or NEVER."""
        mask, out = len(self.keys) - 1, np.full(len(pairs), NEVER, np.int32)
        slot, left = slots_of(pairs, len(self.keys)), np.arange(len(pairs))
        while len(left):
            seen = self.keys[slot]
            hit = seen == pairs[left]
            out[left[hit]] = self.ranks[slot[hit]]
            more = ~hit & (seen >= 0)
            left, slot = left[more], (slot[more] + 1) & mask
        return out

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether there are arcs from the states u to the states v."""
        keys = u.astype(np.int64) << 20 | v
        slot = slots_of(keys, SLOTS)
        out = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != keys)
        if len(new):
            out[new] = found = self.unrolled(u[new], v[new])
            self.asked[slot[new]], self.answer[slot[new]] = keys[new], found
            # two new arcs may share a slot: the table then holds the last one's key, and must hold its answer
            self.answer[slot[new]] = np.where(self.asked[slot[new]] == keys[new], found, self.answer[slot[new]])
        return out

    def unrolled(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Arcs by the gadgets that made their ends, the latest first."""
        out, left = np.ones(len(u), bool), np.arange(len(u))
        a, b, before = u.astype(np.int64), v.astype(np.int64), np.full(len(u), NEVER, np.int64)
        while len(left):
            gone = self.rank(a << 20 | b) < before
            out[left[gone]] = False
            ka, kb = self.made[a], self.made[b]
            on = ~gone & ((ka >= 0) | (kb >= 0))
            left, a, b, ka, kb = left[on], a[on], b[on], ka[on], kb[on]
            before = np.where(ka >= kb, ka, kb + 1)
            a, b = np.where(ka >= kb, self.right[a], a).astype(np.int64), np.where(ka <= kb, self.left[b], b).astype(np.int64)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pre-split words (not empty), one after another, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        long = sizes[order]
        starts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int16)
        symbols[starts + sizes - 1] += 256
        first = starts[order]  # of each word's symbols, by falling length
        own = np.cumsum(long + 1) - (long + 1)  # of each word's positions
        state, back = np.full(int((long + 1).sum()), -1, np.int32), np.zeros(int((long + 1).sum()), np.int32)
        alive = np.searchsorted(-long, -np.arange(int(long[0])), side="left")
        for i, k in enumerate(alive.tolist()):
            act, node, d = np.arange(k), np.zeros(k, np.int64), 0
            whos, tokens, depths = [], [], []
            while len(act):
                t = self.base[node] + symbols[first[act] + (i + d)]
                on = self.check[t] == node
                act, node, d = act[on], t[on].astype(np.int64), d + 1
                got = self.token[node]
                some = got >= 0
                whos.append(act[some])
                tokens.append(got[some])
                depths.append(np.full(len(whos[-1]), d))
                on = long[act] > i + d
                act, node = act[on], node[on]
            who, v, ahead = np.concatenate(whos), np.concatenate(tokens), np.concatenate(depths)
            if i:
                u = state[own[who] + i]
                fine = u >= 0
                fine[fine] = self.arcs(u[fine], v[fine])
                who, v, ahead = who[fine], v[fine], ahead[fine]
            at = own[who] + i + ahead
            state[at], back[at] = v, i
        # from each word's end to its start
        here, act, whos, tokens = long.copy(), np.arange(len(words)), [], []
        while len(act):
            at = own[act] + here[act]
            if (state[at] < 0).any():
                raise ValueError("the vocabulary lacks a byte")
            whos.append(order[act])
            tokens.append(state[at])
            here[act] = back[at]
            act = act[here[act] > 0]
        who, tokens = np.concatenate(whos[::-1]), np.concatenate(tokens[::-1])
        return tokens[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(words))

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, as the library joins them where a file names no decoder."""
        return " ".join([self.labels[i] for i in ids])


class Encoder:
    """An automaton with the bounded cache of one worker: chunk to ids and to decoded text, as strings."""

    def __init__(self, automaton: Automaton, cache: int = CACHE) -> None:
        self.automaton, self.cache = automaton, cache
        self.names = [str(i) for i in range(len(automaton.labels))]
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def presplit(self, chunks: list[str]) -> list[str | list[str]]:
        """The words of each chunk, normalised; a chunk of one word as it is."""
        a = self.automaton
        out: list[str | list[str]] = []
        rest, places = [], []
        for k, chunk in enumerate(chunks):
            if chunk.isascii():
                text = chunk.lower()
                if text.isalpha():
                    out.append(text)
                    continue
                if (bare := text.rstrip(".,;:!?")).isalpha():
                    out.append([bare, text[len(bare) :]])
                    continue
            else:
                text = a.normal(chunk)
            out.append([])
            rest.append(text)
            places.append(k)
        if rest:
            # in one call; the space between chunks is part of no word
            ends = np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)) + 1)
            got = a.parts(" ".join(rest))
            spots = np.searchsorted(ends, np.fromiter((x[1][0] for x in got), np.int64, len(got)), side="right")
            for (word, _), spot in zip(got, spots.tolist(), strict=True):
                out[places[spot]].append(word)
        return out

    def add(self, chunks: list[str]) -> None:
        """Encodes chunks into the cache."""
        a, parts = self.automaton, self.presplit(chunks)
        words = {p for p in parts if isinstance(p, str)}
        words.update(*[p for p in parts if not isinstance(p, str)])
        ids_of: dict[str, str] = {}
        labels_of: dict[str, str] = {}
        near, far = [], []
        for w in words:
            (near if len(w) <= TOGETHER // 4 else far).append(w)
        for group in ([near] if near else []) + [[w] for w in far]:
            tokens, counts = a.encode_words([w.encode("utf-8", "surrogatepass") for w in group])
            flat = tokens.tolist()
            ids, labels = [self.names[t] for t in flat], [a.labels[t] for t in flat]
            at = 0
            for w, n in zip(group, counts.tolist(), strict=True):
                to = at + n
                if n == 1:
                    ids_of[w], labels_of[w] = ids[at], labels[at]
                else:
                    ids_of[w], labels_of[w] = " ".join(ids[at:to]), " ".join(labels[at:to])
                at = to
        for chunk, p in zip(chunks, parts, strict=True):
            if isinstance(p, str):
                self.ids[chunk], self.decoded[chunk] = ids_of[p], labels_of[p]
            else:
                self.ids[chunk], self.decoded[chunk] = " ".join([ids_of[w] for w in p]), " ".join([labels_of[w] for w in p])

    def chunks(self, text: str) -> list[str]:
        if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):  # white space to Python alone
            return [x for x in regex.split("\\p{White_Space}+", text) if x]
        return text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Ids and decoded text of each text, each joined by one space."""
        a = self.automaton
        parts: list[list[list[str] | str]] = []  # a special token is a string, any other stretch a list of chunks
        seen: set[str] = set()
        for text in texts:
            if "<" in text and a.specials and len(split := a.specials.split(text)) > 1:
                parts.append([x if k % 2 else self.chunks(x) for k, x in enumerate(split)])
            else:
                parts.append([self.chunks(text)])
            for x in parts[-1]:
                if isinstance(x, list):
                    seen.update(x)
        if len(self.ids) > self.cache:
            self.old, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        seen.difference_update(self.ids)
        back, back_decoded = self.old
        new = []
        for chunk in seen:
            if (ids := back.get(chunk)) is None:
                new.append(chunk)
            else:
                self.ids[chunk], self.decoded[chunk] = ids, back_decoded[chunk]
        if new:
            self.add(new)
        ids_of, decoded_of = self.ids.__getitem__, self.decoded.__getitem__
        for own in parts:
            done = [(str(a.special[x]), x) if isinstance(x, str) else (" ".join(map(ids_of, x)), " ".join(map(decoded_of, x))) for x in own]
            yield done[0] if len(done) == 1 else (" ".join(x[0] for x in done if x[0]), " ".join(x[1] for x in done if x[0]))
        for chunk in new:
            if len(chunk) > LONG:
                del self.ids[chunk], self.decoded[chunk]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file, as its package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_spec(path: str) -> tuple[dict, str]:
    """A tokenizers vocabulary file and the digest of all of it, read on the driver; its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        data = f.read()
    spec = json.loads(data)
    got = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]], spec["model"]["type"]
    if got != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "BPE"):
        raise ValueError(f"this kind of vocabulary file isn't supported: {got}")
    return spec, sha256(data).hexdigest()


#: By the digest of a whole vocabulary file: compiled tables (driver) and encoders (workers), the last one only.
_TABLES: dict[str, dict] = {}
_ENCODERS: dict[str, Encoder] = {}


def tables_of(path: str) -> tuple[dict, str]:
    spec, key = load_spec(path)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = compiled(spec)
    return _TABLES[key], key


def slices(texts: list[str], rows: int = 1000, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded rows and characters (one text at least)."""
    at = total = 0
    for k, x in enumerate(texts):
        if k > at and (k - at >= rows or total + len(x) > chars):
            yield at, k
            at, total = k, 0
        total += len(x)
    if at < len(texts):
        yield at, len(texts)


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs' other columns with n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids (array of int).

    Rows keep their order within a partition. Columns of docs that share a name with a new one are replaced.
    """
    import pyarrow as pa

    tables, key = tables_of(path)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids]
    kept = [c for c in docs.columns if c not in (*new, text)]
    types = {"n_tokens": "long", "token_ids": "array<int>"}
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {types.get(c, 'string')}" for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(Automaton(shared.value))
        encoder = _ENCODERS[key]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at, stop in slices(texts):
                part = batch.slice(at, stop - at)
                counts, digests, decoded, flat = [], [], [], []
                gc.disable()  # many small objects and no cycles among them
                for own, back in encoder.encode(texts[at:stop]):
                    counts.append(own.count(" ") + 1 if own else 0)
                    digests.append(sha256(own.encode()).hexdigest())
                    decoded.append(sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if ids:
                        flat.append(np.fromstring(own, dtype=np.int32, sep=" "))
                gc.enable()
                out = [*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, *new])

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), text_of(f"`{text}`").alias("__text"))
    return rows.mapInArrow(run, schema)
