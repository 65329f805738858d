"""Texts that were cut off: backward n-gram evidence at the end of a text, with the lengths at which a source cuts."""

from __future__ import annotations

import codecs
import html
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.operators.skew import join_hot
from millrace.session import discard, ship, written


#: Depth of the shape contexts (word classes and punctuation, read backward) and of the character contexts.
SHAPES, CHARS = 6, 10
#: Keys of an end: root and shape contexts within its source, the same over all sources, character contexts.
KEYS = 2 * (SHAPES + 1) + CHARS
#: The key that each key extends by one symbol; -1 for roots. Characters hang on the global shape of depth 3.
PARENT = [-1, *range(SHAPES), -1, *range(SHAPES + 1, 2 * SHAPES + 1), SHAPES + 4, *range(2 * SHAPES + 2, KEYS - 1)]
#: Contexts kept: those that end so many texts, at every size.
LEAST = 2
#: A model of up to KEYS * CAPACITY contexts is broadcast; a larger one stays a table that is joined by key, but for the
#: contexts that end more than one in HOT texts. Bits of a key by which inner positions are sifted before that join.
CAPACITY, HOT, SIFT = 1 << 17, 1 << 12, 24
#: Characters of a text's end that are looked at, characters per block, and most characters of one piece of a text.
TAIL, BLOCK_CHARS, PIECE = 200, 1 << 18, 1 << 18
#: Lengths below a limit that still count as cut there (to the last whole word, or stripped), and the stretch to either
#: side of it that shows how many texts would have such a length anyway.
NEAR, AROUND = 15, 64
#: Rate of cuts assumed away from limits, and its weight in texts, against what a source shows, and a source's rate
#: against what one of its languages shows.
RATE, RATE_WEIGHT = 0.03, 20.0
#: A length holds a limit if it has over so many times the texts that the lengths around let expect.
MANY = 5
#: Rate taken in the first rounds, in which only clear ends are to train the model: ends as observed are mixed with cuts,
#: so that at the true rate a cut would look no worse than even.
DOUBT, DOUBTING, ROUNDS = 0.3, 2, 5
#: White space (as Python has it) and broken characters, which behind the end of a text don't count.
BEHIND = "".join(c for c in map(chr, range(0x10000)) if c.isspace()) + "\ufffd"
_M = np.uint64(0x9E3779B97F4A7C15)
#: Classes of characters; punctuation stands for itself.
LOWER, UPPER, DIGIT, SPACE, BREAK, LETTER, START, CAPITALS = 1, 2, 3, 4, 5, 6, 7, 15


def _class_of(ch: str) -> int:
    if ch in "\n\r\x0b\x0c\x85":
        return BREAK
    if ch.isspace():
        return SPACE
    if ch.isdigit():
        return DIGIT
    if ch.isalpha():
        return UPPER if ch.isupper() else LOWER if ch.islower() or ch < "\u0400" else LETTER
    return LOWER if "\u0300" <= ch < "\u0370" else 0


_TABLE = np.array([_class_of(chr(c)) for c in range(0x400)], np.uint32)


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    h = (a ^ (np.asarray(b).astype(np.uint64) + _M)) * _M
    return h ^ (h >> np.uint64(29))


def _classify(x: np.ndarray) -> np.ndarray:
    cls = _TABLE[np.minimum(x, 0x3FF)]
    far = np.flatnonzero(x >= 0x400)
    if len(far):
        values, back = np.unique(x[far], return_inverse=True)
        cls[far] = np.array([_class_of(chr(v)) for v in values.tolist()], np.uint32)[back]
    cls[x == 0] = START
    return cls


class Lookup:
    """Where 64-bit keys stand in a sorted array without repeats, by open addressing on their first bits.

    Keys lie in their order, each in the slot its first bits name or, where that is taken, in the next free one; so a
    search goes on only over smaller keys.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        at = np.arange(len(keys))
        slot = np.maximum.accumulate((keys >> self.shift).astype(np.int64) - at) + at
        self.keys = np.full(max(1 << bits, int(slot[-1]) + 1 if len(slot) else 0) + 1, ~np.uint64(0))
        self.at = np.zeros(len(self.keys), np.int32)
        self.keys[slot], self.at[slot] = keys, at

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each key, and whether it is there at all."""
        i = (keys >> self.shift).astype(np.int64)
        there = self.keys[i]
        behind = np.flatnonzero(there < keys)
        while len(behind):
            i[behind] += 1
            there[behind] = self.keys[i[behind]]
            behind = behind[there[behind] < keys[behind]]
        return self.at[i], there == keys


class Positions:
    """Context keys at any position of some texts, which are laid one after the other with marks between."""

    def __init__(self, texts: list[str], sources: np.ndarray):
        pad = "\0" * (CHARS + 1)
        self.x = x = np.frombuffer((pad + pad.join(t.replace("\0", " ") for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, sizes = len(x), np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(sizes + len(pad)) - sizes
        self.last = self.first + sizes - 1
        self.source = np.repeat(sources.astype(np.uint64), sizes + len(pad))
        cls = _classify(x)
        letter = (cls == LOWER) | (cls == UPPER) | (cls == LETTER)
        self.blank = (cls == SPACE) | (cls == BREAK) | (cls == START)
        kind = np.where(letter, LOWER, np.where(cls == 0, x + np.uint32(16), cls))
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        self.token = np.cumsum(begin) - 1
        starts = np.flatnonzero(begin)
        upper = cls[starts] == UPPER
        shape = np.where(upper & (cls[np.minimum(starts + 1, n - 1)] == UPPER), CAPITALS, np.where(letter[starts], cls[starts], kind[starts])).astype(np.uint64)
        here = np.arange(len(shape))
        mark = np.maximum.accumulate(np.where(shape == START, here, 0))
        self.begin = starts
        # the last token may be unfinished: at its first character it shows but that one's class
        self.shape, self.opening = [], []
        for first, chain in ((shape, self.shape), (np.where(shape == CAPITALS, UPPER, shape).astype(np.uint64), self.opening)):
            h = np.zeros(len(shape), np.uint64)
            for m in range(SHAPES):
                h = _mix(h + np.uint64(m), shape[np.maximum(here - m, mark)] if m else first)
                chain.append(h)

    def keys(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """The KEYS arrays of context keys at the positions, in the order of `PARENT`."""
        t, source = self.token[at], self.source[at]
        opens = self.begin[t] == at
        shape = [np.where(opens, o[t], h[t]) for o, h in zip(self.opening, self.shape, strict=True)]
        root = _mix(source, 5)
        yield root
        for h in shape:
            yield _mix(h, root)
        yield np.full(len(at), 1, np.uint64)
        for h in shape:
            yield _mix(h, 7)
        h = _mix(shape[2], 11)
        for k in range(CHARS):
            h = _mix(h, self.x[np.maximum(at - k, 0)])
            yield h

    def known(self, inner: np.ndarray, find: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `find` has of the contexts at all positions marked by `inner`, and how many positions each is for.

        `find` gives a value for each key and whether it knows the key. A context is looked for only where it knows
        the one it extends, so that most positions are done after a few symbols. All positions of a token but its
        first have the same shape contexts, so these are looked for once a token.
        """
        opens = inner[self.begin]
        others = np.add.reduceat(inner, self.begin, dtype=np.int64) - opens
        first, later = np.flatnonzero(opens), np.flatnonzero(others)
        n = np.concatenate([np.ones(len(first), np.int64), others[later]])
        shape = [np.concatenate([o[first], h[later]]) for o, h in zip(self.opening, self.shape, strict=True)]
        root = _mix(self.source[self.begin[np.concatenate([first, later])]], 5)
        for base, above in ((root, root), (np.full(len(n), 1, np.uint64), np.full(len(n), 7, np.uint64))):
            value, hit = find(base)
            yield value[hit], n[hit]
            on = np.flatnonzero(hit)
            for depth, h in enumerate(shape):
                value, hit = find(_mix(h[on], above[on]))
                on = on[hit]
                yield value[hit], n[on]
                if depth == 2:
                    deep = on  # of all sources, last: the characters hang on these
        follow = np.zeros((2, len(self.begin)), bool)
        follow[1, first[deep[deep < len(first)]]] = True
        follow[0, later[deep[deep >= len(first)] - len(first)]] = True
        at = np.flatnonzero(inner)
        t = self.token[at]
        start = self.begin[t] == at
        keep = np.where(start, follow[1, t], follow[0, t])
        at, t, start = at[keep], t[keep], start[keep]
        h = _mix(np.where(start, self.opening[2][t], self.shape[2][t]), 11)
        for k in range(CHARS):
            h = _mix(h, self.x[np.maximum(at - k, 0)])
            value, hit = find(h)
            at, h = at[hit], h[hit]
            yield value[hit], np.ones(len(at), np.int64)


#: Bytes that only continue a character.
_REST = bytes(range(0x80, 0xC0))


def _torn_end(error: UnicodeError) -> tuple[str, int]:
    if isinstance(error, UnicodeDecodeError) and error.reason == "unexpected end of data":
        return "", len(error.object)
    raise error


codecs.register_error("torn end", _torn_end)


def repaired(text: str) -> str:
    """The text without entities, broken characters and signs inside words, and decoded again if its UTF-8 was taken for a
    one-byte code."""
    if "&" in text:
        text = html.unescape(text)
    if any(c in text for c in "\u00c3\u00c2\u00e2\u00d0\u00ce"):
        for code in ("cp1252", "latin-1"):
            try:  # a character may lack its beginning at the start, or its rest at the end
                text = text.encode(code).lstrip(_REST).decode("utf-8", "torn end")
                break
            except UnicodeError:
                pass
    if not text.isascii():
        stray = lambda i: 0 < i < len(text) - 1 and unicodedata.category(text[i]) in ("So", "Cf", "Sk")
        text = "".join(c for i, c in enumerate(text) if c.isalnum() or not stray(i) or not (text[i - 1].isalnum() or stray(i - 1)) or not (text[i + 1].isalnum() or stray(i + 1)))
    return text.replace("\ufffd", "e").replace("\u2019", "'")


def ending(text: str) -> tuple[str, str, str]:
    """The last characters of a text without white space and broken characters behind them; the same without the run of
    marks (neither letters nor digits nor white space) at the end; and that run."""
    end = text[-4 * TAIL :].rstrip(BEHIND)[-TAIL:]
    k = len(end)
    while k and not (end[k - 1].isalnum() or end[k - 1].isspace() or unicodedata.combining(end[k - 1])):
        k -= 1
    bare = end[:k].rstrip(BEHIND)
    return repaired(end), repaired(bare), end[k:] if bare else ""


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[slice]:
    """Slices of a batch of about `size` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    total, start = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size:
            yield slice(start, i + 1)
            total, start = 0, i + 1
    if start < len(lengths):
        yield slice(start, len(lengths))


#: What is kept of a text beside its end.
ABOUT = ("id", "code", "lang", "same", "n", "nb", "stray", "loose")


def _find_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            code = part.column("code").to_numpy()
            found = [ending(t) for t in part.column("tail").to_pylist()]
            out = []
            for which in (0, 1):
                p = Positions([x[which] for x in found], code)
                keys = np.stack(list(p.keys(np.maximum(p.last, p.first - 1))), axis=1).view(np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, KEYS), pa.int32()), pa.array(keys.ravel())))
            runs = pa.array([run or None for _, _, run in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ABOUT), runs, *out], names=[*ABOUT, "run", "keys", "bare"])


def _inner_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Positions, np.ndarray]]:
    """All texts, block by block, and a mark at every inner position."""
    for batch in batches:
        for part in _blocks(batch, BLOCK_CHARS):
            rows = batch.slice(part.start, part.stop - part.start)
            texts, sources, skips = [], [], []
            for text, code in zip(rows.column("text").to_pylist(), rows.column("code").to_pylist(), strict=True):
                text = text.rstrip()
                for i in range(0, len(text), PIECE):  # very long texts in pieces that overlap by what a context needs
                    texts.append(text[max(0, i - TAIL) : i + PIECE])
                    sources.append(code)
                    skips.append(min(i, TAIL))
            if not texts:
                continue
            p = Positions(texts, np.array(sources, np.int64).view(np.uint64))
            inner = ~p.blank
            inner[p.last] = False
            for first, skip in zip(p.first, skips, strict=True):
                inner[first : first + skip] = False
            yield p, inner


def _inner_counter(content):
    """Count the model's contexts at all inner positions of all texts, in one array per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = content.value
        lookup, total = Lookup(model), np.zeros(len(model))
        for p, inner in _inner_positions(batches):
            at, n = (np.concatenate(x) for x in zip(*p.known(inner, lookup.find), strict=True))
            total += np.bincount(at, n, len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model[seen].view(np.int64)), pa.array(total[seen].astype(np.int64))], names=["key", "n"])

    return count


def _inner_keys(content):
    """The contexts at all inner positions of all texts, counted block by block, where their first bits are a model's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = content.value
        sift = lambda keys: (keys, near[(keys >> np.uint64(64 - SIFT)).astype(np.int64)])
        for p, inner in _inner_positions(batches):
            for keys, n in p.known(inner, sift):
                found, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, n, len(found)).astype(np.int64))], names=["key", "n"])

    return run


class Model(NamedTuple):
    """Sorted context keys with how often each stands inside texts, ends whole texts, and is extended differently."""

    keys: np.ndarray
    inside: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray

    def facts(self, at: np.ndarray, hit: np.ndarray) -> list[np.ndarray]:
        """Those numbers for contexts (KEYS a row) found at `at`; 0, 0 and 1 where not `hit`."""
        if not len(self.keys):
            return [np.full(hit.shape, x) for x in (0.0, 0.0, 1.0)]
        return [np.where(hit, x[at], other) for x, other in ((self.inside, 0), (self.ends, 0.0), (self.kinds, 1))]


def _evidence(inside: np.ndarray, ends: np.ndarray, kinds: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Evidence that texts ended there, against having been cut there, by `facts` of their contexts (a row each).

    Going backward from the end, each symbol adds the log of its probability at ends over that inside texts, given the
    symbols behind it. Where ends show too little, the probability inside texts is the estimate, and the symbol adds
    nothing; how much is too little depends on how varied the continuations are. `weight` is what the text itself
    adds to the model and is taken out.
    """
    own = np.zeros(len(inside)) if weight is None else weight
    inside, ends, kinds = inside.astype(float), np.maximum(ends - own[:, None], 0.0), np.maximum(kinds, 1).astype(float)
    total = np.zeros(len(inside))
    step = lambda e, q, t, r, up: np.clip((e / np.minimum(q, 1) + t * r) / (up + t), 1e-4, 1e4)
    for j in range(SHAPES):
        s, g = j + 1, SHAPES + 2 + j
        q_all = (inside[:, g] + 0.5) / (inside[:, PARENT[g]] + 1)
        r_all = step(ends[:, g], q_all, kinds[:, PARENT[g]], 1.0, ends[:, PARENT[g]])
        q = (inside[:, s] + 2 * q_all) / (inside[:, PARENT[s]] + 2)
        total += np.log(step(ends[:, s], q, kinds[:, PARENT[s]], r_all, ends[:, PARENT[s]]))
    for c in range(2 * SHAPES + 2, KEYS):
        q = (inside[:, c] + 0.5) / (inside[:, PARENT[c]] + 1)
        total += np.log(step(ends[:, c], q, kinds[:, PARENT[c]], 1.0, ends[:, PARENT[c]]))
    return np.clip(total, -30, 30)


def _chance(odds: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The chance that each text is whole, by its log-odds and the rate of cuts among texts like it, `prior`; and how
    much likelier (in logs) its end is if texts of its length are cut as often as `given` than if cuts are as rare as
    anywhere, 0 where no rate is given."""
    rate, given = batch.column("prior").to_numpy(), pc.fill_null(batch.column("given"), RATE).to_numpy()
    ratio = np.exp(odds)
    return 1 / (1 + np.exp(-(odds + np.log((1 - rate) / rate)))), np.log((given + (1 - given) * ratio) / (RATE + (1 - RATE) * ratio))


#: What `_reestimate` gives: for contexts (no code) the sum of the chances that the texts they end are whole; for groups
#: (source and language, or texts at one limit) the sum of the chances to be cut, the texts that train, all with their
#: copies, and how much likelier their ends are with the limit than without.
SUMS = "key long, code long, a double, b double, c double, d double"


def _reestimate(content):
    """`SUMS` of one task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = content.value
        lookup, ends, names = Lookup(model.keys), np.zeros(len(model.keys)), ["key", "code", "a", "b", "c", "d"]
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().view(np.uint64).reshape(-1, KEYS)
            at, hit = lookup.find(keys.ravel())
            whole, gain = _chance(_evidence(*model.facts(at.reshape(keys.shape), hit.reshape(keys.shape)), batch.column("weight").to_numpy()), batch)
            ends += np.bincount(at[hit], np.repeat(whole, KEYS)[hit], len(ends))
            group, first, which = np.unique(batch.column("grp").to_numpy(), return_index=True, return_inverse=True)
            sums = (np.bincount(which, w, len(group)) for w in (1 - whole, None, batch.column("copies").to_numpy(), gain))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(batch.column("code").to_numpy()[first]), *(pa.array(x.astype(float)) for x in sums)], names=names)
        some = np.flatnonzero(ends)
        none = np.zeros(len(some))
        yield pa.RecordBatch.from_arrays([pa.array(model.keys[some].view(np.int64)), pa.nulls(len(some), pa.int64()), pa.array(ends[some]), *[pa.array(none)] * 3], names=names)

    return run


def _score(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = content.value
        lookup = Lookup(model.keys)
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().view(np.uint64).reshape(-1, KEYS)
            at, hit = lookup.find(keys.ravel())
            whole, _ = _chance(_evidence(*model.facts(at.reshape(keys.shape), hit.reshape(keys.shape)), batch.column("weight").to_numpy()), batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("same"), pa.array(whole)], names=["id", "same", "whole"])

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chance that each text is whole, by what `_looked_up` found of its contexts."""
    for batch in batches:
        known = batch.column("known")
        row, flat = pc.list_parent_indices(known).to_numpy(), known.flatten()
        at = row, flat.field("at").to_numpy()
        facts = [np.full((batch.num_rows, KEYS), x) for x in (0.0, 0.0, 1.0)]
        for values, name in zip(facts, ("inside", "ends", "kinds"), strict=True):
            values[at] = flat.field(name).to_numpy()
        whole, gain = _chance(_evidence(*facts, batch.column("weight").to_numpy()), batch)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(whole), pa.array(gain)], names=["row", "whole", "gain"])


def _rates(sums: DataFrame) -> DataFrame:
    """(grp, rate, texts) of `SUMS`: the rate of cuts of each source and language, drawn to its source's, and that to
    the general one. It is null for texts at a limit, which have theirs by length, if their ends are likelier with the
    limit; if not, so many texts are of that length for another reason, and they are a group like others."""
    of = W.partitionBy("code")  # the languages of a source, by two letters, and its limits
    away = lambda x: F.coalesce(F.sum(F.when(F.col("d") <= 0, F.col(x))).over(of), F.lit(0.0))
    source = (RATE * RATE_WEIGHT + away("a")) / (RATE_WEIGHT + away("b"))
    rate = F.least(F.greatest((F.col("a") + RATE_WEIGHT * source) / (F.col("b") + RATE_WEIGHT), F.lit(0.002)), F.lit(0.9))
    return sums.where("code is not null").select(F.col("key").alias("grp"), F.when(F.col("d") <= 0, rate).alias("rate"), F.col("c").cast("long").alias("texts"))


def _with_prior(texts: DataFrame, rates: DataFrame | None, total: int, groups: int | None = None) -> DataFrame:
    """The texts with `prior`, the rate of cuts among texts like them: by their length, else by their group (of which
    there are `groups`, if that is known)."""
    if rates is None:
        return texts.withColumn("prior", F.coalesce("given", F.lit(DOUBT)))
    return join_hot(texts, rates, "grp", "texts", total, F.col("row"), size=groups).withColumn("prior", F.coalesce("rate", "given", F.lit(RATE)))


def _looked_up(texts: DataFrame, table: DataFrame, hot: int) -> DataFrame:
    """The texts with `known`: (at, inside, ends, kinds) of those of their contexts that the table has.

    Contexts that end at least `hot` texts are joined by broadcast, so no key has many rows in the shuffle.
    """
    is_hot, facts = F.col("n") >= hot, F.struct("inside", "ends", "kinds").alias("f")
    each = texts.select("row", F.posexplode("keys").alias("at", "key")).join(F.broadcast(table.where(is_hot).select("key", facts)), "key", "left")
    rest = each.where("f is null").drop("f").join(table.where(~is_hot).select("key", facts), "key")
    found = each.where("f is not null").unionByName(rest)
    known = found.groupBy("row").agg(F.collect_list(F.struct(F.col("at"), F.col("f.inside"), F.col("f.ends"), F.col("f.kinds"))).alias("known"))
    return texts.join(known, "row", "left")


def _scored_by_table(base: DataFrame, train: DataFrame, ends: DataFrame, contexts: DataFrame, start: Column, n: int) -> DataFrame:
    """(id, same, whole) with the model (key, n, w, kinds) as a table: the same as with a broadcast one, by joins."""
    spark, hot = base.sparkSession, n // HOT + 1
    table = written(contexts)
    first = table.select(F.shiftrightunsigned("key", 64 - SIFT).cast("int").alias("first")).distinct().toArrow().column("first").to_numpy()
    near = np.zeros(1 << SIFT, bool)
    near[first] = True
    content = spark.sparkContext.broadcast(near)
    inner = base.select("code", "text").mapInArrow(_inner_keys(content), "key long, n long").groupBy("key").agg(F.sum("n").alias("inside"))
    facts = written(table.join(inner, "key", "left").select("key", "n", "w", F.col("kinds").cast("double").alias("kinds"), F.coalesce("inside", F.lit(0)).cast("double").alias("inside")))
    model, rates, old = facts.withColumn("ends", F.col("w")), None, []
    weigh = lambda texts, weight: written(_looked_up(_with_prior(texts, rates, n).withColumn("weight", weight), model, hot).select("row", "known", "given", "prior", "weight").mapInArrow(_weigh, "row long, whole double, gain double"))
    for step in range(ROUNDS):
        weighed = weigh(train, start if step == 0 else F.lit(1.0))
        both = train.join(weighed, "row")
        of = written(both.select(F.explode("keys").alias("key"), "whole").groupBy("key").agg(F.sum("whole").alias("ends")))
        model = written(facts.join(of, "key", "left").select("key", "n", "kinds", "inside", F.coalesce("ends", F.lit(0.0)).alias("ends")))
        sums = written(both.groupBy(F.col("grp").alias("key"), "code").agg(F.sum(1 - F.col("whole")).alias("a"), F.count("*").cast("double").alias("b"), F.sum("copies").alias("c"), F.sum("gain").alias("d")))
        rates = _rates(sums) if step >= DOUBTING - 1 else None
        for x in old:
            discard(x)
        old = [weighed, of, model, sums]
    return ends.select("row", "id", "same").join(weigh(ends, F.lit(1.0)), "row").select("id", "same", "whole")


def limits(ends: DataFrame) -> DataFrame:
    """(code, unit, size, limit, rate, texts): the lengths, in characters (unit 0) or bytes (1), at which a source cuts,
    where its lengths show some, a number for the limit and for whether it is reached, the share of cuts among the texts
    of each such length, and how many rows those are.

    Looked for are lengths L at which, or up to which within `NEAR` below, stand far more different texts than the
    stretches to both sides let expect. The excess of a single length gives its share; lengths below L have at least
    that of all of them together, their most frequent one left out, as cuts at whole words are spread over many
    lengths. A source cuts in the unit that shows the greatest excess, and may have several limits more than `NEAR`
    apart. A text of no known source (`stray`) is taken as any text of such a length, from all sources together.
    Lengths are counted first, so windows go over different lengths of a source only.
    """
    texts = ends.groupBy("code", "stray", "same", "n", "nb").agg(F.count("*").alias("copies"))
    each = texts.select("code", "stray", "copies", F.inline(F.array(F.struct(F.lit(0).alias("unit"), F.col("n").alias("size")), F.struct(F.lit(1).alias("unit"), F.col("nb").alias("size")))))
    counted = written(each.groupBy("code", "stray", "unit", "size").agg(F.count("*").alias("c"), F.sum("copies").alias("texts")))
    own = counted.where("not stray").drop("stray")
    w = W.partitionBy("code", "unit").orderBy("size")
    within = lambda f, a, b: F.coalesce(f("c").over(w.rangeBetween(a, b)), F.lit(0))
    around = own.select("code", "unit", "size", "c", within(F.sum, -NEAR, -1).alias("near"), within(F.max, -NEAR, -1).alias("peak"), within(F.sum, -NEAR - AROUND, -NEAR - 1).alias("before"), within(F.sum, 1, AROUND).alias("after"))
    per = F.greatest(F.col("before"), F.col("after")) / AROUND  # texts a length
    here = F.col("c") + F.col("near")
    spike = F.when((F.col("c") > MANY) & (F.col("c") >= MANY * F.greatest(per, F.col("near") / NEAR) + 3), F.col("c") - per).otherwise(0.0)
    ramp = F.when((here > MANY) & (here >= (MANY + 1) * ((NEAR + 1) * per + 1)), here - (NEAR + 1) * per).otherwise(0.0)
    share = lambda n, expected: F.least(F.greatest(F.when(n > 0, 1 - (expected + F.sqrt(expected)) / n).otherwise(0.0), F.lit(RATE)), F.lit(0.998))
    density = F.greatest(F.col("before") / AROUND, F.lit(0.05))
    clear = around.withColumn("excess", F.greatest(spike, ramp)).where("excess > 0")
    unit = F.first("unit").over(W.partitionBy("code").orderBy(F.desc("excess"), "unit", "size"))
    most = F.max(F.struct("excess", -F.col("size"))).over(w.rangeBetween(-NEAR, NEAR))
    clear = clear.withColumn("best", unit).withColumn("most", most).where((F.col("best") == F.col("unit")) & (F.col("most") == F.struct("excess", -F.col("size"))))
    clear = clear.select("code", "unit", F.col("size").alias("most"), density.alias("density"), share(F.col("near") - F.col("peak"), (NEAR - 1) * density).alias("spread"))
    lengths = own.join(clear, ["code", "unit"]).where(F.col("size").between(F.col("most") - NEAR, F.col("most")))
    alone = share(F.col("c"), F.col("density"))
    lengths = lengths.withColumn("rate", F.when(F.col("size") == F.col("most"), alone).otherwise(F.greatest(alone, F.col("spread"))))
    limit = F.xxhash64("code", "unit", "most", F.col("size") == F.col("most"))
    found = written(lengths.groupBy("code", "unit", "size").agg(F.max_by(limit, "rate").alias("limit"), F.max("rate").alias("rate"), F.max("texts").alias("texts")))
    any_source = own.join(found.select("code", "unit", "size", "rate"), ["code", "unit", "size"], "left").groupBy("unit", "size").agg((F.sum(F.col("c") * F.coalesce("rate", F.lit(RATE))) / F.sum("c")).alias("rate"), F.count("rate").alias("k")).where("k > 0").drop("k")
    return found.unionByName(counted.where("stray").join(any_source, ["unit", "size"]).select("code", "unit", "size", F.xxhash64("code", "unit", F.lit(-1)).alias("limit"), "rate", "texts"))


def _placed(raw: DataFrame, n: int) -> DataFrame:
    """(row, id, code, grp, same, given, keys): the ends, with the chance to be cut that a text's length gives, if any.

    At a limit, it is weighed with white space at the end of the field, which cuts have more often or less; and a run
    of marks at the end that cuts at limits have more often than other texts (points or an ellipsis, say) was put
    behind the cut, so what is before it counts. Both are estimated from all texts.
    """
    known = written(limits(raw))
    size_of, placed = known.count(), raw
    for unit, size in ((0, "n"), (1, "nb")):
        table = known.where(F.col("unit") == unit).select(F.xxhash64("code", "size").alias("slot"), F.struct("rate", "limit").alias(f"at_{unit}"), "texts")
        placed = join_hot(placed.withColumn("slot", F.xxhash64("code", size)), table, "slot", "texts", n, F.col("row"), size=size_of).drop("slot")
    at = F.coalesce("at_0", "at_1")
    placed = placed.withColumns({"rate": at["rate"], "limit": at["limit"]}).drop("at_0", "at_1")
    cut, whole = F.coalesce("rate", F.lit(0.0)), 1 - F.coalesce("rate", F.lit(RATE))
    share = lambda x: (F.sum(F.when(F.col("loose"), x).otherwise(0.0)) + 1) / (F.sum(x) + 2)
    loose = placed.agg(share(cut).alias("cut"), share(whole).alias("whole"), F.sum(cut).alias("n_cut"), F.sum(whole).alias("n_whole")).first()
    p, q = (x if x else 0.5 for x in (loose["cut"], loose["whole"]))
    odds = F.col("rate") / (1 - F.col("rate")) * F.when(F.col("loose"), p / q).otherwise((1 - p) / (1 - q))
    marks = placed.where("run is not null").groupBy("run").agg(F.sum(cut).alias("a"), F.sum(whole).alias("b"), F.count("*").alias("texts"))
    marks = written(marks.where(F.col("a") * F.lit((loose["n_whole"] or 0.0) + 1) > (F.col("b") + 1) * F.lit((loose["n_cut"] or 0.0) + 1)).select("run", F.lit(True).alias("put"), "texts"))
    placed = join_hot(placed.withColumn("given", odds / (1 + odds)), marks, "run", "texts", n, F.col("row"), size=marks.count())
    keys = F.when((F.col("given") > 0.5) & F.col("put"), F.col("bare")).otherwise(F.col("keys"))
    return placed.select("row", "id", "code", F.coalesce("limit", F.xxhash64("code", "lang")).alias("grp"), "same", "given", keys.alias("keys"))


def _language(lang: Column) -> Column:
    return F.coalesce(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit(""))


def truncated_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(id, whole, truncated): every text that is not null or blank, the chance that it is whole, and the verdict.

    A backward n-gram model (word shapes within the source and over all, characters below them) compares how likely a
    text's last symbols are at an end and inside texts. Counts cover all texts and all positions. The ends are mixed
    with cuts, so they are weighed by the chance of being whole, in `ROUNDS` rounds, together with the rate of cuts of
    each source and language, which sets the threshold of the log-odds. For texts as long as a limit of their source,
    or just shorter, the rate is the excess of such lengths, if the ends of all texts at that limit bear it out. Copies within a source, alike but for white space and
    broken characters at the end, which don't count, train the model once. All copies of a text get the verdict cut if
    one does.

    A null source or language is one of its own. Contexts that end `LEAST` texts are kept, at every size. Rates and
    limits are tables, joined to the texts. The driver holds a model of at most KEYS * CAPACITY contexts; a larger one
    stays a table too.
    """
    spark = docs.sparkSession
    ship(spark)
    trimmed = F.rtrim(F.col(text), F.lit(BEHIND))
    base = docs.where(F.col(text).isNotNull() & (trimmed != "")).select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(source).cast("string")).alias("code"), _language(F.col(lang)).alias("lang"), F.md5(trimmed.cast("binary")).alias("same"), F.length(text).cast("long").alias("n"), F.octet_length(text).cast("long").alias("nb"), F.col(source).isNull().alias("stray"), F.substring(text, -1, 1).rlike(r"\s").alias("loose"), F.col(text).alias("text")
    )
    id_type = base.schema["id"].dataType.simpleString()
    tails = base.select(*ABOUT, F.substring(F.rtrim("text", F.lit(BEHIND)), -4 * TAIL, 4 * TAIL).alias("tail"))
    kinds = f"id {id_type}, code long, lang string, same string, n long, nb long, stray boolean, loose boolean, run string, keys array<long>, bare array<long>"
    raw = written(tails.mapInArrow(_find_ends, kinds).withColumn("row", F.monotonically_increasing_id()))
    n = raw.count()
    ends = written(_placed(raw, n))
    one = F.struct("row", "grp", "given", "keys")
    train = written(ends.groupBy("code", "same").agg(F.min_by(one, "row").alias("f"), F.count("*").alias("copies")).select("code", "f.*", "copies"))

    parents = F.array(*[F.lit(p) for p in PARENT])
    pair = F.transform("keys", lambda k, i: F.struct(k.alias("key"), F.when(F.get(parents, i) >= 0, F.get("keys", F.get(parents, i))).alias("parent")))
    start = 1 - F.coalesce("given", F.lit(RATE))
    seen = written(train.select(F.inline(pair), start.alias("w")).groupBy("key").agg(F.max("parent").alias("parent"), F.count("*").alias("n"), F.sum("w").alias("w")))
    kinds = seen.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kinds"))
    kept = seen.where(F.col("n") >= LEAST)
    contexts = kept.join(kinds, "key", "left").select("key", "n", "w", F.coalesce("kinds", F.lit(0)).alias("kinds"))
    way = _scored_by_table if kept.count() > KEYS * CAPACITY else _scored_by_broadcast
    scored = written(way(base, train, ends, contexts, start, n))
    torn = scored.groupBy("same").agg(F.min("whole").alias("least"), F.max("whole").alias("most"), F.count("*").alias("texts")).where("least < 0.5 and most >= 0.5").select("same", F.lit(True).alias("torn"), "texts")
    torn = written(torn)
    both = join_hot(scored, torn, "same", "texts", n, F.col("id"), size=torn.count())
    return both.select("id", "whole", ((F.col("whole") < 0.5) | F.coalesce("torn", F.lit(False))).alias("truncated"))


def _scored_by_broadcast(base: DataFrame, train: DataFrame, ends: DataFrame, contexts: DataFrame, start: Column, n: int) -> DataFrame:
    """(id, same, whole) with the model (key, n, w, kinds) in the driver and every worker."""
    spark = base.sparkSession
    table = contexts.select("key", "w", "kinds").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], np.zeros(len(keys), np.int64), table.column("w").to_numpy()[order], table.column("kinds").to_numpy()[order])

    def placed(keys: pa.ChunkedArray, values: pa.ChunkedArray) -> np.ndarray:
        out = np.zeros(len(model.keys))
        out[np.searchsorted(model.keys, keys.to_numpy().view(np.uint64))] = values.to_numpy()
        return out

    content = spark.sparkContext.broadcast(model.keys)
    inner = base.select("code", "text").mapInArrow(_inner_counter(content), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    model, rates, groups, old = model._replace(inside=placed(inner.column("key"), inner.column("n"))), None, None, None
    content.unpersist()
    for step in range(ROUNDS):
        content = spark.sparkContext.broadcast(model)
        weighed = _with_prior(train, rates, n, groups).select("code", "grp", "given", "prior", "keys", "copies", (start if step == 0 else F.lit(1.0)).alias("weight"))
        sums = written(weighed.mapInArrow(_reestimate(content), SUMS).groupBy("key", "code").agg(*[F.sum(x).alias(x) for x in "abcd"]))
        of = sums.where("code is null").select("key", "a").toArrow()
        model = model._replace(ends=placed(of.column("key"), of.column("a")))
        groups = groups or sums.where("code is not null").count()  # the same in all rounds
        rates = _rates(sums) if step >= DOUBTING - 1 else None
        if old is not None:
            discard(old)
        old = sums
        content.unpersist()

    content = spark.sparkContext.broadcast(model)
    texts = _with_prior(ends, rates, n, groups).select("id", "same", "given", "prior", "keys", F.lit(1.0).alias("weight"))
    return texts.mapInArrow(_score(content), f"id {ends.schema['id'].dataType.simpleString()}, same string, whole double")


def truncation_rates(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(source, texts, truncated, rate): how often each source truncates, of all its rows; a null source is one too.

    `found` is (id, truncated), matched on the id.
    """
    cut = found.where("truncated").select(F.col("id").alias("_id"), F.lit(1).alias("cut"))
    per = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("_id")).join(cut, "_id", "left").groupBy("source").agg(F.count("*").alias("texts"), F.count("cut").alias("truncated"))
    return per.withColumn("rate", F.round(F.col("truncated") / F.col("texts"), 6))
