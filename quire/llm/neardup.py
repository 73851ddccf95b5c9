"""Problem 4: passages that are the same but for small edits.

Each repaired text becomes the set of its distinct three-word sequences. Texts
with equal word sequences are one class; only one text of a class goes on. Every
sequence is counted exactly over the corpus, which gives one global order, rarest
first; sequences of one set alone are left out of what is sent, but keep their
places. The sequences are cut into stripes by hash, those of crowded sets into
stripes of their own. A set goes once to each stripe it enters within its prefix,
with the part of its sequences that lies there, in the global order, and a stripe
keeps its sets in a trie. Sets below one node share the overlap of its path and
meet there once; nodes of equal sequences on other paths meet as nodes, and a pair
of nodes is cut, with all sets below, when the sizes or the most that still
remains below them forbid the threshold. A signature of the whole set bounds the
overlap of what is left, and the sets of the remaining pairs are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm import scans
from quire.session import durable, forget, pairs_within, sized_broadcast, spread, stored

#: Sequences of one counting task, and of one stripe, about.
COUNT_GRAMS, STRIPE_GRAMS = 4_000_000, 2_000_000
#: Sets of one sequence that make a block; more sets make more blocks.
CROWD = 20_000
#: Pairs formed at once in a stripe.
AT_ONCE = 2_000_000
#: Misread words that are sent to all tasks as one dictionary (about 100 bytes each); more are joined to their texts.
DICTIONARY = 200_000
#: Words of 64 bits of a set's signature.
SIGNATURE = 4
#: Candidates of one set that are compared in one group; more make more groups.
CANDIDATES = 5_000


def repaired(plain: Column) -> Column:
    """A text in one character form as problem 2 leaves it, for comparison: no page lines, no cuts; ``passages`` corrects misread words."""
    lines = F.filter(F.split(plain, r"\r?\n"), lambda x: ~(F.trim(x).rlike(scans.PAGE_LINE) | scans.head_like(F.trim(F.regexp_replace(F.trim(x), scans.TAIL, "")))))
    kept = F.when(plain.contains("\n"), F.array_join(lines, "\n")).otherwise(plain)
    return scans.join_cuts(kept)


class _Blanks(dict):
    """Translation table: lower-case letters, digits and ``_`` stay, anything else is a blank."""

    def __missing__(self, code: int) -> int:
        ch = chr(code)
        self[code] = code if ch.isalnum() or ch == "_" else 32
        return self[code]


def _word_hash(word: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _units(min_words: int, n: int, fixes):
    """Batches of (id, text) to one row (ids, class_ids, sizes, grams) for each; ``fixes`` corrects words on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        blanks, good = _Blanks(), fixes.value if fixes else {}
        for batch in batches:
            if len(cache) > 500_000:
                cache.clear()
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            keep, lengths, flat = [], [], []
            for i, text in enumerate(texts):
                words = text.lower().translate(blanks).split() if text else []
                if len(words) < min_words:
                    continue
                keep.append(i)
                lengths.append(len(words))
                for w in words:
                    h = cache.get(w)
                    if h is None:
                        h = cache[w] = _word_hash(good.get(w, w))
                    flat.append(h)
            if not keep:
                continue
            h = np.array(flat, dtype=np.uint64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            g = h[: len(h) - n + 1].copy() if len(h) >= n else np.empty(0, np.uint64)
            for k in range(1, n):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            g = (_mix(g) >> np.uint64(32)).astype(np.uint32)
            whole = np.add.reduceat(_mix(h + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(h)) - np.repeat(starts, lengths)).astype(np.uint64)), starts)
            sets = [np.unique(g[a : max(a, b - n + 1)]) for a, b in zip(starts, ends)]
            at = pa.array([0, len(keep)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(at, ids.take(pa.array(keep))), pa.ListArray.from_arrays(at, pa.array(whole.view(np.int64))),
                    pa.array([np.array([len(x) for x in sets], np.int32).tobytes()], pa.binary()), pa.array([np.concatenate(sets).tobytes()], pa.binary()),
                ],
                names=["ids", "class_ids", "sizes", "grams"],
            )

    return run


def gram_sets(df: DataFrame, id_col: str, text: str, min_words: int = 24, n: int = 3, fixes=None) -> DataFrame:
    """(unit, ids, class_ids, sizes, grams), written once: the distinct n-word sequences of each text of enough words.

    A unit is what one batch of texts gave: the sets lie one behind the other in
    ``grams`` as 32-bit hashes, in ascending order. Case, punctuation and spacing
    do not count. ``class_ids`` are equal for equal word sequences. ``fixes`` is a
    broadcast dictionary of misread words. Null, empty and shorter texts give no set.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id is not null")
    kind = df.schema[id_col].dataType.simpleString()
    out = source.mapInArrow(_units(min_words, n, fixes), f"ids array<{kind}>, class_ids array<long>, sizes binary, grams binary")
    # Units are numbered without gaps once the table is written: by the place in a task after all earlier tasks' units.
    table = stored(out.withColumn("place", F.monotonically_increasing_id()))
    task, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for t, k in sorted((r["task"], r["k"]) for r in table.groupBy(task.alias("task")).agg(F.count("*").alias("k")).collect()):
        starts.append((t, total))
        total += k
    numbered = table.withColumn("task", task).join(F.broadcast(df.sparkSession.createDataFrame(starts, "task long, start long")), "task")
    return numbered.select((F.col("start") + place).alias("unit"), "ids", "class_ids", "sizes", "grams")


def members_of(units: DataFrame) -> DataFrame:
    """(id, class_id, row) of every set; ``row`` is the unit's number and the place in it."""
    each = units.select("unit", F.posexplode(F.arrays_zip("ids", "class_ids")).alias("at", "m"))
    return each.select(F.col("m.ids").alias("id"), F.col("m.class_ids").alias("class_id"), (F.shiftleft("unit", 16) + F.col("at")).alias("row"))


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units to (row, class_id, grams)."""
    for b in batches:
        for unit, classes_, sizes, grams in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
            sizes = np.frombuffer(sizes, np.int32)
            at = pa.array(np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32))
            rows = (unit << 16) + np.arange(len(sizes))
            sets = pa.Array.from_buffers(pa.binary(), len(sizes), [None, at.buffers()[1], pa.py_buffer(grams)])
            yield pa.RecordBatch.from_arrays([pa.array(rows), classes_.values, sets], names=["row", "class_id", "grams"])


# ---------------------------------------------------------------- the global order


def _small(x: np.ndarray) -> np.ndarray:
    """The array in the least width that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one string, each in the least width."""
    out = []
    for x in map(_small, arrays):
        out += [np.array([x.itemsize, len(x)], np.int64).tobytes(), x.tobytes()]
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, n = np.frombuffer(data, np.int64, 2, at)
        out.append(np.frombuffer(data, f"u{width}", int(n), at + 16))
        at += 16 + int(width * n)
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Ascending numbers as 16-bit steps; 65535 stands for a step on that gives no number."""
    step = np.diff(sorted_.astype(np.int64), prepend=0)
    more = step // 65535
    out = np.full(len(step) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more) + np.arange(len(step))] = step % 65535
    return out


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.int64))[steps != 65535].astype(np.uint32)


def _edges(parts: int) -> np.ndarray:
    """Where each part of the hash space begins, and the end."""
    return np.array([-(-(k << 32) // parts) for k in range(parts + 1)], np.int64)


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in ascending order: 0 for one, exact to 128, then eight steps for each doubling."""
    far = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128)).astype(np.int64)
    return np.where(counts <= 128, counts - 1, np.minimum(far, 255)).astype(np.uint8)


def _offers(parts: int):
    """Units to (part, unit, offer): the distinct sequences of each part of the hash space and how many sets hold each."""

    def run(batches):
        edges = _edges(parts)
        for b in batches:
            for unit, grams in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, n = np.unique(np.frombuffer(grams, np.uint32), return_counts=True)
                cut = np.searchsorted(u, edges)
                offers = [zlib.compress(_pack(n[i:j]), 1) for i, j in zip(cut, cut[1:])]
                steps = [_steps(u[i:j]).tobytes() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([unit] * parts), pa.array(steps), pa.array(offers)], names=["part", "unit", "steps", "counts"])

    return run


def _held(code: np.ndarray) -> np.ndarray:
    """The most sets that a code stands for."""
    return np.where(code < 128, code + 1, np.ceil(128 * 2.0 ** ((code - 127) / 8))).astype(np.int64)


def _stripe(grams: np.ndarray, codes: np.ndarray, stripes: int) -> np.ndarray:
    """The stripe of each sequence; those of more than ``CROWD`` sets have stripes of their own."""
    return (grams.astype(np.int64) * stripes >> 32) + np.where(_held(codes.astype(np.int64)) > CROWD, stripes, 0)


def _replies(stripes: int):
    """The codes of one part's sequences back to each unit, in ascending order of the sequences; unit -1 gets the highest code of each stripe."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        offers = [_from_steps(np.frombuffer(s, np.uint16)) for s in pdf["steps"]]
        counts = [_unpack(zlib.decompress(c))[0].astype(np.int64) for c in pdf["counts"]]
        grams, back = np.unique(np.concatenate(offers), return_inverse=True)
        codes = _code(np.bincount(back, np.concatenate(counts), len(grams)).astype(np.int64))
        out, at = [], 0
        for o in offers:
            out.append(zlib.compress(codes[back[at : at + len(o)]].tobytes(), 1))
            at += len(o)
        most = np.zeros(2 * stripes, np.uint8)
        np.maximum.at(most, _stripe(grams, codes, stripes), codes)
        return pd.DataFrame({"unit": [*pdf["unit"], -1], "part": int(key[0]), "reply": [*out, zlib.compress(most.tobytes(), 1)]})

    return run


def _signatures(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bit for each sequence of a set, by hash."""
    bit = (_mix(flat.astype(np.uint64)) % np.uint64(64 * SIGNATURE)).astype(np.int64)
    out = np.zeros(len(sizes) * SIGNATURE, np.uint64)
    np.bitwise_or.at(out, np.repeat(np.arange(len(sizes)), sizes) * SIGNATURE + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _enter(stripes: int, blocks: np.ndarray, part: int, of: int):
    """One unit with its replies to (stripe, pair, unit, entries): what its sets hold of each stripe within their prefixes."""

    def run(key: tuple, units: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for unit, sizes, grams in zip(units["unit"], units["sizes"], units["grams"]):
            sizes, flat = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(grams, np.uint32)
            told = replies[replies["part"] >= 0].sort_values("part")
            codes = np.frombuffer(b"".join(zlib.decompress(r) for r in told["reply"]), np.uint8)
            _, back = np.unique(flat, return_inverse=True)
            code = codes[back].astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, code, row))
            gram, code = flat[order].astype(np.int64), code[order]
            at = np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]
            # A partner of overlap >= part/of of the union overlaps at least part/of of this set;
            # beyond this prefix there are too few sequences left to make up for sharing none in it.
            keep = (at < (sizes - -(-sizes * part // of) + 1)[row]) & (code > 0)
            for r in replies.loc[replies["part"] == -1, "reply"]:
                keep &= ~np.isin(row, np.frombuffer(r, np.int64) & 0xFFFF)
            gram, code, row, at = gram[keep], code[keep], row[keep], at[keep]
            if not len(row):
                continue
            signed = _signatures(flat, sizes).reshape(-1, SIGNATURE)
            place = _stripe(gram, code, stripes)
            order = np.lexsort((np.arange(len(row)), row, place))
            gram, row, at, place = gram[order], row[order], at[order], place[order]
            fresh = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            length = np.diff(np.append(fresh, len(row)))
            where, who = place[fresh], row[fresh]
            for r in np.unique(where):
                mine = np.flatnonzero(where == r)
                parts = int(blocks[r])
                own = (_mix(((int(unit) << 16) + who[mine]).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                for other in range(parts):
                    pair = np.minimum(own, other) << 20 | np.maximum(own, other)
                    for p in np.unique(pair):
                        sel = mine[pair == p]
                        body = np.repeat(fresh[sel] - (np.cumsum(length[sel]) - length[sel]), length[sel]) + np.arange(int(length[sel].sum()))
                        out.append((int(r), int(p), int(unit), _pack(who[sel], sizes[who[sel]], at[body], length[sel], own[pair == p], gram[body], signed[who[sel]].ravel())))
        return pd.DataFrame(out, columns=["stripe", "pair", "unit", "entries"])

    return run


# ---------------------------------------------------------------- the trie of a stripe


class Trie:
    """Segments in a prefix tree, level by level; a node knows the sets below it and their bounds.

    ``seq`` is a node's sequence, ``root`` the first node on its path; ``low`` and
    ``high`` are the least and greatest size below it and ``rest`` the most
    sequences that remain from it on. ``below(u)`` are the postings of its sets.
    """

    def __init__(self, length: np.ndarray, items: np.ndarray, size: np.ndarray, at: np.ndarray):
        first = np.cumsum(length) - length
        self.entry, self.at = np.repeat(np.arange(len(length)), length), at
        node = np.empty(len(items), np.int64)
        live, above, nodes, depth = np.arange(len(length)), np.zeros(len(length), np.int64), 0, 0
        while len(live := live[length[live] > depth]):
            here = first[live] + depth
            _, now = np.unique(above[live] << 32 | items[here], return_inverse=True)
            now = now + nodes
            node[here], above[live] = now, now
            nodes, depth = int(now.max()) + 1, depth + 1
        order = np.argsort(node, kind="stable")
        self.postings = order
        self.begin = np.searchsorted(node[order], np.arange(nodes + 1))
        if nodes:
            left, sizes = (size[self.entry] - self.at)[order], size[self.entry][order]
            self.seq, self.root = items[order[self.begin[:-1]]], node[first[self.entry[order[self.begin[:-1]]]]]
            self.low, self.high = np.minimum.reduceat(sizes, self.begin[:-1]), np.maximum.reduceat(sizes, self.begin[:-1])
            self.rest = np.maximum.reduceat(left, self.begin[:-1])
        else:
            self.seq = self.root = self.low = self.high = self.rest = np.empty(0, np.int64)

    def meetings(self, part: int, of: int):
        """Pairs of postings of two sets that share a sequence there and may reach the threshold, each path's sets once."""
        count = np.diff(self.begin)
        # Sets below one node on the first level: their path is shared.
        top = np.flatnonzero((self.root == np.arange(len(self.root))) & (count > 1) & self._may(np.arange(len(self.root)), np.arange(len(self.root)), part, of))
        inside = np.repeat(top, count[top])
        place = np.arange(len(inside)) - np.repeat(np.cumsum(count[top]) - count[top], count[top])
        for i, k in _runs(count[inside] - place - 1):
            x = self.begin[inside[i]] + place[i]
            yield self.postings[x], self.postings[x + k]
        # Nodes of one sequence on other paths.
        order = np.argsort(self.seq, kind="stable")
        seq = self.seq[order]
        end = np.searchsorted(seq, seq, "right")
        for i, k in _runs(end - np.arange(len(seq)) - 1):
            u, v = order[i], order[i + k]
            keep = (self.root[u] != self.root[v]) & self._may(u, v, part, of)
            u, v = u[keep], v[keep]
            for j, k2 in _runs(count[u] * count[v], 0):
                a, b = u[j], v[j]
                yield self.postings[self.begin[a] + k2 // count[b]], self.postings[self.begin[b] + k2 % count[b]]

    def _may(self, u: np.ndarray, v: np.ndarray, part: int, of: int) -> np.ndarray:
        """Whether some two sets below the nodes may reach the threshold, by their sizes and what remains."""
        fits = (np.minimum(self.high[u], self.high[v]) * of >= np.maximum(self.low[u], self.low[v]) * part)
        return fits & (np.minimum(self.rest[u], self.rest[v]) * (part + of) >= (self.low[u] + self.low[v]) * part)


def _runs(lengths: np.ndarray, base: int = 1):
    """(index, step) for ``base`` to ``base + length - 1`` of every index, in pieces of bounded size."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        n = lengths[start:stop]
        index = np.repeat(np.arange(start, stop), n)
        step = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + base
        for at in range(0, len(index), 4 * AT_ONCE):
            yield index[at : at + 4 * AT_ONCE], step[at : at + 4 * AT_ONCE]
        start = stop


def _met(part: int, of: int):
    """Entries sorted by stripe and pair of blocks to the pairs (a, b) of rows that may reach the threshold."""

    def meet(pair: int, cols: list[list[np.ndarray]]) -> pa.RecordBatch:
        row, size, at, length, own, items, signed = map(np.concatenate, cols)
        signed = signed.reshape(-1, SIGNATURE)
        lo, hi = pair >> 20, pair & 0xFFFFF
        bits = np.bitwise_count(signed).sum(1).astype(np.int64)
        tree = Trie(length, items, size, at)
        found_ = []
        for i, j in tree.meetings(part, of):
            e, f = tree.entry[i], tree.entry[j]
            least = -(-(size[e] + size[f]) * part // (part + of))
            keep = np.minimum(size[e] - tree.at[i], size[f] - tree.at[j]) >= least
            keep &= np.minimum(size[e], size[f]) * of >= np.maximum(size[e], size[f]) * part
            # Two sets of one block meet under every pair of blocks with theirs; only the pair of both their own counts.
            keep &= (np.minimum(own[e], own[f]) == lo) & (np.maximum(own[e], own[f]) == hi)
            e, f, least = e[keep], f[keep], least[keep]
            # A bit of one set that the other lacks stands for at least one sequence the other lacks.
            common = np.bitwise_count(signed[e] & signed[f]).sum(1).astype(np.int64)
            keep = np.minimum(size[e] - bits[e], size[f] - bits[f]) + common >= least
            e, f = e[keep], f[keep]
            found_.append(np.unique(np.minimum(e, f) * len(row) + np.maximum(e, f)))
        both = np.unique(np.concatenate(found_)) if found_ else np.empty(0, np.int64)
        a, b = row[both // max(len(row), 1)], row[both % max(len(row), 1)]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cols = None, []
        for batch in batches:
            for r, pair, unit, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (r, pair) != now:
                    if now:
                        yield meet(now[1], cols)
                    now, cols = (r, pair), [[] for _ in range(7)]
                got = _unpack(data)
                got[0] = got[0].astype(np.int64) + (unit << 16)
                for c, x in zip(cols, got):
                    c.append(x.astype(np.uint64 if c is cols[6] else np.int64))
        if now:
            yield meet(now[1], cols)

    return run


def _compare(part: int, of: int):
    """Rows sorted by (a, salt), a's own row (null b) first, to (a, b, overlap, similarity) of the pairs over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, name = None, None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for a, salt, b, class_id, grams in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                one = np.frombuffer(grams, np.uint32)
                if b is None:
                    now, left, name = (a, salt), one, class_id
                    continue
                assert now == (a, salt)
                at = np.minimum(np.searchsorted(left, one), len(left) - 1)
                overlap = int(np.count_nonzero(left[at] == one))
                union = len(left) + len(one) - overlap
                if overlap * of >= union * part:
                    for column, value in zip(out, (min(name, class_id), max(name, class_id), overlap, overlap / union)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64())],
                names=["a", "b", "overlap", "similarity"],
            )

    return run


def similar_classes(units: DataFrame, part: int = 1, of: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): class of each id, and the pairs of classes at or over ``part/of``.

    ``units`` come from :func:`gram_sets`. Pairs have a < b with overlap and similarity; ids of
    one class hold the same text and need no pair. No pair is capped or dropped.
    """
    spark = units.sparkSession
    each = members_of(units)
    members = each.select("id", "class_id").distinct()
    # One row of each class goes on; the others are told to their units.
    copies = each.select("class_id", "row").join(each.groupBy("class_id").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"), "class_id").where("row != first")
    told = copies.groupBy(F.shiftright("row", 16).alias("unit")).agg(F.collect_list("row").alias("rows"))
    as_bytes = lambda frames: (pd.DataFrame({"unit": f["unit"], "part": -1, "reply": [np.array(r, np.int64).tobytes() for r in f["rows"]]}) for f in frames)
    told = told.mapInPandas(as_bytes, "unit long, part int, reply binary")
    held = units.agg(F.sum(F.length("grams") / 4)).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(-(-held // COUNT_GRAMS)))
    stripes = max(spark.sparkContext.defaultParallelism, int(-(-held // STRIPE_GRAMS)))
    offers = units.select("unit", "grams").mapInArrow(_offers(width), "part int, unit long, steps binary, counts binary")
    replies = durable(offers.groupBy("part").applyInPandas(_replies(stripes), "unit long, part int, reply binary"))
    most = np.zeros(2 * stripes, np.uint8)
    for r in replies.where("unit = -1").toLocalIterator():
        most = np.maximum(most, np.frombuffer(zlib.decompress(r["reply"]), np.uint8))
    blocks = np.where(np.arange(2 * stripes) < stripes, 1, -(-_held(most.astype(np.int64)) // CROWD))
    entries = (
        units.select("unit", "sizes", "grams").groupBy("unit")
        .cogroup(replies.where("unit >= 0").unionByName(told).groupBy("unit"))
        .applyInPandas(_enter(stripes, blocks, part, of), "stripe int, pair long, unit long, entries binary")
    )
    dealt = entries.repartitionById(stripes, F.pmod(F.col("stripe") + F.col("pair") * 7, F.lit(stripes)).cast("int")).sortWithinPartitions("stripe", "pair")
    met = dealt.mapInArrow(_met(part, of), "a long, b long")
    candidates = durable(met.distinct())
    n = candidates.count()
    crowded = candidates.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > CANDIDATES).select("a", F.ceil(F.col("n") / CANDIDATES).alias("groups"))
    salted = candidates.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).alias("salt"))
    salted = durable(salted)
    sets = units.select("unit", "class_ids", "sizes", "grams").mapInArrow(_each_set, "row long, class_id long, grams binary")
    # Each set goes to the pairs it is the right side of, and once to itself for every group where it is a left side.
    right = sets.withColumnRenamed("row", "b").join(sized_broadcast(salted, rows=n), "b").select("a", "salt", "b", "class_id", "grams")
    left = sets.withColumnRenamed("row", "a").join(sized_broadcast(salted.select("a", "salt").distinct(), rows=n), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "class_id", "grams")
    grouped = left.unionByName(right).repartition("a", "salt").sortWithinPartitions(F.col("a"), F.col("salt"), F.col("b").asc_nulls_first())
    return members, grouped.mapInArrow(_compare(part, of), "a long, b long, overlap int, similarity double")


def passages(blocks: DataFrame) -> DataFrame:
    """The comparable sets of TEXT blocks, written once."""
    every = blocks.where(F.col("block_id").isNotNull() & F.col("text").isNotNull()).select("block_id", "block_type", "text")
    # The dictionary of misread words is the whole corpus's, computed once; only blocks that hold one are mended.
    ready = scans.prepared(every)
    wrong = durable(scans.misread_words(ready))
    own = ready.where(F.col("block_type") == "TEXT").select("block_id", "plain", "said")
    text = repaired(F.col("plain"))
    rows = wrong.limit(DICTIONARY + 1).count()
    if rows <= DICTIONARY:
        fixes = blocks.sparkSession.sparkContext.broadcast({r["token"]: r["word"] for r in wrong.collect()})
        units = gram_sets(own.select("block_id", text.alias("text")), "block_id", "text", fixes=fixes)
    else:
        kept = own.select("block_id", text.alias("text")).join(scans.fixes_by_block(own, wrong), "block_id", "left")
        mended = F.when(F.col("fixes").isNotNull(), scans._mend(F.col("text"), F.col("fixes"))).otherwise(F.col("text"))
        units = gram_sets(kept.select("block_id", mended.alias("text")), "block_id", "text")
    forget(ready)
    return units


def found(blocks: DataFrame) -> DataFrame:
    """(block_id_a, block_id_b): every two different blocks of one passage, copies expanded.

    Null and short texts give no pair; repeated rows count once; ties cannot
    arise, as the threshold is compared in whole numbers. The blocks of one class
    meet per pair of blocks of bounded size.
    """
    members, pairs = similar_classes(passages(blocks))
    members, pairs = stored(members), durable(pairs.select("a", "b"))
    left = durable(members.join(sized_broadcast(pairs), F.col("class_id") == F.col("a")).select(F.col("id").alias("x"), "b"))
    across = members.join(sized_broadcast(left), F.col("class_id") == F.col("b"))
    across = across.where(F.col("id") != F.col("x")).select("x", F.col("id").alias("y"))
    both = across.union(pairs_within(members, "class_id", "id").select("x", "y"))
    return both.select(F.least("x", "y").alias("block_id_a"), F.greatest("x", "y").alias("block_id_b")).distinct()


def classes(blocks: DataFrame) -> DataFrame:
    """(block_id, class_id, copies, links): one row per comparable block.

    ``class_id`` is shared by blocks of equal words, ``copies`` is their number and
    ``links`` the number of other classes at or over the threshold.
    """
    members, pairs = similar_classes(passages(blocks))
    links = durable(pairs).select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    out = members.join(sizes, "class_id").join(links, "class_id", "left")
    return out.select(F.col("id").alias("block_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
