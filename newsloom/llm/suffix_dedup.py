"""Repeated passages by a sparse suffix array: which byte spans of a text also stand anywhere else.

A string of ``min_bytes`` is repeated if it starts at a second place, in the same text or another. Every such
string owns an anchor: the least hashed gram of GRAM bytes in it, the leftmost of equals. Equal strings own equal
anchors at equal offsets, so only suffixes at anchors have to be sorted, about one in 170 bytes. The strings of
one anchor form a context, the bytes they cover.

1. Each text gives its anchors: hash of the gram, digest of the context, offsets. No text is shuffled for it.
2. A context that occurs twice is repeated throughout. A gram with one context only is not repeated elsewhere.
3. What is left are grams with several contexts; one copy of each context is cut from its text. The contexts of a
   gram are sorted as suffixes from the anchor on, by mergesort; two suffixes are compared by a binary search for
   their common extension over prefix polynomial hashes, in logarithmic time. The same is done to the left. The
   common extensions with their neighbours bound the strings that can be repeated; these are matched by their
   hashes and verified by their bytes, so a hash collision removes nothing.
4. Grams with more than BLOCK contexts are not sorted in one task: each of their strings is matched by its digest.

Where ``words`` are given, a string ends after ``min_bytes`` or where so many words end, whichever comes first; its
length follows from its own bytes and the end of its last word, so equal passages still give equal strings.

Null and empty texts, and those shorter than a string, have no spans. Repeated rows are copies of one another, so
all of their long strings are repeated. Null ids: a row is then known by its text. Columns other than id and
text are passed on untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.spans import BASE, BYTE_TABLE, PrefixHash, powers
from newsloom.llm.tables import discard, node_of, packed, small_batches, stored, unpacked, unused

GRAM = 64
BLOCK = 4096
# Texts are scanned in stretches of this many bytes; low bits of the ordering key hold the place in the stretch.
STRETCH = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
# ``size`` is the length of the string that starts at ``hi``.
ANCHORS = "node long, th long, gram long, context long, p int, lo int, hi int, size int"
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys, by doubling."""
    done, out = 1, key
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def string_ends(data: bytes, min_bytes: int, words: int | None = None) -> np.ndarray:
    """The end of the string that starts at each byte: ``min_bytes`` on, or where ``words`` words end before that.

    What stands before the first space counts as a word. Starts that leave too little come last and are left out.
    """
    ends = np.arange(len(data)) + min_bytes
    if words and len(data):
        letter = ~SPACES[np.frombuffer(data, dtype=np.uint8)]
        final = letter & ~np.append(letter[1:], False)
        word_end = np.flatnonzero(final) + 1
        nth = np.cumsum(final) - final + words - 1
        inside = np.flatnonzero(nth < len(word_end))
        ends[inside] = np.minimum(ends[inside], word_end[nth[inside]])
    return ends[: np.searchsorted(ends, len(data), side="right")]


def _shortest(min_bytes: int, words: int | None) -> int:
    """Bytes of the shortest string: words of one letter with a space between two."""
    return min(min_bytes, 2 * words - 1) if words else min_bytes


def _owners(key: np.ndarray, ends: np.ndarray, min_bytes: int, gram: int) -> np.ndarray:
    """The place of the least gram of each string."""
    width, full = ends - np.arange(len(ends)) - gram + 1, min_bytes - gram + 1
    least = np.zeros(len(ends), dtype=np.uint64)
    if len(key) >= full:
        whole = _sliding_min(key, full)[: len(ends)]
        least[: len(whole)] = whole
    short = np.flatnonzero(width < full)
    power = np.left_shift(1, np.log2(width[short]).astype(np.int64))
    for size in np.unique(power).tolist():
        at, table = short[power == size], _sliding_min(key, size)
        least[at] = np.minimum(table[at], table[at + width[at] - size])
    return (least & PLACE).astype(np.int64)


def anchors(data: bytes, min_bytes: int, gram: int = GRAM):
    """``(p, lo, hi, gram hash, context digest)``: strings starting at lo..hi own the anchor at p."""
    return _anchors(data, min_bytes, gram, None)[:5]


def _anchors(data: bytes, min_bytes: int, gram: int, words: int | None):
    """The same, with the length of the string that starts at hi."""
    p, lo, hi, hashes, digests, sizes = [], [], [], [], [], []
    for base in range(0, max(len(data) - _shortest(min_bytes, words) + 1, 0), STRETCH):
        part = data[base : base + STRETCH + min_bytes - 1]
        ends = string_ends(part, min_bytes, words)[:STRETCH]
        if not len(ends):
            break
        at = np.arange(len(part) - gram + 1)
        grams = PrefixHash(part).spans(at, at + gram)
        key = (grams & ~PLACE) | at.astype(np.uint64)
        owner = _owners(key, ends, min_bytes, gram)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts - 1, [len(owner) - 1]])
        own = owner[first]
        p += (own + base).tolist()
        lo += (first + base).tolist()
        hi += (last + base).tolist()
        hashes += grams[own].view(np.int64).tolist()
        for a, o, b in zip(first.tolist(), own.tolist(), last.tolist(), strict=True):
            said = hashlib.md5(part[a : ends[b]], usedforsecurity=False)
            said.update((o - a).to_bytes(4, "little") + (b - a).to_bytes(4, "little"))
            digests.append(int.from_bytes(said.digest()[:8], "little", signed=True))
        sizes += (ends[last] - last).tolist()
    return p, lo, hi, hashes, digests, sizes


def _anchor_rows(min_bytes: int, gram: int, words: int | None):
    names = [c.split()[0] for c in ANCHORS.split(", ")]

    def step(batches):
        for batch in batches:
            for node, th, text in zip(
                batch.column("node").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True
            ):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < _shortest(min_bytes, words):
                    continue
                p, lo, hi, hashes, digests, sizes = _anchors(data, min_bytes, gram, words)
                n = len(p)
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, node, dtype=np.int64)),
                        pa.array(np.full(n, th, dtype=np.int64)),
                        pa.array(hashes, pa.int64()),
                        pa.array(digests, pa.int64()),
                        pa.array(p, pa.int32()),
                        pa.array(lo, pa.int32()),
                        pa.array(hi, pa.int32()),
                        pa.array(sizes, pa.int32()),
                    ],
                    names=names,
                )

    return step


class Extensions:
    """Prefix hashes of byte strings that all begin at the same point, and their order as suffixes."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts
        self.length = [len(x) for x in parts]
        width = max(self.length, default=0)
        rows = np.zeros((len(parts), width), dtype=np.uint64)
        for i, x in enumerate(parts):
            rows[i, : len(x)] = BYTE_TABLE[np.frombuffer(x, dtype=np.uint8)]
        self.hash = np.zeros((len(parts), width + 1), dtype=np.uint64)
        np.cumsum(rows * powers("up", width), axis=1, out=self.hash[:, 1:])

    def common(self, i: int, j: int) -> int:
        """Length of the common extension of two strings: binary search over their prefix hashes."""
        low, high, a, b = 0, min(self.length[i], self.length[j]), self.hash[i], self.hash[j]
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == b[middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def _before(self, i: int, j: int) -> bool:
        n = self.common(i, j)
        return self.parts[i][n : n + 1] <= self.parts[j][n : n + 1]

    def order(self) -> list[int]:
        """The suffix array: mergesort, with comparisons of logarithmic cost."""
        runs = [[i] for i in range(len(self.parts))]
        while len(runs) > 1:
            merged = []
            for at in range(0, len(runs) - 1, 2):
                left, right, out, i, j = runs[at], runs[at + 1], [], 0, 0
                while i < len(left) and j < len(right):
                    if self._before(left[i], right[j]):
                        out.append(left[i])
                        i += 1
                    else:
                        out.append(right[j])
                        j += 1
                merged.append(out + left[i:] + right[j:])
            runs = merged + (runs[-1:] if len(runs) % 2 else [])
        return runs[0] if runs else []

    def reach(self) -> np.ndarray:
        """The longest common extension of each string with any other: with a neighbour in suffix order."""
        order = self.order()
        out = np.zeros(len(order), dtype=np.int64)
        for i, j in zip(order, order[1:], strict=False):
            n = self.common(i, j)
            out[i], out[j] = max(out[i], n), max(out[j], n)
        return out


def _context_ends(context: bytes, last: int, min_bytes: int, words: int | None) -> np.ndarray:
    """The ends of the strings that start at 0..last of a context; the last one ends with it."""
    return string_ends(context, min_bytes, words)[: last + 1]


def repeated_starts(
    contexts: list[bytes], offset: list[int], min_bytes: int, ends: list[np.ndarray] | None = None
) -> list[np.ndarray]:
    """For contexts of one gram, each anchored at its offset: the starts of strings that another context holds."""
    right = Extensions([c[o:] for c, o in zip(contexts, offset, strict=True)])
    left = Extensions([c[:o][::-1] for c, o in zip(contexts, offset, strict=True)])
    to_right, to_left = right.reach(), left.reach()
    ends = [string_ends(c, min_bytes) for c in contexts] if ends is None else ends
    which, starts = [], []
    for i, o in enumerate(offset):
        # a string starts at the anchor or before it, and both extensions hold it
        s = np.arange(min(o + 1, len(ends[i])))
        s = s[(o - s <= to_left[i]) & (ends[i][: len(s)] - o <= to_right[i])]
        starts.append(s)
        which.append(np.full(len(s), i))
    found: list[list[int]] = [[] for _ in contexts]
    if sum(map(len, which)):
        i, s = np.concatenate(which), np.concatenate(starts)
        e = np.concatenate([ends[k][x] for k, x in enumerate(starts)])
        o = np.array(offset, dtype=np.int64)[i]
        key = (left.hash[i, o - s] * np.uint64(BASE) + right.hash[i, e - o]) * np.uint64(0x9E3779B97F4A7C15)
        key += ((o - s) + ((e - s) << 32)).astype(np.uint64)
        _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        partner = first[inverse]
        for x in np.flatnonzero(count[inverse] > 1):
            y = partner[x]
            a, b = int(i[x]), int(i[y])
            if a == b:  # the first of its kind is verified by those that follow
                continue
            if contexts[a][s[x] : e[x]] == contexts[b][s[y] : e[y]]:
                found[a].append(int(s[x]))
                found[b].append(int(s[y]))
    return [np.unique(np.array(x, dtype=np.int64)) for x in found]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(starts, cuts) if len(x)]


def _cut_contexts():
    def step(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("gram", "many", "node", "th", "offset", "lo", "last", "copies", "bytes")}
            for row in batch.to_pylist():
                data = unpacked(row["packed"])
                for x in row["places"]:
                    out["gram"].append(x["gram"])
                    out["many"].append(x["many"])
                    out["node"].append(row["node"])
                    out["th"].append(row["th"])
                    out["offset"].append(x["p"] - x["lo"])
                    out["lo"].append(x["lo"])
                    out["last"].append(x["hi"] - x["lo"])
                    out["copies"].append(x["copies"])
                    out["bytes"].append(data[x["lo"] : x["hi"] + x["size"]])
            yield pa.record_batch(
                [
                    pa.array(out["gram"], pa.int64()),
                    pa.array(out["many"], pa.bool_()),
                    pa.array(out["node"], pa.int64()),
                    pa.array(out["th"], pa.int64()),
                    pa.array(out["offset"], pa.int32()),
                    pa.array(out["lo"], pa.int32()),
                    pa.array(out["last"], pa.int32()),
                    pa.array(out["copies"], pa.int64()),
                    pa.array(out["bytes"], pa.binary()),
                ],
                names=list(out),
            )

    return step


def _sorted_groups(min_bytes: int, words: int | None):
    """Rows come sorted by gram; one gram's contexts are held at a time."""

    def solve(rows):
        out = []
        if len(rows) > 1:
            ends = [_context_ends(r["bytes"], r["last"], min_bytes, words) for r in rows]
            starts = repeated_starts([r["bytes"] for r in rows], [r["offset"] for r in rows], min_bytes, ends)
            for r, s, e in zip(rows, starts, ends, strict=True):
                if r["copies"] == 1:
                    out += [(r["node"], r["th"], a + r["lo"], int(e[b]) + r["lo"]) for a, b in _runs(s)]
        return out

    def step(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["gram"] != row["gram"]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield _span_batch(out)
        yield _span_batch(solve(held))

    return step


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["node", "th", "start", "end"]
    )


def _strings(min_bytes: int, words: int | None):
    """Every string of a context with its digest, for grams that are too frequent to be sorted together."""

    def step(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = row["bytes"]
                ends = _context_ends(data, row["last"], min_bytes, words)
                n = len(ends)
                said = b"".join(
                    hashlib.md5(data[s:e], usedforsecurity=False).digest() for s, e in enumerate(ends.tolist())
                )
                two = np.frombuffer(said, dtype=np.int64).reshape(n, 2)
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, row["node"], dtype=np.int64)),
                        pa.array(np.full(n, row["th"], dtype=np.int64)),
                        pa.array((np.arange(n) + row["lo"]).astype(np.int32)),
                        pa.array((ends + row["lo"]).astype(np.int32)),
                        pa.array(np.full(n, row["copies"], dtype=np.int64)),
                        pa.array(np.ascontiguousarray(two[:, 0])),
                        pa.array(np.ascontiguousarray(two[:, 1])),
                    ],
                    names=["node", "th", "start", "end", "copies", "d1", "d2"],
                )

    return step


def repeated_spans(
    docs: DataFrame, min_bytes: int = 400, gram: int = GRAM, block: int = BLOCK, words: int | None = None
) -> DataFrame:
    """``(node, th, spans)`` of the texts that hold repeated strings; spans may overlap.

    A string counts from ``min_bytes`` bytes on, and if ``words`` are given from so many words on, however short.
    ``node`` and ``th`` are ``node_of`` the row and the hash of its text; a span is (start, end) in bytes.
    """
    if gram > _shortest(min_bytes, words):
        raise ValueError(f"a gram of {gram} bytes does not fit into the shortest string")
    source = small_batches(docs.select(node_of("doc_id").alias("node"), F.xxhash64("text").alias("th"), "text"))
    found = stored(source.mapInArrow(_anchor_rows(min_bytes, gram, words), ANCHORS), "anchors")
    contexts = found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("copies"))
    grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all"))
    open_grams = contexts.join(grams.where("all > 1"), "gram")
    hits = stored(
        found.join(open_grams.select("gram", "context", "copies", "kinds"), ["gram", "context"]), "hits"
    )
    discard(found)
    whole = hits.where("copies > 1").select(
        "node", "th", F.col("lo").alias("start"), (F.col("hi") + F.col("size")).alias("end")
    )

    # one copy of each context of a gram that has several
    place = F.struct("node", "th", "p", "lo", "hi", "size")
    single = hits.where("kinds > 1 AND copies = 1").select(
        "node",
        "th",
        F.struct("gram", (F.col("kinds") > block).alias("many"), "p", "lo", "hi", "size", "copies").alias("at"),
    )
    witness = (
        hits.where("kinds > 1 AND copies > 1")
        .groupBy("gram", "context")
        .agg(F.min(place).alias("w"), F.first("kinds").alias("kinds"), F.first("copies").alias("copies"))
        .select(
            "w.node",
            "w.th",
            F.struct(
                "gram", (F.col("kinds") > block).alias("many"), F.col("w.p").alias("p"), F.col("w.lo").alias("lo"),
                F.col("w.hi").alias("hi"), F.col("w.size").alias("size"), "copies",
            ).alias("at"),
        )
    )
    places = single.unionByName(witness).groupBy("node", "th").agg(F.collect_list("at").alias("places"))
    small = source.mapInArrow(_pack(["node", "th"]), "node long, th long, packed binary")
    one_each = small.join(places, ["node", "th"]).dropDuplicates(["node", "th"])
    cut = stored(
        one_each.mapInArrow(
            _cut_contexts(),
            "gram long, many boolean, node long, th long, offset int, lo int, last int, copies long, bytes binary",
        ),
        "contexts",
    )
    spans = "node long, th long, start int, end int"
    few = cut.where("NOT many").repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _sorted_groups(min_bytes, words), spans
    )
    strings = stored(
        cut.where("many").mapInArrow(
            _strings(min_bytes, words), "node long, th long, start int, end int, copies long, d1 long, d2 long"
        ),
        "strings",
    )
    again = strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    many = (
        strings.where("copies = 1")
        .join(again.select("d1", "d2"), ["d1", "d2"])
        .select("node", "th", "start", "end")
    )
    return (
        whole.unionByName(few)
        .unionByName(many)
        .groupBy("node", "th")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pack(names: list[str], text: str = "text", to: str = "packed"):
    def step(batches):
        for batch in batches:
            yield pa.record_batch([*(batch.column(n) for n in names), packed(batch.column(text))], names=[*names, to])

    return step


def _with_spans(docs: DataFrame, min_bytes: int, spans: str, text: str, **options) -> DataFrame:
    """``docs`` with compressed texts in the column ``text``, and repeated spans: null where nothing is repeated."""
    node, th = unused(docs, "node"), unused(docs, "th")
    marked = repeated_spans(docs, min_bytes, **options)
    marked = marked.select(F.col("node").alias(node), F.col("th").alias(th), F.col("spans").alias(spans))
    keyed = docs.withColumns({node: node_of("doc_id"), th: F.xxhash64("text")})
    names = [c for c in keyed.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*names).schema)
    small = small_batches(keyed).mapInArrow(_pack(names, to=text), f"{schema}, `{text}` binary")
    return small.join(marked, [node, th], "left").drop(node, th)


def _digests(batches):
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, spans in zip(batch.column("packed"), batch.column("spans").to_pylist(), strict=True):
            data = unpacked(text.as_py())
            cuts = joined_spans([(x["start"], x["end"]) for x in spans or ()])
            said, at = hashlib.sha256(), 0
            for a, b in cuts:
                said.update(data[at:a])
                at = b
            said.update(data[at:])
            out["n_bytes"].append(len(data))
            out["n_removed"].append(sum(b - a for a, b in cuts))
            out["n_spans"].append(len(cuts))
            out["kept_sha256"].append(said.hexdigest())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch(
            [batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))],
            names=["doc_id", *out],
        )


def removal_digests(docs: DataFrame, min_bytes: int = 400, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``: what removing every repeated byte leaves."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_spans(slim, min_bytes, "spans", "packed", **options).mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def _shorten(names: list[str], spans: str, text: str):
    def kept(data: bytes, spans) -> str:
        out, at = [], 0
        for a, b in joined_spans([(x["start"], x["end"]) for x in spans]):
            # whole characters only: a span that begins or ends inside one leaves that character
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            out.append(data[at:a])
            at = max(at, b)
        out.append(data[at:])
        return b"".join(out).decode("utf-8", "surrogatepass")

    def step(batches):
        for batch in batches:
            texts = [
                None if t.as_py() is None else kept(unpacked(t.as_py()), s or ())
                for t, s in zip(batch.column(text), batch.column(spans).to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.record_batch(columns, names=names)

    return step


def without_repeats(docs: DataFrame, min_bytes: int = 400, **options) -> DataFrame:
    """``docs`` without the repeated bytes of their texts; a character is removed as a whole or not at all."""
    spans, text = unused(docs, "spans"), unused(docs, "packed")
    cut = _with_spans(docs, min_bytes, spans, text, **options)
    return cut.mapInArrow(_shorten(docs.columns, spans, text), docs.schema)
