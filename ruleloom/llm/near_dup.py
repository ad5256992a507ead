"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of word shingles; equal sets form one class, however
   many copies there are.  A class has a signature of ``coordinates`` MinHash values.
2. Classes are posted under (coordinate, value) pairs.  Two sets of the asked
   similarity agree in at least ``matches`` coordinates but for about one chance in a
   million, so they share one of the first ``coordinates - matches + 1`` postings of
   each, in any common order.  The order puts long lists last (their lengths are
   counted over all classes): these lists are skipped unless a class has little else.
3. Each list's most central member is compared with the others (a star, not all
   pairs).  Whoever agrees with it in a longer sketch (``sketch`` values of eight bits, with
   the same small chance of a loss) is confirmed on the full sets.
4. Only lists whose members still lie in different components are merged in full:
   collisions are counted inside the task in blocks, each pair in the first list it
   shares, and only agreeing pairs of different components leave it (of long
   lists only those whose sets, at hand there, pass the exact test).  They are sketched and confirmed likewise.

Pairs inside a component are never produced, so a group of n copies costs a star of
n.  A list with many members in different components costs comparisons of their
signatures in the square of its length, spread over blocks of ``block`` members.

Defined cases: null and empty texts and texts without a word have an empty set and
are linked with nothing; a text of fewer words than ``k`` has its whole sequence as
its one shingle; rows with equal keys are all returned; a null key is never a
component's identifier while another key is there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import per_chunk, released, staged, text_table
from .shingles import minhash, overlap, seeds, shingle_set

_U = np.uint64
_SHIFT = _U(57)


def _fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def profiles(docs: DataFrame, key: str, text: str, k: int, coordinates: int) -> DataFrame:
    """``key, fp, n, sig``: fingerprint and size of every set, and its signature (null if it is empty)."""
    kind = docs.schema[key].dataType.simpleString()
    multiply, add = seeds(coordinates)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        fps, ns, sigs = [], [], []
        for x in part.column(1).to_pylist():
            s = shingle_set(x, k)
            ns.append(len(s))
            fps.append(_fingerprint(s) if len(s) else None)
            sigs.append(minhash(s, multiply, add).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary())], names=["key", "fp", "n", "sig"])

    return text_table(docs, key, text).mapInArrow(per_chunk(make), f"key {kind}, fp binary, n long, sig binary")


def _tokens(sig: np.ndarray) -> np.ndarray:
    """A coordinate's number above, 57 bits of its value below."""
    return (sig & ((_U(1) << _SHIFT) - _U(1))) | (np.arange(sig.shape[1], dtype=_U) << _SHIFT)


def _postings(classes: DataFrame, coordinates: int, matches: int, long_list: int, most: int) -> DataFrame:
    """``id, n, sig32, mask, central, tokens``: each class with its prefix in the common order."""

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_tokens(_fixed(part.column(1), "<u8", coordinates)).ravel().view(np.int64))], names=["token"])

    counted = classes.select("id", "sig").mapInArrow(per_chunk(emit), "token long").groupBy("token").agg(F.count("*").alias("n"))
    # The longest lists by name; any order that all classes share is right, so ``most`` bounds only memory.
    top = counted.where(F.col("n") > long_list).orderBy(F.desc("n"), "token").limit(most).toArrow()
    names, sizes = top.column(0).to_numpy().view(_U), top.column(1).to_numpy()
    by = np.argsort(names)
    names, sizes = names[by], sizes[by]
    width = coordinates - matches + 1

    def pick(part: pa.RecordBatch) -> pa.RecordBatch:
        sig = _fixed(part.column(2), "<u8", coordinates)
        tokens = _tokens(sig)
        length = np.zeros(tokens.shape, np.int64)
        if len(names):
            at = np.searchsorted(names, tokens)
            at[at == len(names)] = 0
            length = np.where(names[at] == tokens, sizes[at], 0)
        order = np.lexsort((tokens, length), axis=1)[:, :width]
        mask = np.bitwise_or.reduce(_U(1) << order.astype(_U), axis=1)
        central = np.log1p(length).sum(axis=1)
        chosen = np.take_along_axis(tokens, order, 1).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in sig.astype("<u4")], pa.binary()), pa.array(mask.view(np.int64)), pa.array(central), pa.array(list(chosen), pa.list_(pa.int64()))], names=["id", "n", "sig32", "mask", "central", "tokens"])

    return classes.select("id", "n", "sig").mapInArrow(per_chunk(pick, 2), "id long, n long, sig32 binary, mask long, central double, tokens array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            held.append(batch.slice(a, b - a))
            if i < len(cuts) - 2:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def check(part: pa.RecordBatch) -> pa.RecordBatch:
        ok, last = [], (None, None)
        for b, x, y in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if last[0] != b:  # rows come sorted by b: a leader's set is made once
                last = b, shingle_set(y, k)
            x, y = shingle_set(x, k), last[1]
            common = overlap(x, y)
            ok.append(100 * common >= percent * (len(x) + len(y) - common))
        return part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(per_chunk(check, 2), "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, coordinates: int = 48, matches: int | None = None, long_list: int = 32, in_task: int = 256, block: int = 2048, sketch: int = 192) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Two texts are linked where ``100 * intersection >= percent * union`` of their sets of
    ``k``-word shingles; ``component_id`` is the least key that can be reached.
    """
    if matches is None:
        p = percent / 100
        matches = max(1, math.floor(coordinates * p - 5.05 * math.sqrt(coordinates * p * (1 - p))))
    signed = staged(profiles(docs, key, text, k, coordinates), "profiles")
    classed = staged(signed.where("fp is not null").groupBy("fp").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("sig").alias("sig")).withColumn("id", F.monotonically_increasing_id()), "classes")
    slim = staged(_postings(classed, coordinates, matches, long_list, 100_000), "postings")
    # Signatures are large and have served: from here on rows and classes are narrow.
    all_, classes = staged(signed.select("key", "fp", "n"), "rows"), staged(classed.select("id", "fp", "key"), "classes")
    released(signed, classed)
    posted = slim.select(F.explode("tokens").alias("token"), "id")
    lists = posted.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(posted.join(lists, "token").select("token", "id", "size"), "members")

    # The texts of all classes that share a list (rows that only repeat a key don't fit the fingerprint and go).
    wanted = members.select("id").distinct().join(classes.select("id", "fp", F.col("key").alias("rep")), "id")
    texts = text_table(docs, key, text)
    texts = texts.join(wanted, texts["key"].eqNullSafe(wanted["rep"])).select("id", "text", "fp")

    multiply, add = seeds(sketch, salt=1)

    def fits(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, kept, sketches = [], [], []
        for i, x, fp in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True):
            s = shingle_set(x, k)
            if len(s) and _fingerprint(s) == fp:
                ids.append(i)
                kept.append(x)
                sketches.append((minhash(s, multiply, add) & _U(255)).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.string()), pa.array(sketches, pa.binary())], names=["id", "text", "sketch"])

    texts = staged(texts.mapInArrow(per_chunk(fits), "id long, text string, sketch binary"), "texts")

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs whose longer sketches agree as often as similar sets do but for one chance in millions."""
        p = percent / 100
        least = math.floor(sketch * p - 5.3 * math.sqrt(sketch * p * (1 - p)))
        side = lambda name, column: texts.select(F.col("id").alias(name), F.col("sketch").alias(column))

        def agree(part: pa.RecordBatch) -> pa.RecordBatch:
            ok = (_fixed(part.column(2), "u1", sketch) == _fixed(part.column(3), "u1", sketch)).sum(axis=1) >= least
            return part.select(["a", "b"]).filter(pa.array(ok))

        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(per_chunk(agree, 2), "a long, b long")

    # Stars: the member that shares most with others leads its list.
    led = members.join(slim.select("id", "central"), "id").groupBy("token").agg(F.max(F.struct("central", "id")).alias("l")).select("token", F.col("l.id").alias("b"))
    spokes = members.join(led, "token").where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    pairs = staged(likely(spokes), "stars")
    links = staged(_confirmed(pairs, texts, k, percent), "links")
    first = staged(connected_components(links), "components")

    # Merges: lists whose members are still apart, in blocks.
    placed = staged(members.join(first, members["id"] == first["node"], "left").select("token", "id", "size", F.coalesce("root", "id").alias("comp")), "placed")
    apart = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    rows = staged(placed.join(apart, "token"), "apart")
    small = rows.where(F.col("size") <= in_task).select("*", F.lit(None).cast("string").alias("text"))
    big = rows.where(F.col("size") > in_task).join(texts, "id").select(*small.columns)
    rows = small.union(big).join(slim.select("id", "n", "sig32", "mask"), "id")
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cells = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = cells.select("token", "i", "j", "own", "id", "comp", "n", "mask", "sig32", "text").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b = [], []
        for g in _groups(batches, ["token", "i", "j"]):
            if g.num_rows < 2:
                continue
            c = {name: g.column(name) for name in g.column_names}
            coordinate = int(np.int64(c["token"][0].as_py()).view(_U) >> _SHIFT)
            inside = c["i"][0].as_py() == c["j"][0].as_py()
            sig = np.frombuffer(b"".join(c["sig32"].to_pylist()), "<u4").reshape(-1, coordinates)
            prefix = (c["mask"].to_numpy().view(_U)[:, None] >> np.arange(coordinates, dtype=_U)) & _U(1) == 1
            n, own_, ids = c["n"].to_numpy(), c["own"].to_numpy(), c["id"].to_pylist()
            comp = c["comp"].to_numpy()
            full_sets = [None if x is None else shingle_set(x, k) for x in c["text"].to_pylist()]
            for x in range(len(ids) - 1):
                y = np.flatnonzero((comp[x + 1 :] != comp[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))) + x + 1
                if not inside:
                    y = y[own_[y] != own_[x]]
                if not len(y):
                    continue
                same = sig[y] == sig[x]
                keep = same.sum(axis=1) >= matches
                y, same = y[keep], same[keep]
                if not len(y):
                    continue
                y = y[(same & prefix[y] & prefix[x]).argmax(axis=1) == coordinate]
                for z in y.tolist():
                    if full_sets[x] is not None and full_sets[z] is not None:
                        common = overlap(full_sets[x], full_sets[z])
                        if 100 * common < percent * (len(full_sets[x]) + len(full_sets[z]) - common):
                            continue
                    out_a.append(min(ids[x], ids[z]))
                    out_b.append(max(ids[x], ids[z]))
            if len(out_a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
                out_a, out_b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    found = staged(likely(staged(dealt.mapInArrow(merge, "a long, b long").distinct(), "merged")), "likely")
    more = staged(_confirmed(found, texts, k, percent), "links")
    root = connected_components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    # A component's identifier is the least key of all its classes.
    labelled = classes.select("id", "key").join(root.withColumnRenamed("node", "id"), "id")
    least = labelled.groupBy("root").agg(F.min("key").alias("component_id"))
    names = labelled.join(least, "root").select("id", "component_id")
    by_class = classes.select("id", "fp", F.col("key").alias("own_id")).join(names, "id", "left").select("fp", F.coalesce("component_id", "own_id").alias("component_id"))
    full_rows = all_.where("fp is not null").select("key", "n", "fp").join(by_class, "fp").select("key", "n", "component_id")
    empty = all_.where("fp is null").select("key", "n", F.col("key").alias("component_id"))
    out = full_rows.union(empty)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle() -> str:
    """DuckDB SQL for the rows of ``near_duplicates`` over documents (``k`` 3, 85 percent); for small tables."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d),
c AS (SELECT min(doc_id) AS id, md5(array_to_string(list_sort(g), chr(10))) AS h, any_value(g) AS g FROM g WHERE len(g) > 0 GROUP BY h),
s AS (SELECT id, len(g) AS n, unnest(g) AS s FROM c),
p AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(id, m) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.m = e.u),
k AS (SELECT c.h, coalesce(min(r.m), c.id) AS component_id FROM c LEFT JOIN r ON r.id = c.id GROUP BY c.h, c.id)
SELECT doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM g LEFT JOIN k ON len(g.g) > 0 AND md5(array_to_string(list_sort(g.g), chr(10))) = k.h"""
