"""Near-duplicate detection by a chosen-path set similarity join.

Texts are sets of word shingles. Equal sets are one class. Each class has a sketch of minwise tokens. In each of
several independent trees a document goes down to the node of its minwise token; nodes with many documents branch
again by further tokens, small nodes are compared exhaustively. Sketches give loose groups only: every link is
confirmed on the full sets, which are made from the whole texts once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framecv.llm.bloom import filter_bits, held_bits, possibly_held
from framecv.llm.common import quoted
from framecv.llm.components import connected_components
from framecv.llm.shingles import GOLDEN, mix, numbers, shingle_sets
from framecv.session import materialize

SKETCH = 64
LEAF = 128
RESULT = ("n_shingles", "component_id", "kept")


def trees_for(percent: int, recall: float) -> int:
    """Trees until a pair of just the threshold has met with the given probability."""
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(percent, 99) / 100)))


def bounds(percent: int) -> tuple[float, float]:
    """Estimated similarities: from the first on, two documents are in one loose group; from the second on, a
    document's partners are all similar enough to its leader to be in the leader's group, and it needs no
    further comparison (Jaccard distance obeys the triangle inequality; three deviations are allowed for)."""
    far = 1 - percent / 100
    return max(0.2, 1 - 2 * far - 0.15), min(1.0, 1 - far + 0.08)


# ---- sketches --------------------------------------------------------------------------------

def _sketch(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = None
    with np.errstate(over="ignore"):
        for i in range(0, len(values), 4096):
            part = mix(values[i:i + 4096, None] ^ factors[None, :]).min(axis=0)
            low = part if low is None else np.minimum(low, part)
    return low


def sketch_texts(df: DataFrame, words: int, trees: int) -> DataFrame:
    """(id, text) to id, n, two digests of the set, the minwise token of each tree, and 64 tokens of 16 bits."""
    factors = numbers(5, trees + SKETCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, nodes, marks = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(s * GOLDEN).sum(dtype=np.uint64).view(np.int64)))
                if len(s):
                    low = _sketch(s, factors)
                    nodes.append(low[:trees].view(np.int64).tolist())
                    marks.append((low[trees:] >> np.uint64(20)).astype(np.uint16).tobytes())
                else:
                    nodes.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(nodes, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["id", "n", "one", "two", "nodes", "sketch"])

    kind = dict(df.dtypes)["id"]
    return df.mapInArrow(run, f"id {kind}, n bigint, one bigint, two bigint, nodes array<bigint>, sketch binary")


# ---- trees -----------------------------------------------------------------------------------

def leader_links(rows: np.ndarray, marks: np.ndarray, group: np.ndarray, loose: float, out: list, rounds: int) -> None:
    """Compare leaders, one after the other, with the rows that are not in their group yet, and unite the groups of
    rows that are loosely similar. One link is kept for each union, so a node of n rows gives less than n links."""
    for leader in rows[:rounds]:
        apart = rows[group[rows] != group[leader]]
        if not len(apart):
            continue
        same = (marks[apart] == marks[leader]).sum(axis=1) / SKETCH
        for x in apart[same >= loose]:
            if group[x] != group[leader]:
                out.append((int(leader), int(x)))
                own = rows[group[rows] == group[x]]
                group[own] = group[leader]


def branch(rows: np.ndarray, marks: np.ndarray, group: np.ndarray, loose: float, seed: int, depth: int, out: list) -> None:
    """A node of the tree: nothing to do if its rows are one group already; exhaustive when small; else a few leaders are
    compared, and all go down along two tokens that the node's seed selects. Deep nodes are compared exhaustively at
    any size."""
    if (group[rows] == group[rows[0]]).all():
        return
    if len(rows) <= LEAF or depth >= 8:
        leader_links(rows, marks, group, loose, out, len(rows))
        return
    leader_links(rows, marks, group, loose, out, 8)
    for place in (numbers(seed, 2) % np.uint64(SKETCH)).tolist():
        order = rows[np.argsort(marks[rows, place], kind="stable")]
        cuts = np.flatnonzero(np.diff(marks[order, place])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                branch(part, marks, group, loose, (seed * 31 + place + 7) & 0x7FFFFFFF, depth + (1 if len(part) < len(rows) else 2), out)


def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column to tables that each hold whole keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _marks(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SKETCH)


def node_links(nodes: DataFrame, loose: float) -> DataFrame:
    """nodes(node, id, sketch) of bounded nodes to loose links(a, b)."""
    def run(batches):
        for table in by_key(batches):
            keys = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            heads, ends = np.append(0, cuts), np.append(cuts, len(keys))
            several = np.flatnonzero(ends - heads > 1)
            if not len(several):
                continue
            marks, group, out = _marks(table.column(2)), np.arange(len(keys)), []
            for k in several.tolist():
                branch(np.arange(heads[k], ends[k]), marks, group, loose, int(keys[heads[k]] & 0x7FFFFFFF), 1, out)
            if out:
                pairs, ids = np.array(out), table.column(1).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), ids.take(pa.array(pairs[:, 1]))], ["a", "b"])

    kind = dict(nodes.dtypes)["id"]
    return nodes.repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, f"a {kind}, b {kind}")


def loose_links(sketches: DataFrame, trees: int, loose: float, near: float, most: int) -> DataFrame:
    """Links between classes that may be similar, from all trees.

    A node of more than `most` rows is not given to one task: eight leaders per node are found with a map-side
    combine and compared where the rows are, the rows that are near to one go, and the rest branches once more.
    """
    seeds = F.arrays_zip(F.sequence(F.lit(0), F.lit(trees - 1)).alias("tree"), F.col("nodes").alias("token"))
    rows = sketches.select("id", "sketch", F.explode(seeds).alias("t")).select(
        F.xxhash64("t.tree", "t.token").alias("node"), "id", "sketch")
    found, level = [], 0
    while True:
        hot = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node"))
        if hot.isEmpty():
            found.append(node_links(rows, loose))
            break
        if not level:
            rows = materialize(rows)  # it is read twice more
        found.append(node_links(rows.join(hot, "node", "left_anti"), loose))
        crowd = rows.join(hot, "node")
        leaders = (crowd.groupBy("node", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(8)).alias("part"))
                   .agg(F.min(F.struct("id", "sketch")).alias("l")).groupBy("node").agg(F.collect_list("l").alias("leaders")))
        compared = materialize(_compare(crowd.join(materialize(leaders), "node"), loose, near))
        found.append(compared.select("id", F.explode("links").alias("b")).select(F.col("id").alias("a"), "b"))
        level += 1
        place = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SKETCH)).cast("int") for i in (1, 2)]))
        rows = materialize(compared.where("stays").select("node", "id", "sketch", place.alias("place")).select(
            F.xxhash64("node", "place", F.substring(F.col("sketch"), F.col("place") * 2 + 1, F.lit(2))).alias("node"), "id", "sketch"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _compare(rows: DataFrame, loose: float, near: float) -> DataFrame:
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            marks = _marks(batch.column(batch.schema.get_field_index("sketch")))
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            links, stays = [], []
            for own, mark, leaders in zip(ids, marks, batch.column(batch.schema.get_field_index("leaders")).to_pylist()):
                other = np.frombuffer(b"".join(x["sketch"] for x in leaders), np.uint16).reshape(-1, SKETCH)
                same = (other == mark).sum(axis=1) / SKETCH
                links.append([x["id"] for x, s in zip(leaders, same) if s >= loose and x["id"] != own])
                stays.append(bool(same.max() < near))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("node")), pa.array(ids, batch.schema.field("id").type),
                 batch.column(batch.schema.get_field_index("sketch")), pa.array(links, pa.list_(batch.schema.field("id").type)),
                 pa.array(stays)], ["node", "id", "sketch", "links", "stays"])

    return rows.select("node", "id", "sketch", "leaders").mapInArrow(
        run, f"node bigint, id {kind}, sketch binary, links array<{kind}>, stays boolean")


# ---- exact sets ------------------------------------------------------------------------------

def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all components of the sets under 100 * intersection >= percent * union.

    A pivot is compared with every set that may be similar: one of its rarest tokens must be shared, or too few are.
    The sets that it links need not be pivots. Two sets linked by different pivots can only be similar if the
    pivots are at most three thresholds apart; such pairs of stars that are not connected yet are compared in full.
    So every component is found, not every pair.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(token, np.cumsum(sizes)[:-1])
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(n), sizes)[order]
    at = np.searchsorted(token[order], np.arange((int(token.max()) + 1 if len(token) else 0) + 1))
    common = np.diff(at)
    root = list(range(n))
    out: list[tuple[int, int]] = []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x, y):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))

    def similar(x, least):
        """The sets, x included, with 100 * intersection >= least * union."""
        held = own[x][np.argsort(common[own[x]], kind="stable")]
        # a similar set shares ceil(least / 100 * size) tokens, so one of the others and one more
        probe = held[:len(held) - (least * len(held) + 99) // 100 + 1]
        if common[probe].sum() <= 64:
            found = np.unique(np.concatenate([holder[at[t]:at[t + 1]] for t in probe]))
            inter = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in found])
        else:
            inter = np.zeros(n, np.int64)
            for t in held.tolist():
                inter[holder[at[t]:at[t + 1]]] += 1
            found = np.flatnonzero(inter)
            inter = inter[found]
        return found[100 * inter >= least * (sizes[found] + sizes[x] - inter)]

    central = np.array([common[t].mean() if len(t) else 0 for t in own])
    covered, star = np.zeros(n, bool), {}
    for p in np.lexsort((np.arange(n), -central)).tolist():
        if covered[p] or not sizes[p]:
            continue
        linked = similar(p, percent)
        fresh = linked[~covered[linked]]
        covered[linked] = True
        if len(fresh) > 1:
            star[p] = fresh  # a pivot alone has met all its partners
        for x in linked.tolist():
            join(p, x)
    for p in star:
        for q in similar(p, max(1, 100 - 3 * (100 - percent))).tolist():
            if q >= p or q not in star or find(p) == find(q):
                continue
            few, many = sorted((p, q), key=lambda x: len(star[x]))
            for x in star[few].tolist():
                for y in np.intersect1d(similar(x, percent), star[many]).tolist():
                    join(x, y)
                if find(p) == find(q):
                    break
    return out


def group_links(groups: DataFrame, words: int, percent: int) -> DataFrame:
    """groups(group, id, text), each of bounded size, to confirmed links(a, b)."""
    kind = dict(groups.dtypes)["id"]

    def run(batches):
        for table in by_key(batches):
            keys = table.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for head, end in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist()):
                if end - head < 2:
                    continue
                part = table.slice(head, end - head)
                sets = [s for chunk in part.column(2).chunks for s in shingle_sets(chunk, words)]
                links = exact_links(sets, percent)
                if links:
                    pairs, ids = np.array(links), part.column(1).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), ids.take(pa.array(pairs[:, 1]))], ["a", "b"])

    return groups.select("group", "id", "text").repartition("group").sortWithinPartitions("group", "id").mapInArrow(
        run, f"a {kind}, b {kind}")


def _pivot_rates(rows: DataFrame, words: int) -> DataFrame:
    """rows(group, id, text, pivot, pivot_text) and their similarity to the pivot, as intersection and union."""
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            known: dict = {}
            inter, union = [], []
            for s, p, text in zip(shingle_sets(column["text"], words), column["pivot"].to_pylist(), column["pivot_text"]):
                if p not in known:
                    known = {p: next(shingle_sets(pa.array([text.as_py()], pa.string()), words))}
                both = len(np.intersect1d(s, known[p], assume_unique=True))
                inter.append(both)
                union.append(len(s) + len(known[p]) - both)
            yield pa.RecordBatch.from_arrays(
                [column["group"], column["id"], column["text"], column["pivot"], pa.array(inter, pa.int64()), pa.array(union, pa.int64())],
                ["group", "id", "text", "pivot", "inter", "union"])

    return rows.select("group", "id", "text", "pivot", "pivot_text").mapInArrow(
        run, f"group bigint, id {kind}, text string, pivot {kind}, inter bigint, union bigint")


def confirmed_links(groups: DataFrame, words: int, percent: int, most_bytes: int) -> DataFrame:
    """Confirmed links of loose groups of any size.

    A group with more than most_bytes of text is not given to one task. Its smallest id is a pivot; each row is
    compared with it where it is. Rows linked to the pivot are settled among themselves; they are compared in
    slices with those within two thresholds of the pivot, and can have no link to the rows beyond. All rows that are
    not linked to the pivot go on as a group of their own, until it is small.
    """
    found, rest, rounds = [], groups, 0
    while True:
        sizes = materialize(rest.groupBy("group").agg(F.sum(F.octet_length("text")).alias("size")).where(F.col("size") > most_bytes))
        if sizes.isEmpty():
            found.append(group_links(rest, words, percent))
            break
        found.append(group_links(rest.join(sizes, "group", "left_anti"), words, percent))
        crowd = rest.join(sizes.select("group"), "group")
        first = crowd.groupBy("group").agg(F.min(F.struct("id", "text")).alias("p")).select(
            "group", F.col("p.id").alias("pivot"), F.col("p.text").alias("pivot_text"))
        rated = materialize(_pivot_rates(crowd.join(materialize(first), "group"), words))
        linked = F.expr(f"100 * inter >= {percent} * union")
        halo = F.expr(f"100 * inter >= {100 - 2 * (100 - percent)} * union") & ~linked
        found.append(rated.where(linked & (F.col("id") != F.col("pivot"))).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        cells = materialize(rated.groupBy("group").agg(
            F.ceil(F.coalesce(F.sum(F.when(linked, F.octet_length("text"))), F.lit(0)) * 2 / most_bytes).cast("int").alias("inner"),
            F.ceil(F.coalesce(F.sum(F.when(halo, F.octet_length("text"))), F.lit(0)) * 2 / most_bytes).cast("int").alias("outer")).where("outer > 0 and inner > 0"))
        sliced = rated.join(cells, "group")
        spot = F.xxhash64("id", F.lit(rounds))
        inside = sliced.where(linked).select("group", "id", "text", F.pmod(spot, F.col("inner")).cast("int").alias("i"), F.explode(F.expr("sequence(0, outer - 1)")).alias("j"))
        outside = sliced.where(halo).select("group", "id", "text", F.explode(F.expr("sequence(0, inner - 1)")).alias("i"), F.pmod(spot, F.col("outer")).cast("int").alias("j"))
        meeting = inside.unionByName(outside).select(F.xxhash64("group", "i", "j").alias("group"), "id", "text")
        found.append(group_links(meeting, words, percent))
        rest = rated.where(~linked).select("group", "id", "text")
        rounds += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# ---- the operator ----------------------------------------------------------------------------

def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                    recall: float = 0.99999, most_rows: int = 16_384, most_bytes: int = 64_000_000) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: components of the links between texts whose sets of
    word shingles fulfil 100 * intersection >= percent * union.

    component_id is the smallest id that can be reached, the row's own included; kept says that the id is it.
    Null texts and texts without words have no shingles and no links. Texts with equal sets are linked. Rows
    with one id are one document. A row with a null id is linked with nothing, has a null component and is kept.
    An empty table gives an empty result. most_rows and most_bytes bound what one task holds of a node or a loose
    group; larger ones are split, see loose_links and confirmed_links.
    """
    trees = trees_for(percent, recall)
    loose, near = bounds(percent)
    texts = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    sketches = materialize(sketch_texts(texts, words, trees))
    sets = sketches.where("n > 0 and id is not null")
    classes = materialize(sets.groupBy("one", "two").agg(F.min(F.struct("id", "nodes", "sketch")).alias("r"))
                          .select("one", "two", "r.id", "r.nodes", "r.sketch"))
    groups = materialize(connected_components(loose_links(classes.select("id", "nodes", "sketch"), trees, loose, near, most_rows)))
    bits = filter_bits(groups.count())
    held = materialize(held_bits(groups, "id", bits))
    maybe = possibly_held(texts.where("id is not null"), "id", held, bits, "_maybe").where("_maybe")
    members = maybe.select("id", "text").join(groups.select("id", F.xxhash64("component").alias("group")).hint("shuffle_hash"), "id").select("group", "id", "text")
    links = confirmed_links(members, words, percent, most_bytes)
    found = materialize(connected_components(links))
    copies = sets.select("id", "one", "two").join(classes.select("one", "two", F.col("id").alias("rep")), ["one", "two"]).where("id != rep")
    twins = materialize(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    rooted = twins.join(found.select(F.col("id").alias("b"), "component"), "b", "left").select(
        F.col("a").alias("id"), F.coalesce("component", "b").alias("component"))
    place = found.unionByName(rooted).groupBy("id").agg(F.min("component").alias("component_id"))
    out = sketches.select("id", F.col("n").alias("n_shingles")).join(place, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, **more) -> DataFrame:
    """The rows of df whose document is the smallest id of its component, with the columns of df."""
    gone = materialize(near_components(df, id_col, text_col, words, percent, **more).where("not kept")
                       .select(F.col(id_col).alias("_gone")).distinct())
    return df.join(gone, quoted(id_col) == F.col("_gone"), "left_anti")
