"""Embedding near-dedup by dual traversal of cover trees.

Vectors are compared as unit vectors, where a cosine of at least c is a distance of at most
reach = sqrt(2 - 2 c). Equal vectors of a label are one class with a count.

The upper levels of a label's tree are tables. A node with over CHUNK members gets up to
CHILDREN centres, two for each CHUNK of them, of the finest of nested covers of a sample, whose radii halve from level to
level; each member goes to its nearest centre, and the covering radius is the largest
distance of all its members. A member also visits the children after its own whose
covering radius and the reach don't rule them out, and a visitor goes on only to children
where the same holds; so pairs of nodes are pruned before any row moves. Every pair within
reach meets once, in the child of the later one.

What arrives at a leaf, members and visitors in parts of about CHUNK, is compared by trees in
memory: nested levels, where every node of radius r is divided among children within r / 2.
Pairs of nodes descend together; a pair whose distance is over both covering radii and the
reach is pruned, and one that is under it with both radii added is linked as a whole. What is
left at the leaves is compared exactly. A group gives back a count for each class, and a
forest of its links, never pairs.

Defined results: a vector that is null, empty, zero, or has a null or non-finite component,
or whose label is null, links with nothing and is its own component. Vectors of different
length don't link. Components of any finite size are fine. Rows with equal vec_ids stay
separate rows. A null vec_id counts as the largest; where a component has no other,
component_id is null and kept is false. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, ddl, keep, load
from .components import components, unite

CHUNK, CHILDREN, SAMPLE = 2048, 32, 512
#: Levels of nodes as tables. What is larger after them, such as very many vectors within reach of each other, is compared in parts.
LEVELS = 12
BROADCAST_ROWS = 100_000
SLACK = 1e-7
FOUND = [("rep", "long"), ("n", "long"), ("parent", "long")]


class CoverTree:
    """levels: for each level the nodes' points (centres), covering radii, and the nodes' children on the next."""

    def __init__(self, x: np.ndarray, smallest: float):
        self.x = x
        n = len(x)
        owner = np.zeros(n, np.int64)  # of each point: its node on the level
        self.centre = [np.zeros(1, np.int64)]
        distance = self.apart(np.zeros(n, np.int64))
        self.cover = [np.array([distance.max(initial=0.0)])]
        self.owner = [owner]
        radius = 1.0
        while radius > smallest and (self.cover[-1] > 0).any():
            owner, centres = np.zeros(n, np.int64), []
            order = np.argsort(self.owner[-1], kind="stable")
            starts = np.flatnonzero(np.diff(self.owner[-1][order], prepend=-1))
            for node, members in enumerate(np.split(order, starts[1:])):
                c = self.centre[-1][node]
                if len(members) == 1 or self.cover[-1][node] == 0:
                    owner[members] = len(centres)
                    centres.append(c)
                    continue
                # the node's own centre comes first, so levels are nested
                left = np.concatenate([[c], members[members != c]])
                while len(left):
                    near = self.within(left, radius)
                    owner[left[near]] = len(centres)
                    centres.append(left[0])
                    left = left[~near]
            self.centre.append(np.array(centres))
            self.owner.append(owner)
            far = np.zeros(len(centres))
            np.maximum.at(far, owner, self.apart(self.centre[-1][owner]))
            self.cover.append(far)
            radius /= 2
        self.children = []
        for upper, lower in zip(self.owner[:-1], self.owner[1:], strict=True):
            parent = np.zeros(lower.max() + 1, np.int64)
            parent[lower] = upper
            self.children.append(grouped(parent, upper.max() + 1))
        self.members = grouped(self.owner[-1], len(self.centre[-1]))

    def apart(self, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", self.x, self.x[centre])))

    def within(self, points: np.ndarray, radius: float) -> np.ndarray:
        near = self.x[points] @ self.x[points[0]] >= 1 - radius * radius / 2
        near[0] = True
        return near


def grouped(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(members in order of their group, where each group starts and one more)"""
    return np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))])


def crossed(a: np.ndarray, b: np.ndarray, of_a, of_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a member of group a[i] with one of group b[i]."""
    (ma, sa), (mb, sb) = of_a, of_b
    na, nb = sa[a + 1] - sa[a], sb[b + 1] - sb[b]
    size = na * nb
    at = np.repeat(np.arange(len(a)), size)
    within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    return ma[sa[a][at] + within // nb[at]], mb[sb[b][at] + within % nb[at]]


def pair_blocks(a: np.ndarray, b: np.ndarray, of_a, of_b, block: int = 1 << 19):
    """crossed(), some pairs at a time; a pair of two large groups is divided by rows."""
    size = (of_a[1][a + 1] - of_a[1][a]) * (of_b[1][b + 1] - of_b[1][b])
    lo, total = 0, np.cumsum(size)
    while lo < len(a):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + block, "right")))
        if hi == lo + 1 and size[lo] > block:
            rows = of_a[0][of_a[1][a[lo]] : of_a[1][a[lo] + 1]]
            others = of_b[0][of_b[1][b[lo]] : of_b[1][b[lo] + 1]]
            yield rows, others, True
        else:
            yield *crossed(a[lo:hi], b[lo:hi], of_a, of_b), False
        lo = hi


def traverse(a: CoverTree, b: CoverTree, same: bool, threshold: float):
    """Yields (points of a, points of b) that are linked; of a pair within one tree, each order once."""
    reach = math.sqrt(2 - 2 * threshold)
    na, nb = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a.centre), len(b.centre)) - 1):
        la, lb = min(level + 1, len(a.centre) - 1), min(level + 1, len(b.centre) - 1)
        of_a = a.children[level] if level < len(a.children) else stay(len(a.centre[la]))
        of_b = b.children[level] if level < len(b.children) else stay(len(b.centre[lb]))
        ra, rb, ca, cb = a.cover[la], b.cover[lb], a.centre[la], b.centre[lb]
        out_a, out_b = [], []
        for x, y, whole in pair_blocks(na, nb, of_a, of_b):
            if whole:  # a block of all with all: one matrix product for some rows
                for at in range(0, len(x), 512):
                    rows = x[at : at + 512]
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (a.x[ca[rows]] @ b.x[cb[y]].T)))
                    i, j = np.nonzero(d <= ra[rows][:, None] + rb[y][None, :] + reach + SLACK)
                    out_a.append(rows[i])
                    out_b.append(y[j])
            else:
                d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a.x[ca[x]], b.x[cb[y]])))
                near = d <= ra[x] + rb[y] + reach + SLACK
                out_a.append(x[near])
                out_b.append(y[near])
        if not out_a:
            return
        na, nb = np.concatenate(out_a), np.concatenate(out_b)
        if same:
            first = na <= nb
            na, nb = na[first], nb[first]
    ra, rb = a.cover[-1], b.cover[-1]
    d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a.x[a.centre[-1][na]], b.x[b.centre[-1][nb]])))
    inside = d + ra[na] + rb[nb] <= reach - SLACK  # all pairs of the two nodes link
    for pick, sure in ((inside, True), (~inside, False)):
        for x, y, whole in pair_blocks(na[pick], nb[pick], a.members, b.members):
            if whole:
                x, y = np.repeat(x, len(y)), np.tile(y, len(x))
            for at in range(0, len(x), 1 << 18):
                p, q = x[at : at + (1 << 18)], y[at : at + (1 << 18)]
                if not sure:
                    near = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= threshold
                    p, q = p[near], q[near]
                if same:
                    once = p < q
                    both = na_equal(a, p, q)
                    # pairs of one leaf come in both orders, pairs of two leaves in one
                    swap = (p > q) & ~both
                    p, q = np.where(swap, q, p)[once | swap], np.where(swap, p, q)[once | swap]
                yield p, q


def na_equal(tree: CoverTree, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return tree.owner[-1][p] == tree.owner[-1][q]


def stay(n: int):
    return np.arange(n), np.arange(n + 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, as squares of very large or small components leave the range of doubles."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def vectors_of(rows) -> np.ndarray:
    return unit(np.stack(rows.v.to_numpy()).astype(np.float64))


def compare_group(rows, threshold: float):
    """rows: (rep, times, side, v). Pairs of one side with the other, or within side 0 if that is all the group is for (`within`)."""
    import pandas as pd

    rows = rows.sort_values("rep")
    x, within = vectors_of(rows), bool(rows.within.iloc[0])
    rep, times, side = rows.rep.to_numpy(), rows.times.to_numpy(), rows.side.to_numpy()
    n, parent = np.zeros(len(x), np.int64), np.arange(len(x))
    at = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    if len(at[0]) and (within or len(at[1])):
        trees = [CoverTree(x[i], math.sqrt(2 - 2 * threshold) / 4) for i in at if len(i)]
        for p, q in traverse(trees[0], trees[-1], within, threshold):
            p, q = at[0][p], at[0 if within else 1][q]
            n += np.bincount(p, weights=times[q], minlength=len(x)).astype(np.int64)
            n += np.bincount(q, weights=times[p], minlength=len(x)).astype(np.int64)
            parent = unite(parent, p, q)
    some = n > 0
    return pd.DataFrame({"rep": rep[some], "n": n[some], "parent": rep[parent[some]]})


# --- upper levels ---------------------------------------------------------------------------------


def cover(x: np.ndarray, radius: float, most: int) -> list[int]:
    """Points that have all of x within the radius; stops over `most`."""
    left, centres = np.arange(len(x)), []
    while len(left) and len(centres) <= most:
        centres.append(int(left[0]))
        left = left[np.einsum("ij,ij->i", x[left] - x[left[0]], x[left] - x[left[0]]) > radius * radius]
    return centres


def pick_centres(rows, chunk: int, children: int):
    """One row: the node and its centres, from a sample of its members. The finest cover of at most as many as leave half a chunk to each, else the first of several."""
    import pandas as pd

    x = vectors_of(rows.sort_values("rep"))
    children = max(2, min(children, -(-2 * int(rows.n_members.iloc[0]) // chunk)))
    radius, chosen = 1.0, [0]
    while radius > 1e-9:
        finer = cover(x, radius, children)
        if len(finer) > children:
            chosen = chosen if len(chosen) > 1 else finer[:children]
            break
        chosen, radius = finer, radius / 2
    return pd.DataFrame({"node": [rows.node.iloc[0]], "centres": [x[chosen].ravel()], "n": [len(chosen)]})


def distances(rows, centres) -> np.ndarray:
    x, n = vectors_of(rows), int(centres.n.iloc[0])
    c = np.asarray(centres.centres.iloc[0], np.float64).reshape(n, -1)
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ c.T)))


def reach_of_members(rows, centres):
    """(node, child, radius) of these members: each child's farthest one."""
    import pandas as pd

    if not len(rows):
        return pd.DataFrame({c: np.zeros(0, object) for c in ("node", "child", "radius")})
    d = distances(rows, centres)
    own = d.argmin(axis=1)
    radius = np.full(d.shape[1], -1.0)
    np.maximum.at(radius, own, d[np.arange(len(d)), own])
    return pd.DataFrame({"node": rows.node.iloc[0], "child": np.arange(len(radius)), "radius": radius})


def descend(rows, centres, reach: float):
    """rows to the children: members to their own and, as visitors, to later ones that they may have links in; visitors to all such."""
    import pandas as pd

    if not len(rows):
        return pd.DataFrame({c: np.zeros(0, object) for c in ("node", "rep", "times", "v", "member")})
    d, member = distances(rows, centres), rows.member.to_numpy(bool)
    radius = np.asarray(centres.radius.iloc[0], np.float64)
    own = d.argmin(axis=1)
    visits = (d <= radius + reach + SLACK) & (radius >= 0)
    visits &= ~member[:, None] | (np.arange(d.shape[1]) > own[:, None])
    at, child = np.nonzero(visits)
    mine = np.flatnonzero(member)
    at, child, stays = np.concatenate([mine, at]), np.concatenate([own[mine], child]), np.arange(len(mine) + len(at)) < len(mine)
    out, node = rows.iloc[at].reset_index(drop=True), rows.node.iloc[0]
    return out.assign(node=np.array([f"{node}/{c}" for c in child.tolist()], object), member=stays)[["node", "rep", "times", "v", "member"]]


def sized(small: DataFrame, n: int) -> DataFrame:
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def leaves(todo: DataFrame, reach: float, chunk: int, children: int) -> DataFrame:
    """(node, rep, times, v, member) of nodes with at most `chunk` members, but for those that LEVELS don't divide."""
    schema, out = "node string, rep long, times long, v array<double>, member boolean", []
    for level in range(LEVELS):
        sizes = todo.groupBy("node").agg(F.count_if("member").alias("n_members"), F.count("*").alias("n_rows"))
        large = keep(sizes.filter(F.col("n_members") > chunk))
        n = large.count()
        if not n:
            break
        out.append(todo.join(sized(large, n).select("node"), "node", "left_anti"))
        rows = todo.join(sized(large, n), "node")
        some = F.col("member") & (F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n_members")) < SAMPLE)
        centres = keep(rows.filter(some).groupBy("node").applyInPandas(lambda r: pick_centres(r, chunk, children), "node string, centres array<double>, n int"))
        # a node's rows in parts, each with the node's centres
        salts = F.ceil(F.col("n_rows") / (4 * chunk)).cast("int")
        dealt = rows.select("node", F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt"), "rep", "times", "v", "member")
        by = centres.join(large, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        radii = dealt.filter("member").groupBy("node", "salt").cogroup(by.groupBy("node", "salt")).applyInPandas(reach_of_members, "node string, child int, radius double")
        radii = keep(radii.groupBy("node", "child").agg(F.max("radius").alias("radius")))
        radii = radii.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("child", "radius"))), lambda x: x["radius"]).alias("radius"))
        by = by.join(radii, "node")
        todo = keep(dealt.groupBy("node", "salt").cogroup(by.groupBy("node", "salt")).applyInPandas(lambda a, b: descend(a, b, reach), schema))
    out.append(todo)
    union = out[0]
    for o in out[1:]:
        union = union.unionByName(o)
    return union


def compared(rows: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(rep, n, parent) of links within leaves: of members with each other, and of visitors with members."""
    sizes = keep(rows.groupBy("node").agg(F.count_if("member").alias("a"), F.count_if(~F.col("member")).alias("b")))
    rows = rows.join(sized(sizes, sizes.count()), "node")
    parts, visits = (F.ceil(F.col(c) / chunk).cast("int") for c in ("a", "b"))
    mine = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("member"), parts).otherwise(visits)).cast("int")
    each = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    group = lambda within, p, q, side: F.struct(within.alias("within"), p.alias("p"), q.alias("q"), side.cast("int").alias("side"))
    own = F.transform(each(parts), lambda i: group(mine == i, F.least(mine, i), F.greatest(mine, i), mine > i))
    # a part with itself is within; two parts of members are two sides, numbered below zero beside those of visitors
    own = F.transform(own, lambda g: F.struct(g["within"].alias("within"), (-1 - g["p"]).alias("p"), g["q"].alias("q"), g["side"].alias("side")))
    as_host = F.transform(each(visits), lambda i: group(F.lit(False), i, mine, F.lit(1)))
    as_guest = F.transform(each(parts), lambda i: group(F.lit(False), mine, i, F.lit(0)))
    rows = rows.select("node", "rep", "times", "v", F.explode(F.when(F.col("member"), F.concat(own, as_host)).otherwise(as_guest)).alias("g")).select("node", "rep", "times", "v", "g.*")
    # few bytes, much work: a stated number of partitions keeps them from being merged
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node", "p", "q")
    return rows.groupBy("node", "p", "q").applyInPandas(lambda r: compare_group(r, threshold), ddl(FOUND))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, chunk: int = CHUNK, children: int = CHILDREN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) from (vec_id, embedding, label)"""
    v = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    v = keep(v.withColumn("usable", usable).withColumn("class", F.when(usable, F.sha2(F.concat_ws("|", F.col("label"), F.to_json("v")), 256))))
    classes = v.filter("usable").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("v").alias("v"))
    # two classes may have the same smallest id, if ids aren't unique; a stored number names each
    classes = keep(classes.withColumn("name", F.monotonically_increasing_id()))
    c = classes.select(F.concat_ws("|", F.size("v"), "label").alias("node"), F.col("name").alias("rep"), "times", "v", F.lit(True).alias("member"))
    found = keep(compared(leaves(c, math.sqrt(2 - 2 * threshold), chunk, children), threshold, chunk))
    of = components(found.select(F.col("rep").alias("a"), F.col("parent").alias("b")))
    links = found.groupBy(F.col("rep").alias("name")).agg(F.sum("n").alias("others"))
    named = classes.select("name", "class", "rep", "times").join(links, "name", "left").join(of.withColumnRenamed("id", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    least = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    named = named.join(least, "component").select(F.col("class").alias("c"), (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("links"), "smallest")
    out = v.join(named, v["class"] == named["c"], "left")
    no_id = lambda c: F.when(c != NO_ID, c)
    component = F.coalesce("smallest", "vec_id")
    return out.select(
        no_id(F.col("vec_id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), no_id(component).alias("component_id"),
        ((F.col("vec_id") == component) & (F.col("vec_id") != NO_ID)).alias("kept"),
    )


def op1_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))
