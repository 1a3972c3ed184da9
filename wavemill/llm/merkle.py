"""A Merkle manifest of a dataset: a digest for each row, a tree for each group, a tree of the groups' tops.

Levels are made by windows. Nodes of a group stand in order; every FAN consecutive ones share (group, parent
index), and one ordered, full-frame ``collect_list`` over that key is both the preimage of the parent and
the list of siblings. One row of each run stays, so parents are unique before the next level. Levels
number log16 of the largest group. From the tops down each node then gets the siblings of its ancestors, by joins whose keys are
unique, and rows of one run share them until the last step.

No key holds more than FAN rows at any level, whatever the groups' sizes: nodes are numbered by ranges of (group, order)
over all tasks (:func:`wavemill.llm.shared.places`), never by a window over a group. Each level is a
reliable checkpoint of narrow rows; texts are read once.

Defined results: a null field is ``-``, so it differs from an empty one; rows are ordered by id within their group (null first),
those that share an id by their digests; rows alike in all hashed fields are leaves each; a null group is a
group of its own, before all others; a group of one row has its leaf for a top; an empty table gives an empty result; texts
of any length are hashed whole; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.llm.shared import places, require_columns, settle

#: Nodes that become one parent.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row: sha256 of its fields, each ``-`` if null, else its UTF-8 bytes' number, a colon and the value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, fields)), 256)


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["digest"]), "")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (g, place, n nodes of the group, member: a struct with ``digest``), and each group's top: g, digest.

    A level has a row for each run: g, place of the parent, n parents of the group, members, digest of the parent.
    """
    levels, tops = [], nodes.where("n = 1").select("g", F.col("member.digest").alias("digest"))
    while not (open_ := nodes.where("n > 1")).isEmpty():
        run = Window.partitionBy("g", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = open_.withColumn("parent", F.expr(f"place div {FAN}")).withColumn("members", F.collect_list("member").over(run))
        met = met.where(F.col("place") % FAN == 0)  # one row of each run
        level = settle(met.select("g", F.col("parent").alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "members", F.sha2(_joined(F.col("members")), 256).alias("digest")))
        levels.append(level)
        tops = tops.unionByName(level.where("n = 1").select("g", "digest"))
        nodes = level.select("g", "place", "n", F.struct("digest").alias("member"))
    return levels, tops


def _descend(levels: list[DataFrame], heads: DataFrame) -> DataFrame | None:
    """Members of the lowest level, each with ``path``: what stands before and after it and its ancestors, from below.

    ``heads``: g, path above the group's top, and further columns that its members get too.
    """
    known, more = None, [c for c in heads.columns if c not in ("g", "path")]
    for level in reversed(levels):
        runs = level.where("n = 1").drop("n", "digest").join(heads, "g")  # the level where the group ends
        if known is not None:
            runs = runs.unionByName(level.where("n > 1").drop("n", "digest").join(known, ["g", "place"]))
        each = runs.select("*", F.posexplode("members").alias("i", "member"))
        aside = F.struct(_joined(F.slice("members", F.lit(1), F.col("i"))).alias("before"), _joined(F.slice("members", F.col("i") + 2, F.lit(FAN))).alias("after"))
        each = each.select("g", (F.col("place") * FAN + F.col("i")).alias("place"), "member", F.concat(F.array(aside), "path").alias("path"), *more)
        known = each.drop("member")
    return each if levels else None


def merkle_proofs(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """A row for each row of ``docs``: id, leaf, subroot, root, path, and the columns ``carried``.

    ``path`` has an element (before, after) for each level up to the root: the digests beside the node, joined.
    """
    require_columns(docs, [*fields, id_col, group_col])
    carried = dict(carried or {})
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))  # null first, then bytewise
    leaves = docs.select(group.alias("g"), F.col(id_col).alias("_id"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(f"_c_{k}") for k, c in carried.items()])
    leaves = settle(leaves.withColumn("_row", F.monotonically_increasing_id()))
    member = F.struct("digest", "_id", *[f"_c_{k}" for k in carried]).alias("member")
    nodes = places(leaves, ["_id", "digest", "_row"], "g").select("g", "place", "n", member)
    levels, tops = _climb(nodes)
    tops = settle(tops)
    groups = places(tops, ["g"]).select(F.lit("").alias("g"), "place", "n", F.struct("digest", F.col("g").alias("of")).alias("member"))
    upper, root = _climb(groups)
    top = root.first()
    none = F.array().cast(PATH)
    over = _descend(upper, root.select("g", none.alias("path")))
    if over is None:  # one group or none
        heads = groups.select(F.col("member.of").alias("g"), F.col("member.digest").alias("subroot"), none.alias("path"))
    else:
        heads = over.select(F.col("member.of").alias("g"), F.col("member.digest").alias("subroot"), "path")
    heads = settle(heads)
    alone = nodes.where("n = 1").join(heads, "g").select("member", "subroot", "path")
    below = _descend(levels, heads)
    rows = alone if below is None else alone.unionByName(below.select("member", "subroot", "path"))
    return rows.select(
        F.col("member._id").alias(id_col),
        F.col("member.digest").alias("leaf"),
        "subroot",
        F.lit(top["digest"] if top else None).cast("string").alias("root"),
        "path",
        *[F.col(f"member._c_{k}").alias(k) for k in carried],
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(path, leaf, lambda node, beside: F.sha2(F.concat(beside["before"], node, beside["after"]), 256))


def proof_text(path: Column) -> Column:
    """All digests of a path, joined: level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


#: Levels of either tree in :func:`merkle_sql`; 16 to this power leaves or groups.
SQL_LEVELS = 5


def merkle_sql() -> str:
    """The query over ``documents`` in DuckDB SQL, with its levels written out."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_reduce(range(0, 8 * strlen(s)), lambda c, i: {step}, 4294967295)"
    byte = "case when i % 8 = 0 then xor(c, ascii(s[(i // 8 + 1)::int])::bigint) else c end"
    crc = f"xor({bits.format(step=f'case when ({byte}) & 1 = 1 then xor(({byte}) >> 1, 3988292384) else ({byte}) >> 1 end')}, 4294967295)"

    def tree(name: str, start: str) -> str:
        """``name``0 .. are levels: g, i, n, d. A group that has ended keeps its one node."""
        parts = [f"{name}0 as ({start})"]
        for k in range(1, SQL_LEVELS + 1):
            parts.append(
                f"{name}{k} as (select g, i // {FAN} i, (any_value(n) + {FAN - 1}) // {FAN} n, sha256(string_agg(d, '' order by i)) d from {name}{k - 1} where n > 1 group by g, i // {FAN}"
                f" union all select g, i, n, d from {name}{k - 1} where n = 1)"
            )
        return ",\n".join(parts)

    def walk(out: str, name: str, start: str, key: str) -> str:
        """Adds the siblings of each level to ``proof`` and folds ``f``."""
        parts = [f"{out}0 as ({start})"]
        for k in range(SQL_LEVELS):
            parts.append(
                f"{out}{k + 1} as (select x.* exclude (i, f, proof), x.i // {FAN} i, case when o.n > 1 then sha256(coalesce(o.b, '') || x.f || coalesce(o.a, '')) else x.f end f,"
                f" case when o.n > 1 then x.proof || coalesce(o.b, '') || coalesce(o.a, '') else x.proof end proof from {out}{k} x join {name}{k}_o o on o.g = x.{key} and o.i = x.i)"
            )
        return ",\n".join(parts)

    def beside(name: str) -> str:
        run = "over (partition by g, i // 16 order by i rows between {} )"
        return ",\n".join(
            f"{name}{k}_o as (select g, i, n, string_agg(d, '') {run.format('unbounded preceding and 1 preceding')} b, string_agg(d, '') {run.format('1 following and unbounded following')} a from {name}{k})"
            for k in range(SQL_LEVELS)
        )

    return f"""
with r as (select coalesce('s' || source, '') g, doc_id, sha256({head} || {field("text")}) d, sha256({head} || {field(lower)}) e, doc_id::varchar s from documents),
leaf as (select g, doc_id, d, case when ({crc}) % 5 = 0 then e else d end f,
                row_number() over (partition by g order by doc_id nulls first, d) - 1 i, count(*) over (partition by g) n from r),
{tree("l", "select g, i, n, d from leaf")},
tops as (select g, d from l{SQL_LEVELS}),
{tree("t", "select 0 g, row_number() over (order by g) - 1 i, count(*) over () n, d from tops")},
whole as (select d root from t{SQL_LEVELS}),
{beside("l")},
{beside("t")},
{walk("a", "l", "select g, doc_id, d leaf, i, f, '' proof from leaf", "g")},
placed as (select g, d subroot, row_number() over (order by g) - 1 i from tops),
{walk("b", "t", f"select a.doc_id, a.leaf, p.subroot, a.f, a.proof, p.i, 0 g from a{SQL_LEVELS} a join placed p using (g)", "g")}
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, f folded_root, f = root verified from b{SQL_LEVELS}, whole"""
