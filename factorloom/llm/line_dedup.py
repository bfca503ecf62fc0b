"""Line deduplication by a deletion-neighbourhood join.

A line goes if an earlier line of the corpus is within ``edits`` (0 or 1)
character edits. Lines within one edit share a variant: both lose the character
at the same place (substitution), or one loses a character and becomes the other
(insertion). The variants of a line are hashed keys; what is looked for at a key
is the earliest line only, a minimum, so that many alike lines make no pairs;
the two lines are then verified: without those characters their texts are equal.

Which characters a line may lose is narrowed first. Cut into blocks, two lines
within one edit agree outside one block. A line and block whose outside agrees
with no other line has no neighbour there; what is left is cut again, until a
block is short. Its variants lose one character of the block, and their keys
combine the hash of the block's outside with that of the block. So a line of n
characters costs n for each cut, not n variants of n characters, and the search
loses nothing. All steps are SQL and DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, small, table, text_key, written

EDITS = 1
#: Blocks of the first cut, which every line gets, and of the later ones.
HALVES, BLOCKS = 2, 16
#: A block of so many characters is not cut any more.
SHORT = 48
#: A line of nothing else is blank.
BLANK = " \t\n\x0b\f\r"


def _cuts(outside: Column, start: Column, block: Column, blocks: int) -> Column:
    """(k, o, r) for each part of a block that starts at ``start``: the hash of all
    outside it, where it starts in the line, and the part. A block is cut as one of its own length is and as one of a character less is,
    where the character too many falls into the part."""

    def part(size: Column, extra: int, j: Column) -> Column:
        at, to = (F.floor(size * k / blocks).cast("int") for k in (j, j + 1))
        return F.struct(_key(outside, block, size, extra, j, blocks).alias("k"), (start + at).alias("o"), F.substring(block, at + 1, to - at + extra).alias("r"))

    return _each_part(block, blocks, part)


def _key(outside: Column, block: Column, size: Column, extra: int, j: Column, blocks: int) -> Column:
    at, to = (F.floor(size * k / blocks).cast("int") for k in (j, j + 1))
    return F.xxhash64(outside, size, j, F.substring(block, F.lit(1), at), F.substring(block, to + extra + 1, F.length(block)))


def _each_part(block: Column, blocks: int, part) -> Column:
    """``part`` of every block, for both sizes. Halves are written out, which keeps
    the cut that every line gets in generated code."""
    n = F.length(block)
    if blocks == HALVES:
        return F.array(*[part(size, extra, F.lit(j)) for size, extra in ((n, 0), (n - 1, 1)) for j in range(blocks)])
    places = F.sequence(F.lit(0), F.lit(blocks - 1))
    return F.concat(F.transform(places, lambda j: part(n, 0, j)), F.transform(places, lambda j: part(n - 1, 1, j)))


def _keys(outside: Column, block: Column, blocks: int) -> Column:
    return _each_part(block, blocks, lambda size, extra, j: _key(outside, block, size, extra, j, blocks))


def _shared(each: DataFrame) -> DataFrame:
    """The keys in column k that more than one line has."""
    return written(each.groupBy("k").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("k"), "shared_keys")


def _narrowed(blocks: DataFrame) -> DataFrame:
    """``blocks``: h, g of a line, k of what is outside a block, its start o, the block r. The
    same for their parts, as far as another line has the same outside."""
    while True:
        long = blocks.where(F.length("r") > SHORT)
        if long.isEmpty():
            return blocks
        shared = _shared(long.select("h", F.explode(_keys(F.col("k"), F.col("r"), BLOCKS)).alias("k")))
        parts = long.select("h", "g", F.explode(_cuts(F.col("k"), F.col("o"), F.col("r"), BLOCKS)).alias("s")).select("h", "g", "s.*")
        now = written(blocks.where(F.length("r") <= SHORT).union(parts.join(small(shared), "k", "left_semi").select("h", "g", "k", "o", "r")), "blocks")
        drop(shared, blocks)
        blocks = now


def _near(blocks: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """h, g of the distinct lines with an earlier neighbour."""
    n = F.length("r")
    key = lambda i: F.xxhash64("k", F.concat(F.substring("r", F.lit(1), i - 1), F.substring(F.col("r"), i + 1, n)))
    variants = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((F.col("o") + i).alias("at"), key(i).alias("v"))))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("k", "r").alias("v")))
    each = blocks.join(firsts.select("h", "g", "first"), ["h", "g"])
    each = written(each.select("h", "g", "first", F.explode(F.concat(F.coalesce(variants, F.array().cast("array<struct<at:int,v:bigint>>")), whole)).alias("x")).select("h", "g", "first", "x.at", "x.v"), "variants")
    deleted, plain = each.where("at > 0"), each.where("at = 0")
    best = F.min(F.struct("first", "h", "g", "at")).alias("best")
    same = deleted.join(deleted.groupBy("at", "v").agg(best, F.count(F.lit(1)).alias("c")).where("c > 1"), ["at", "v"])
    shorter = deleted.join(plain.groupBy("v").agg(best), "v")
    longer = plain.join(deleted.groupBy("v").agg(best), "v")
    cols = ["h", "g", "at", F.col("best.h").alias("bh"), F.col("best.g").alias("bg"), F.col("best.at").alias("bat"), "first", F.col("best.first").alias("was")]
    found = same.select(cols).union(shorter.select(cols)).union(longer.select(cols)).where("was < first").select("h", "g", "at", "bh", "bg", "bat").distinct()
    without = lambda c, at: F.when(F.col(at) == 0, F.col(c)).otherwise(F.concat(F.substring(c, F.lit(1), F.col(at) - 1), F.substring(F.col(c), F.col(at) + 1, F.length(c))))
    own = texts.select("h", "g", "line")
    other = texts.select(F.col("h").alias("bh"), F.col("g").alias("bg"), F.col("line").alias("earlier"))
    near = found.join(own, ["h", "g"]).join(other, ["bh", "bg"]).where(without("line", "at") == without("earlier", "bat")).select("h", "g").distinct()
    near = written(near, "near")
    drop(each)
    return near


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and columns n_lines
    (lines that are not blank) and n_removed; columns of these names that ``docs``
    has already are replaced, all others stay, whatever their names.

    Earlier is the smaller id (null first), then the smaller hash of the text, then
    the place in it. Blank lines, of nothing but ASCII white space, always stay and
    match nothing; lines are parted by line feeds, and a carriage return before one
    is a character like any other. Null counts as empty and stays null; repeated
    rows with the same id and text are one document and lose nothing to each other;
    an empty table gives no rows. ``edits`` other than 0 and 1 is an error."""
    if edits not in (0, 1):
        raise ValueError(f"edits must be 0 or 1, not {edits!r}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    filled = lambda line: F.trim(line, F.lit(BLANK)) != ""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("doc_id"), text_key(body, 3).alias("th"), body.alias("body"))
    lines = rows.select("doc_id", "th", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).where(filled(F.col("line")))
    lines = lines.withColumns({"h": text_key(F.col("line"), 4), "g": text_key(F.col("line"), 5)})
    place = F.struct("doc_id", "th", "pos")
    line = F.col("line")
    placed = written(lines.select("doc_id", "th", "pos", "h", "g", *([_keys(F.lit(0), line, HALVES).alias("keys")] if edits else [])), "lines")
    firsts = placed.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    if edits:
        each = placed.select("h", F.explode("keys").alias("k"))
        shared = _shared(each)
        alike = written(each.join(small(shared), "k", "left_semi").select("h").distinct(), "alike")
        listed = small(alike)
        firsts = written(firsts.join(listed.withColumn("listed", F.lit(True)), "h", "left").where("c > 1 or listed").select("h", "g", "first", "c"), "firsts")
        texts = written(lines.join(listed, "h", "left_semi").select("h", "g", "line").dropDuplicates(["h", "g"]), "alike_lines")
        halves = texts.select("h", "g", F.explode(_cuts(F.lit(0), F.lit(0), line, HALVES)).alias("s")).select("h", "g", "s.*")
        blocks = _narrowed(written(halves.join(small(shared), "k", "left_semi").select("h", "g", "k", "o", "r"), "blocks"))
        near = _near(blocks, texts, firsts)
        all_firsts = firsts
        firsts = written(firsts.join(small(near).withColumn("near", F.lit(True)), ["h", "g"], "left").where("c > 1 or near"), "repeated")
        drop(shared, alike, texts, blocks, near, all_firsts)
    else:
        firsts = written(firsts.where("c > 1").withColumn("near", F.lit(None).cast("boolean")), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    gone = placed.join(small(firsts), ["h", "g"]).where(F.col("near") | ~same)
    gone = written(gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    drop(placed, firsts)
    a, b = rows.alias("a"), gone.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left").select("row", "body", "gone")
    joined = joined.withColumn("every", F.split("body", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("every") - 1), F.col("gone"))
    new = {
        text: F.when(F.col("gone").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(F.transform(left, lambda i: F.col("every")[i]), "\n")),
        "n_lines": F.size(F.filter("every", filled)),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)),
    }
    return joined.select(*[new.pop(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *[c.alias(n) for n, c in new.items()])


def op7_line_dedup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, k as pos, ls[k] as line, length(ls[k]) as n from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as k from d) where regexp_matches(ls[k], '[^\x20\x09-\x0D]')),
u as (select line, n, min({'d': doc_id, 'p': pos}) as f from l group by line, n),
h as (select line, n, f, s, left(line, (s // 2)::bigint) as a, right(line, (s - s // 2)::bigint) as b from (select *, unnest([n, n - 1]) as s from u)),
c as (select x.line as x, y.line as y, x.n as nx, y.n as ny, x.f as fx from h x join h y on x.s = y.s and x.a = y.a and y.f < x.f
      union select x.line, y.line, x.n, y.n, x.f from h x join h y on x.s = y.s and x.b = y.b and y.f < x.f),
e as (select distinct x from c where
      (nx = ny and len(list_filter(range(1, nx + 1), lambda i: x[i] <> y[i])) = 1)
      or (nx = ny + 1 and len(list_filter(range(1, nx + 1), lambda i: left(x, i - 1) || substr(x, i + 1) = y)) > 0)
      or (ny = nx + 1 and len(list_filter(range(1, ny + 1), lambda i: left(y, i - 1) || substr(y, i + 1) = x)) > 0)),
k as (select l.doc_id, l.pos, (l.doc_id = u.f.d and l.pos = u.f.p and e.x is null) as kept
      from l join u on l.line = u.line left join e on l.line = e.x),
m as (select d.doc_id, d.ls, (select list(pos) from k where k.doc_id = d.doc_id and not kept) as gone, (select count(*) from l where l.doc_id = d.doc_id) as n_lines from d)
select doc_id, n_lines, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(list_filter(ls, lambda x, i: not coalesce(list_contains(gone, i), false)), chr(10))) as kept_sha256
from m
"""
