"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Each distinct line is parted into threshold + 1 segments. Lines within the threshold share one of them unchanged, at places
that differ by no more than the edits allow, so an index of (length, segment number, segment) is probed with the substrings
of every line at those places, for its own length and the shorter ones. Only keys that meet go on. A line is
near as soon as one earlier line is within the threshold, so pairs are never spelled out: each line is compared with the
earliest lines of its keys first, and what these leave undecided looks for any other earlier line in semi-joins, in blocks
where a key is hot. Letter counts, which an edit changes by two at most in all, are compared first; what is left is verified
with the banded bit-parallel edit distance: the column of the band that the threshold leaves is one small integer, and a
line's characters are folded over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Letters whose counts, modulo 16, are compared before the texts are.
COUNTED = "eaionrst"


def segment(n: Column, i: int, tau: int) -> tuple[Column, Column]:
    """First character (from 1) and length of segment i of a line of n characters: the last ones are one longer."""
    k = tau + 1
    base, long = ((n - n % k) / k).cast("int"), n % k
    return 1 + i * base + F.greatest(F.lit(0), i - (k - long)), base + F.when(i >= k - long, 1).otherwise(0)


def piece(start: Column, size: Column) -> Column:
    """Characters of the line from `start` (from 1): `wide` has four bytes for each, so no scan looks for them."""
    return F.substring(F.col("wide"), 4 * start - 3, 4 * size)


def keys(tau: int) -> Column:
    """Keys of a line: for each length down to n - tau, each segment and each shift that tau edits can give a match.

    The first tau + 1 are those of its own segments, by which it is found. In a line of more than 2 * tau characters all
    these places lie inside; that spares conditions, which would make the generated code too long to be compiled.
    """
    own, other = [], []
    for short in range(tau + 1):
        length = F.col("n") - short
        for i in range(tau + 1):
            start, size = segment(length, i, tau)
            for shift in range(max(-i, short - (tau - i)), min(i, short + (tau - i)) + 1):
                (other if short or shift else own).append(F.xxhash64(length, F.lit(i), piece(start + shift, size)))
    return F.array(*own, *other)


def letters_of(line: str) -> Column:
    """Eight letter counts modulo 16 in an integer."""
    out = F.lit(0)
    for k, c in enumerate(COUNTED):
        n = F.length(line) - F.length(F.replace(F.col(line), F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((n % 16).cast("int"), 4 * k))
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """At most the sum of the differences of the counts; one edit changes it by two at most."""
    out = F.lit(0)
    for k in range(len(COUNTED)):
        d = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        out = out + F.least(d, 16 - d)
    return out


def common(a: Column, b: Column, steps: int, tail: bool) -> Column:
    """How many characters at the start, or at the end, are the same, by bisection over powers of two."""
    most, cut = F.least(F.length(a), F.length(b)), F.right if tail else F.left
    powers = F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)])
    return F.aggregate(powers, F.lit(0), lambda have, s: F.when((have + s <= most) & (cut(a, have + s) == cut(b, have + s)), have + s).otherwise(have))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two arrays of characters, a no shorter than b; right up to tau, above it only known to be
    above. Both must begin with tau equal characters."""
    full, top = (1 << (2 * tau + 1)) - 1, 1 << (2 * tau)

    def step(s, i):
        x = F.lit(0)
        for d in range(-tau, tau + 1):
            hit = F.when(i + d >= 0, F.get(a, i + d) == F.get(b, i))
            x = x.bitwiseOR(F.when(hit, 1 << (d + tau)).otherwise(0))

        def column(x):
            vp, vn = s["vp"], s["vn"]
            d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def after(d0):
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
                hn = d0.bitwiseAND(vp)
                diagonal = F.when(d0.bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)
                across = F.when(hp.bitwiseAND(s["mask"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(s["mask"]) != 0, 1).otherwise(0)
                slant = i < F.size(a) - tau
                down = F.shiftrightunsigned(d0, 1)
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                    (s["dist"] + F.when(slant, diagonal).otherwise(across)).alias("dist"), F.when(slant, s["mask"]).otherwise(F.shiftrightunsigned(s["mask"], 1)).alias("mask"),
                )

            return let(d0, after)

        # the bottom row's distance sinks by one for each character left at most, so a large one is settled
        settled = s["dist"] - F.greatest(F.lit(0), F.size(b) - F.greatest(i, F.size(a) - tau)) > tau
        return F.when(settled, s).otherwise(let(x, column))

    ints = F.struct(F.lit((full << tau) & full).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("dist"), F.lit(top >> 1).alias("mask"))
    return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), ints, step, lambda s: s["dist"])


def distance(u: Column, v: Column, tau: int, steps: int = 20) -> Column:
    """Banded distance of two strings, u no shorter than v, after their common start and end are taken off."""

    def pair(a, b):
        return F.struct(a.alias("u"), b.alias("v"))

    def behind(p):
        return let(common(p["u"], p["v"], steps, False) + 1, lambda k: pair(F.substring(p["u"], k, F.length(p["u"])), F.substring(p["v"], k, F.length(p["v"]))))

    def within(p):
        mark = F.lit("#" * tau)
        chars = lambda x, k: F.split(F.concat(mark, F.substring(x, F.lit(1), F.length(x) - k)), "")
        return let(common(p["u"], p["v"], steps, True), lambda k: pair(chars(p["u"], k), chars(p["v"], k)))

    return let(let(let(pair(u, v), behind), within), lambda p: banded_distance(p["u"], p["v"], tau))


def alike(x: Column, y: Column, tau: int) -> Column:
    """Whether two lines are within tau edits."""
    ordered = F.when(F.length(x) >= F.length(y), distance(x, y, tau)).otherwise(distance(y, x, tau))
    return (F.abs(F.length(x) - F.length(y)) <= tau) & (ordered <= tau)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, line, r1, r2 of the lines that are not blank."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    return lines.select("id", "pos", "line", F.xxhash64("line").alias("r1"), F.xxhash64(F.lit(1), "line").alias("r2"))


def near_by_leaders(members: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """r of the lines that are near the earliest line that one of their keys brings them together with, if it is earlier.

    Of each key two lines lead, the earliest of its entries and the earliest of all; so no more pairs are made than members.
    """
    order = F.struct("f", "r")
    leaders = members.groupBy("key").agg(F.min(F.when(F.col("entry"), order)).alias("e"), F.min(order).alias("p"))
    met = members.join(leaders, "key").withColumn("lead", F.when(F.col("entry"), F.col("p")).otherwise(F.col("e")))
    pairs = met.filter("lead.f < f").select("r", F.col("lead.r").alias("lead")).distinct()
    mine, theirs = texts.select("r", F.col("line").alias("x"), F.col("c").alias("cx")), texts.select(F.col("r").alias("lead"), F.col("line").alias("y"), F.col("c").alias("cy"))
    close = letters_apart(F.col("cx"), F.col("cy")) <= 2 * tau
    return pairs.join(mine, "r").join(theirs, "lead").filter(close & alike(F.col("x"), F.col("y"), tau)).select("r").distinct()


def near_by_search(members: DataFrame, near: DataFrame, texts: DataFrame, tau: int, hot: int) -> DataFrame:
    """r of those not in near that have any earlier line within tau edits by one of their keys.

    A semi-join by letter counts alone comes first, so that only lines that may be near bring their text. The lines that
    look for another are dealt to blocks of about `hot` in each key, and the lines that are looked up go to each block.
    """
    seen = texts.select("r", "c")
    late = stored(members.join(near, "r", "left_anti").join(seen, "r"), "line-late")
    sizes = late.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / hot).alias("blocks"))
    late = late.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("r"), F.col("blocks"))).drop("blocks")
    early = members.join(seen, "r").join(sizes, "key")
    early = early.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks")
    one, two = late.alias("l"), early.alias("e")
    same = (F.col("l.key") == F.col("e.key")) & (F.col("l.block") == F.col("e.block")) & (F.col("l.entry") | F.col("e.entry")) & (F.col("e.f") < F.col("l.f"))
    by_letters = letters_apart(F.col("l.c"), F.col("e.c")) <= 2 * tau
    may = stored(one.join(two, same & by_letters, "left_semi"), "line-may")
    lines = texts.select("r", "line")
    one, two = may.join(lines, "r").alias("l"), early.join(may.select("key", "block").distinct(), ["key", "block"], "left_semi").join(lines, "r").alias("e")
    return one.join(two, same & by_letters & alike(F.col("l.line"), F.col("e.line"), tau), "left_semi").select("r").distinct()


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, least_chars: int = 20, hot: int = 2000, id_limit: int = 1_000_000) -> DataFrame:
    """One row per line that is not blank: id, pos (from 0), first (the line's first appearance), near (an earlier line is
    within tau edits), kept (first and not near).

    Lines are parted at line feeds and trimmed of spaces. Order is by (id, pos). Two lines are near if both have least_chars
    characters or more (2 * tau + 1 at least) and their edit distance is at most tau: least_chars is part of what near means, since a few edits
    make any short line of any other; those are compared for equality. Lines are told apart by 128 bits of hashes. Each
    distinct line enters the join once. `hot` is the size of a block of lines that share a key, and decides nothing.
    """
    lines = lines_of(docs, id_col, text_col)
    distinct = lines.groupBy("r1", "r2").agg(F.min(F.struct("id", "pos")).alias("f"), F.min("line").alias("line"))
    distinct = distinct.withColumn("wide", F.encode("line", "UTF-32")).withColumn("n", (F.length("wide") / 4).cast("int"))
    table = stored(distinct.select("r1", "r2", "f", (F.col("n") >= max(least_chars, 2 * tau + 1)).alias("long"), keys(tau).alias("keys")), "line-keys")
    rows = table.filter("long").select(F.col("r1").alias("r"), F.posexplode("keys").alias("k", "key")).select("key", "r", (F.col("k") <= tau).alias("entry"))
    of_key, of_entry = W.partitionBy("key"), F.when(F.col("entry"), F.col("r"))
    ends = {"lo": F.min("r").over(of_key), "hi": F.max("r").over(of_key), "entry_lo": F.min(of_entry).over(of_key), "entry_hi": F.max(of_entry).over(of_key)}
    meets = F.when(F.col("entry"), (F.col("lo") != F.col("r")) | (F.col("hi") != F.col("r"))).otherwise((F.col("entry_lo") != F.col("r")) | (F.col("entry_hi") != F.col("r")))
    members = stored(rows.withColumns(ends).filter(meets).select("key", "r", "entry"), "line-members")
    ids = stored(members.select("r").distinct(), "line-ids")
    some = ids.count()
    if some:
        side = F.broadcast(ids) if some <= id_limit else ids  # broadcast only below a checked count
        texts = lines.select(F.col("r1").alias("r"), "r2", "line").join(side, "r", "left_semi").distinct()
        texts = texts.join(table.select(F.col("r1").alias("r"), "r2", "f"), ["r", "r2"]).withColumn("c", letters_of("line"))
        texts = stored(texts, "line-texts")
        members = stored(members.join(texts.select("r", "f"), "r"), "line-ordered")
        near = stored(near_by_leaders(members, texts, tau), "line-near")
        near = stored(near.unionByName(near_by_search(members, near, texts, tau, hot)), "line-near-all")
        late = near.join(texts.select("r", "r2"), "r").select(F.col("r").alias("r1"), "r2", F.lit(True).alias("near"))
        verdicts = table.select("r1", "r2", "f").join(late, ["r1", "r2"], "left")
    else:
        verdicts = table.select("r1", "r2", "f", F.lit(False).alias("near"))
    out = lines.select("id", "pos", "r1", "r2").join(verdicts, ["r1", "r2"])
    first = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("pos") == F.col("f.pos"))
    return out.select("id", "pos", first.alias("first"), F.coalesce("near", F.lit(False)).alias("near")).withColumn("kept", F.col("first") & ~F.col("near"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_lines, n_repeated (lines seen before), n_near (first of their wording, but an earlier
    line is near), n_kept, dropped (places of the lines that go, in order).

    See line_verdicts() for what is near. Null, empty and blank texts have no lines. Documents with a null id are read as
    one whose lines come first; rows repeated with one id are read as one document whose lines of the same place and wording
    share a verdict, and give one row. An empty table gives an empty result. Other columns are not read.
    """
    v = line_verdicts(docs, id_col, text_col, **options)
    per = v.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~F.col("first")).alias("n_repeated"), F.count_if(F.col("first") & F.col("near")).alias("n_near"),
        F.count_if("kept").alias("n_kept"), F.array_sort(F.array_distinct(F.collect_list(F.when(~F.col("kept"), F.col("pos"))))).alias("dropped"),
    )
    ids = docs.select(F.col(id_col).alias("__id")).distinct()
    out = ids.join(per, F.col("__id").eqNullSafe(F.col("id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_lines", "n_repeated", "n_near", "n_kept")]
    return out.select(F.col("__id").alias(id_col), *zero, F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def cleaned(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text without the lines that go; blank lines stay."""
    lines = F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x, i: ~F.array_contains("__dropped", i))
    d = verdict.select(F.col(id_col).alias("__id"), F.col("dropped").alias("__dropped"))
    joined = docs.join(d, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn("__dropped", F.coalesce("__dropped", F.array().cast("array<int>")))
    return joined.select(F.col(id_col), F.array_join(lines, "\n").alias("text"))


def op8_line_dedup(spark, sf_dir):
    from .common import read

    return line_dedup(read(spark, sf_dir, "documents"))
