"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions alone.

Distinct lines are split into threshold + 1 even segments: of two lines within the threshold one keeps a segment whole.
Segments are indexed by (length, number, content); a line probes the indexes of all lengths from its own down to its
own less the threshold, with the few substrings that can match there. Pairs that meet are verified with banded
bit-parallel edit distance: the band's vertical differences are bits of one whole number, moved along the diagonal.
Components of verified pairs are classes; the first line of a class, by (doc_id, line_no), is the one to keep.

Equal lines are one node, so the number of copies of a line doesn't matter to the join. The lines of an index entry and
those that probe it are dealt into blocks, which are compared block against block by functions of arrays: a pair is
verified where it meets first, links are counted in place, and components of the two blocks are found there, so that
each line gives one row for each two blocks and no pair becomes a row.

Lines of at most threshold characters have no such segments. Against longer lines they are indexed by their characters,
of which a pair within the threshold shares one; among each other all of them are within the threshold, so their links
are counted and their class is tied without a pair.

Defined cases: null and empty texts have no lines; lines without a word are no lines; all lines take part, or where
`shortest` is given, shorter ones only match copies; null doc_ids come last; rows that share a doc_id come in order of a
hash of their texts; rows repeated whole share (doc_id, line_no), so their lines are kept or dropped alike; a very long
text is its lines, and a very long line is split and verified as any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import materialize, small
from .components import connected


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (tells texts of one doc_id apart), line_no (from 0), line: the lines with a word."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "")


def _segment(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """(first character from 1, length) of segment i of k, from 0; the last ones are the longer."""
    base, longer = (length - length % k) / k, length % k
    before = F.greatest(F.lit(0), i - (F.lit(k) - longer))
    return (i * base + before + 1).cast("int"), (base + F.when(i >= F.lit(k) - longer, 1).otherwise(0)).cast("int")


def _probes(threshold: int) -> list[tuple[int, int, int]]:
    """(less, i, shift): segment i of lines shorter by less can match at its place moved by shift.

    Edits before the segment number at most i, those after it at most threshold - i.
    """
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            out += [(less, i, shift) for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)]
    return out


def segment_keys(lines: DataFrame, places: list[tuple[int, int, int]], threshold: int, shortest: int) -> DataFrame:
    """node, i, key: a row for each place of each line that has room for it. Places are a short constant array, so that
    one small expression does for all of them."""
    at = F.explode(F.array(*(F.struct(F.lit(d).alias("less"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d, i, s in places)))
    rows = lines.select("node", "line", "n", at.alias("p")).withColumn("length", F.col("n") - F.col("p.less"))
    first, size = _segment(F.col("length"), F.col("p.i"), threshold + 1)
    rows = rows.withColumn("at", first + F.col("p.shift")).withColumn("size", size)
    rows = rows.where((F.col("length") >= shortest) & (F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n")))
    return rows.select("node", F.col("p.i").alias("i"), F.xxhash64("length", "p.i", F.substring("line", F.col("at"), F.col("size"))).alias("key"))


def character_keys(lines: DataFrame, threshold: int, index: bool) -> DataFrame:
    """node, i, key: of an index the i-th character of each tiny line, else each character of a line at each i."""
    chars = F.split("line", "")
    said = F.posexplode(chars).alias("i", "c") if index else F.explode(F.array_distinct(chars)).alias("c")
    rows = lines.select("node", said)
    rows = rows if index else rows.select("node", F.explode(F.array(*map(F.lit, range(threshold)))).alias("i"), "c")
    return rows.select("node", "i", F.xxhash64(F.lit("character"), "i", "c").alias("key"))


def _let(value: Column, use) -> Column:
    """use of a value that is computed once; written out twice, an expression in a lambda is computed twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of a and b, over the threshold if it is more than that; b isn't longer than a.

    Step j takes the j-th character of b. Bit v of a word is the cell of row j + v - threshold, the rows being a's
    characters; plus and minus hold where a cell is one more or less than the one above it. The band's last row leaves
    a after len(a) - threshold steps; from there on the distance is followed along a's last row.
    """
    chars = lambda s: F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))
    both = lambda r: F.struct(chars(r["x"]).alias("x"), chars(r["y"]).alias("y"), F.length(r["x"]).alias("n"), F.length(r["y"]).alias("m"))
    return _let(_apart(_apart(F.struct(a.alias("x"), b.alias("y")))), lambda r: _let(both(r), lambda p: _walk(p["x"], p["y"], p["n"], p["m"], threshold)))


def _apart(pair: Column) -> Column:
    """x and y without what both begin with, and turned around, so that a second time takes off what both end with. The
    distance stays. Their beginnings are compared in pieces of a power of two characters, the largest first."""
    powers = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))

    def cut(p: Column) -> Column:
        most = F.least(F.length(p["x"]), F.length(p["y"]))
        same = lambda at, n: F.substring(p["x"], at + 1, n) == F.substring(p["y"], at + 1, n)
        shared = lambda m: F.aggregate(powers, F.lit(0), lambda at, n: F.when((at + n <= m) & same(at, n), at + n).otherwise(at))
        rest = lambda s, at: F.reverse(F.substring(s, at + 1, F.length(s)))
        return _let(_let(most, shared), lambda at: F.struct(rest(p["x"], at).alias("x"), rest(p["y"], at).alias("y")))

    return _let(pair, cut)


def _walk(x: Column, y: Column, n: Column, m: Column, threshold: int) -> Column:
    """The steps of edit_distance. What they carry is copied at each of them, so it is three numbers and no text."""
    width = 2 * threshold + 1
    ones = (1 << width) - 1
    start = F.struct(
        F.lit(ones & ~((1 << threshold) - 1)).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"),
        F.least(F.lit(threshold), n).alias("d"),
    )

    def step(s: Column, j: Column) -> Column:
        c = F.get(y, j)
        eq = F.lit(0).cast("long")
        for v in range(width):
            row = j + (v - threshold)
            eq = eq + F.when((row >= 0) & F.coalesce(F.get(x, F.greatest(row, F.lit(0))) == c, F.lit(False)), 1 << v).otherwise(0)
        plus, minus = s["plus"], s["minus"]
        inv = lambda e: F.bitwise_not(e).bitwiseAND(ones)
        # the last row of a stands at bit threshold + (n - 1 - j) once the band has left a
        edge = n - 1 - j + threshold
        at = F.least(F.greatest(edge, F.lit(0)), F.lit(width - 1))
        bit = lambda e: F.call_function("shiftright", e, at).bitwiseAND(1)

        def diagonal(eq: Column) -> Column:
            return (eq.bitwiseAND(plus) + plus).bitwiseXOR(plus).bitwiseOR(eq).bitwiseOR(minus).bitwiseAND(ones)

        def after(diag: Column, right_up: Column) -> Column:
            right_down, moved = diag.bitwiseAND(plus), F.shiftright(diag, 1)
            along_diagonal = F.when(diag.bitwiseAND(1 << (width - 1)) == 0, 1).otherwise(0)
            along_row = bit(right_up) - bit(right_down)
            d = s["d"] + F.when(edge >= width - 1, along_diagonal).otherwise(along_row).cast("int")
            return F.struct(right_down.bitwiseOR(inv(moved.bitwiseOR(right_up))).alias("plus"), moved.bitwiseAND(right_up).alias("minus"), d.alias("d"))

        moved_on = _let(eq, lambda e: _let(diagonal(e), lambda diag: _let(minus.bitwiseOR(inv(diag.bitwiseOR(plus))), lambda up: after(diag, up))))
        # on its way down the band's edge the distance never falls, and at most this much of it can be made good later
        lost = (edge >= width - 1) & (s["d"] > 2 * threshold - (n - m))
        return F.when(lost, s).otherwise(moved_on)

    steps = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    found = F.aggregate(steps, start, step)["d"]
    return F.when(m == 0, n).otherwise(found)


def distinct_lines(docs: DataFrame) -> DataFrame:
    """node, line, n: the distinct lines of docs, in a table."""
    lines = lines_of(docs).groupBy("line").agg(F.count(F.lit(1)).alias("held"))
    return materialize(lines.select(F.monotonically_increasing_id().alias("node"), "line", F.length("line").alias("n")), "lines")


def links(lines: DataFrame, threshold: int = 2, shortest: int = 1, block: int = 256) -> DataFrame:
    """(node, links, peer): verified links counted per node, each with a node of the same class, from each two blocks
    of the lines that meet at a key. Links among tiny lines, which are all within the threshold, aren't among them."""
    whole = max(shortest, threshold + 1)
    index = segment_keys(lines, [(0, i, 0) for i in range(threshold + 1)], threshold, whole)
    probe = segment_keys(lines, _probes(threshold), threshold, whole)
    if shortest <= threshold:
        near = lines.where((F.col("n") > threshold) & (F.col("n") <= 2 * threshold))
        index = index.unionByName(character_keys(tiny(lines, threshold, shortest), threshold, True))
        probe = probe.unionByName(character_keys(near, threshold, False))
    # probes that meet a line other than their own: a row each at most, however many lines they meet
    entry = index.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("held"))
    met = probe.join(entry, "key").where("least != node or last != node")
    met = materialize(met.select("key", "node", "held").distinct(), "line-probes")
    asked = met.groupBy("key").agg(F.first("held").alias("held"), F.count(F.lit(1)).alias("probes"))
    sizes = materialize(asked.select("key", *(F.ceil(F.col(c) / block).cast("int").alias(s) for c, s in (("held", "blocks_a"), ("probes", "blocks_b")))), "line-keys")
    of_a, of_b = index.join(small(sizes), "key"), met.select("key", "node", F.lit(0).alias("i")).join(small(sizes), "key")
    a, b = _in_blocks(of_a, lines, "a", "b"), _in_blocks(of_b, lines, "b", "a")
    # few bytes and much work, so not to be merged into few tasks
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * lines.sparkSession.sparkContext.defaultParallelism)
    both = a.join(b, ["key", "block_a", "block_b"]).repartition(tasks)
    return materialize(_compared(both, threshold), "line-links")


def _in_blocks(rows: DataFrame, lines: DataFrame, side: str, other: str) -> DataFrame:
    """key, block_a, block_b and an array of the side's lines, once for each block of the other side."""
    rows = materialize(rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col(f"blocks_{side}")).cast("int")), f"line-members-{side}")
    rows = lines.join(small(rows), "node")  # few lines meet others, so that the texts of all needn't be shuffled
    rows = rows.groupBy("key", "own", f"blocks_{other}").agg(F.collect_list(F.struct("node", "i", "n", "line", signature(F.col("line")).alias("bits"))).alias(side))
    against = F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)).alias(f"block_{other}")
    return rows.select("key", F.col("own").alias(f"block_{side}"), side, against)


def signature(line: Column) -> Column:
    """64 bits, each whether an odd number of the line's pairs of neighbouring characters hash to it. An edit takes away at
    most two such pairs and adds at most two, so lines within a threshold differ in at most 4 * threshold bits."""
    pair = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(64)).cast("int"))
    at = F.when(F.length(line) > 1, _let(F.split(line, ""), pair)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))


def _near(a: Column, bits: Column, places: Column, threshold: int) -> Column:
    """Those places of bits, signatures of lines, that leave room for a line within the threshold of a."""
    return F.filter(places, lambda j: F.bit_count(F.get(bits, j).bitwiseXOR(a["bits"])) <= 4 * threshold)


def _meet(a: Column, b: Column, i: Column, threshold: int) -> Column:
    """Whether segment i of line a, or where a is tiny its i-th character, stands in b where a probe looks for it."""
    at, size = _segment(a["n"], i, threshold + 1)
    less = b["n"] - a["n"]
    begin = F.greatest(at + F.greatest(-i, less - (F.lit(threshold) - i)), F.lit(1))
    last = at + size - 1 + F.least(i, less + (F.lit(threshold) - i))
    held = F.contains(F.substring(b["line"], begin, last - begin + 1), F.substring(a["line"], at, size))
    return F.when(a["n"] <= threshold, F.contains(b["line"], F.substring(a["line"], i + 1, F.lit(1)))).otherwise(held)


def _linked(a: Column, b: Column, threshold: int) -> Column:
    """Whether a pair is within the threshold, and meets here first of all keys; conditions are in order of their cost."""
    ok = ((a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["node"] < b["node"]))) & (b["n"] - a["n"] <= threshold)
    ok = ok & _meet(a, b, a["i"], threshold)
    for i in range(threshold):
        ok = ok & ~((a["i"] > i) & _meet(a, b, F.lit(i), threshold))
    return ok & _enough_blocks(a["line"], b["line"], threshold) & (edit_distance(b["line"], a["line"], threshold) <= threshold)


def _compared(blocks: DataFrame, threshold: int) -> DataFrame:
    """node, links, peer from two arrays of lines, a and b."""
    places = F.sequence(F.lit(0), F.size("b") - 1)
    # nearly all pairs end at one comparison of two numbers; texts are only looked into where signatures are near
    linked = lambda x, bits, js: F.filter(_near(x, bits, js, threshold), lambda j: _linked(x, F.get(F.col("b"), j), threshold))
    hits = _let(F.struct(F.col("b.bits").alias("bits"), places.alias("js")), lambda b: F.transform("a", lambda x: linked(x, b["bits"], b["js"])))

    def joined(label: Column, own: Column) -> Column:
        """Labels of b's lines once those of own, the lines that one of a is linked to, are the least of them."""
        return _let(F.array_distinct(F.transform(own, lambda j: F.get(label, j))), lambda held: _let(F.array_min(held), lambda m: F.transform(label, lambda v: F.when(F.array_contains(held, v), m).otherwise(v))))

    def rows(h: Column) -> Column:
        labels = F.aggregate(h, places, lambda label, own: F.when(F.size(own) > 1, joined(label, own)).otherwise(label))
        known = lambda at, n, label: F.struct(at["node"].alias("node"), n.cast("long").alias("links"), F.get(F.col("b"), label)["node"].alias("peer"))

        def each(label: Column) -> Column:
            of_a = F.transform("a", lambda x, k: _let(F.get(h, k), lambda own: known(x, F.size(own), F.get(label, F.coalesce(F.get(own, F.lit(0)), F.lit(0))))))
            of_b = F.transform("b", lambda y, j: known(y, F.size(F.filter(h, lambda own: F.array_contains(own, j.cast("int")))), F.get(label, j)))
            return F.filter(F.concat(of_a, of_b), lambda r: r["links"] > 0)

        return _let(labels, each)

    return blocks.select(F.explode(_let(hits, rows)).alias("r")).select("r.*")


def tiny(lines: DataFrame, threshold: int, shortest: int) -> DataFrame:
    """The lines that are too short for segments; any two of them are within the threshold."""
    return lines.where((F.col("n") >= shortest) & (F.col("n") <= threshold))


def _enough_blocks(a: Column, b: Column, threshold: int, blocks: int = 8) -> Column:
    """Whether enough even blocks of a stand in b, moved by at most threshold: an edit spoils one block, so of lines
    within the threshold all but that many do. It costs little and leaves few pairs to verify that don't match."""
    n = F.length(a)
    held = F.lit(0)
    for i in range(blocks):
        at, size = _segment(n, F.lit(i), blocks)
        begin = F.greatest(at - threshold, F.lit(1))
        near = F.substring(b, begin, at + size + threshold - begin)
        held = held + F.contains(near, F.substring(a, at, size)).cast("int")
    return held >= blocks - threshold


def classes(docs: DataFrame, threshold: int = 2, shortest: int = 1, block: int = 256) -> DataFrame:
    """A row per line with a word: doc_id, line_no, class_doc_id and class_line_no (the first line of its class),
    n_links (different lines within the threshold), kept (whether it is that first line)."""
    return _classes(docs, threshold, shortest, block).drop("text_key")


def _classes(docs: DataFrame, threshold: int, shortest: int, block: int = 256) -> DataFrame:
    lines = distinct_lines(docs)
    found = links(lines, threshold, shortest, block)
    both = found.select("node", "links")
    ties = found.select("node", "peer")
    shorts = tiny(lines, threshold, shortest)
    many, least = shorts.agg(F.count(F.lit(1)), F.min("node")).first()
    if many > 1:
        both = both.unionByName(shorts.select("node", F.lit(many - 1).cast("long").alias("links")))
        ties = ties.unionByName(shorts.where(F.col("node") != least).select("node", F.lit(least).cast("long").alias("peer")))
    roots = connected(ties, "node", "peer")
    linked = both.groupBy("node").agg(F.sum("links").alias("n_links")).join(roots, "node")
    linked = lines.select("node", *_name("line")).join(small(linked), "node").select("name", "name_too", "root", "n_links")
    rows = lines_of(docs).select("doc_id", "text_key", "line_no", *_name("line"))
    # a line without links is a class of its own, known by its name
    rows = rows.join(small(linked), ["name", "name_too"], "left")
    tied = F.col("root").isNotNull()
    rows = rows.select("doc_id", "text_key", "line_no", tied.alias("tied"), F.coalesce("root", "name").alias("x"), F.when(tied, 0).otherwise(F.col("name_too")).alias("y"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = materialize(rows, "line-rows")
    first = rows.groupBy("tied", "x", "y").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line_no")).alias("first"))
    lead = [F.col("doc_id").eqNullSafe(F.col("first.doc_id"))] + [F.col(c) == F.col(f"first.{c}") for c in ("text_key", "line_no")]
    return rows.join(first, ["tied", "x", "y"]).select(
        "doc_id", "text_key", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").cast("long").alias("class_line_no"), "n_links",
        (lead[0] & lead[1] & lead[2]).alias("kept"),
    )


def _name(line: str) -> tuple[Column, Column]:
    """128 bits that stand for a line."""
    return F.xxhash64(line).alias("name"), F.xxhash64(F.lit("line"), line).alias("name_too")


def deduplicate(docs: DataFrame, threshold: int = 2, shortest: int = 1) -> DataFrame:
    """doc_id and text of each row of docs, without the lines that repeat an earlier line of any document.

    Lines without words stay. Rows that share a doc_id, or have none, are told apart by their text.
    """
    found = _classes(docs, threshold, shortest).where("not kept").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("drop"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = found.select(F.col("doc_id").alias("of"), "text_key", "drop")
    here = F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("text_key"))
    gone = rows.join(found, here, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains(F.col("drop"), i.cast("long")), F.lit(False)))
    return gone.select("doc_id", F.array_join(kept, "\n").alias("text"))
