"""Functions of sequences and qualities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain_bases(seq: Column | str) -> Column:
    """Upper case; what is not A, C, G or T becomes N."""
    return F.translate(F.regexp_replace(_c(seq), "[^ACGTacgt]", "N"), "acgt", "ACGT")


def complement(seq: Column | str) -> Column:
    return F.translate(plain_bases(seq), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def count_n(seq: Column | str) -> Column:
    """How many characters are N, in either case."""
    s = F.upper(_c(seq))
    return F.char_length(s) - F.char_length(F.replace(s, F.lit("N")))


def prefix_difference(a: Column | str, b: Column | str) -> Column:
    """How many characters differ up to the shorter end."""
    x, y = F.split(_c(a), ""), F.split(_c(b), "")
    n = F.least(F.char_length(_c(a)), F.char_length(_c(b)))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: (p != q).cast("int")), F.lit(0), lambda t, v: t + v)


def strip_space(text: Column | str) -> Column:
    """Without the white space of C at both ends."""
    return F.regexp_replace(_c(text), r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")


def strip_suffix(name: Column | str, patterns: tuple[str, ...] = ("mu1", "mu2", "sc")) -> Column:
    """Up to the last place of the first pattern that occurs."""
    c = _c(name)
    out = None
    for p in patterns:
        hit = F.regexp_extract(c, f"(?s)^(.*){p}", 1)
        out = F.when(F.instr(c, p) > 0, hit) if out is None else out.when(F.instr(c, p) > 0, hit)
    return out.otherwise(c)


def split_keep_empty(line: Column | str, sep: str = "\t") -> Column:
    return F.split(_c(line), f"[{sep}]", -1)


def split_drop_empty(line: Column | str, seps: str = "\t") -> Column:
    return F.filter(F.split(_c(line), f"[{seps}]", -1), lambda x: x != "")


def snip(seq: Column | str, reverse: Column, start: int, length: int) -> Column:
    """Characters from the 5' end: from the right if the read is on the reverse strand."""
    s = _c(seq)
    return F.when(reverse, F.substr(s, F.greatest(F.char_length(s) - start - length + 1, F.lit(1)), F.least(F.lit(length), F.greatest(F.char_length(s) - start, F.lit(0))))).otherwise(F.substr(s, F.lit(start + 1), F.lit(length)))


def quality_codes(qual: Column | str, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(_c(qual), ""), lambda x: x != ""), lambda x: F.ascii(x) - offset)


def trim_length(qual: Column | str, threshold: int, offset: int = 33) -> Column:
    """How many characters quality trimming leaves: all if the last one is good enough, else up to where the sum of (threshold - quality) from the right is largest, of equal places the rightmost."""
    codes = F.reverse(quality_codes(qual, offset))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(-(2**31)).alias("best"), F.lit(0).alias("cut"))

    def step(a, q):
        s = a.s + (threshold - q)
        return F.struct((a.i + 1).alias("i"), s.alias("s"), F.greatest(a.best, s).alias("best"), F.when(s > a.best, a.i + 1).otherwise(a.cut).alias("cut"))

    good = F.coalesce(F.get(codes, F.lit(0)) >= threshold, F.lit(True))
    return F.char_length(_c(qual)) - F.when(good, 0).otherwise(F.aggregate(codes, zero, step, lambda a: a.cut))


def longest_run_above(qual: Column | str, threshold: int, offset: int = 33) -> Column:
    """The longest run of qualities above the threshold."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, q):
        run = F.when(q > threshold, a.run + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a.best, run).alias("best"))

    return F.aggregate(quality_codes(qual, offset), zero, step, lambda a: a.best)


def edge_run(text: Column | str, char: str, trailing: bool) -> Column:
    """How long the run of a character at one end is."""
    return F.char_length(F.regexp_extract(_c(text), f"(?s)([{char}]*)$" if trailing else f"(?s)^([{char}]*)", 1))


def has_poly_tail(plus: Column | str, minus: Column | str) -> tuple[Column, Column]:
    """At least 5 A in the last 6 bases of one contig, at least 5 T in the first 6 of the other."""
    count = lambda s, b: F.char_length(s) - F.char_length(F.replace(s, F.lit(b)))
    return count(F.right(F.upper(_c(plus)), F.lit(6)), "A") >= 5, count(F.left(F.upper(_c(minus)), F.lit(6)), "T") >= 5


def md_matches(md: Column | str) -> Column:
    """The sum of the match lengths of an MD tag."""
    return F.aggregate(F.regexp_extract_all(_c(md), F.lit(r"(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda t, x: t + x.cast("long"))


def cigar_ops(cigar: Column | str) -> Column:
    """Array of (op, len) of a CIGAR text."""
    parts = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len")))


def is_clipped(ops: Column) -> Column:
    return F.exists(ops, lambda o: o.op.isin("H", "S"))


def has_big_clip(ops: Column, read_len: Column, least: int) -> Column:
    return F.exists(ops, lambda o: (o.op == "S") & (F.least(read_len, o.len) >= least))


def longest_match(ops: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(ops, lambda o: o.op == "M"), lambda o: o.len)), F.lit(0))


def reference_length(ops: Column) -> Column:
    return F.aggregate(ops, F.lit(0), lambda t, o: t + F.when(o.op.isin("M", "D", "N", "=", "X"), o.len).otherwise(0))


def normal_cigar(ops: Column) -> Column:
    """Deletions go; neighbouring matches, a match and what follows that is no soft clip, become one match."""
    zero = F.array().cast("array<struct<op:string,len:int>>")

    def step(acc, o):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.lit("M").alias("op"), (last.len + o.len).alias("len"))))
        return F.when(o.op == "D", acc).when((F.size(acc) > 0) & (last.op == "M") & ~o.op.isin("S", "H"), joined).otherwise(F.concat(acc, F.array(F.struct(o.op.alias("op"), o.len.alias("len")))))

    return F.aggregate(ops, zero, step)


def kept_clip(ops: Column) -> Column:
    """Which end is clipped more: `front`, `back` or null; ties go to the front."""
    first, last = F.try_element_at(ops, F.lit(1)), F.try_element_at(ops, F.lit(-1))
    size = lambda o: F.when(o.op.isin("S", "H"), o.len).otherwise(0)
    f, b = F.coalesce(size(first), F.lit(0)), F.when(F.size(ops) > 1, size(last)).otherwise(0)
    return F.when((f == 0) & (b == 0), None).when(f < b, "back").otherwise("front")


def set_flag(flag: Column, bits: int, on: bool = True) -> Column:
    return flag.bitwiseOR(F.lit(bits)) if on else flag.bitwiseAND(F.bitwise_not(F.lit(bits)))


def alternative_hits(tag: Column | str) -> Column:
    """Array of (chrom, strand, pos, cigar, nm) of an XA tag."""
    hits = F.filter(F.split(F.regexp_replace(_c(tag), "^XA:Z:", ""), ";"), lambda x: x != "")

    def hit(h):
        f = F.split(h, ",")
        signed = f[1].cast("long")
        return F.struct(f[0].alias("chrom"), F.when(F.left(f[1], F.lit(1)) == "-", -1).otherwise(1).alias("strand"), F.abs(signed).alias("pos"), f[2].alias("cigar"), f[3].cast("int").alias("nm"))

    return F.transform(hits, hit)


def clip_position(pos: Column, ops: Column, reverse: Column) -> Column:
    """Where a read is clipped: its position on the plus strand; on the minus one, negative, behind all bases but insertions and soft clips, a leading soft clip included in what does not count."""
    behind = F.aggregate(ops, F.lit(0), lambda t, o: t + F.when(o.op.isin("I", "S"), 0).otherwise(o.len))
    return F.when(reverse & (F.size(ops) > 0), -(pos + behind)).otherwise(pos)


def segments(seq: Column, ops: Column, reverse: Column, least: int) -> Column:
    """The pieces of a read by its CIGAR operations, after matches are merged and deletions and hard clips left out, of at least so many bases, as the sequencer read them."""
    kept = F.filter(normal_cigar(ops), lambda o: o.op != "H")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, o):
        piece = F.substr(seq, a.at + 1, o.len)
        return F.struct((a.at + o.len).alias("at"), F.concat(a.out, F.array(piece)).alias("out"))

    pieces = F.filter(F.aggregate(kept, zero, step, lambda a: a.out), lambda x: F.char_length(x) >= least)
    return F.transform(pieces, lambda x: F.when(reverse, reverse_complement(x)).otherwise(x))


def without_poly_tail(seq: Column | str, base: str, least: int = 5) -> Column:
    """Without the run of `base` at the end if it has at least so many; one other base before a further run is taken for it."""
    s = _c(seq)
    repaired = F.regexp_replace(s, f"(?<=.{base})[^{base}](?={base}*$)", base)
    return F.regexp_replace(repaired, f"{base}{{{least},}}$", "")


def choose_hit(hits: Column, first: Column, mate_pos: Column, apart: Column, left_size: Column, left_at: Column, right_at: Column, spacer: int = 100) -> Column:
    """Which of a read's other places in the region of its mate is right: the position of the first hit that stands `apart` from the mate to within 1, which ends the search; else, in order, a hit of the half in which the place so far stands takes over if it is nearer to that half's breakpoint."""
    zero = F.struct(first.alias("at"), F.lit(False).alias("done"))

    def step(a, h):
        exact = F.abs(F.abs(h - mate_pos) - apart) < 2
        nearer = lambda bp: F.abs(h - bp) < F.abs(a.at - bp)
        left = (a.at < left_size) & (h < left_size) & nearer(left_at)
        right = (a.at > left_size + spacer) & (h > left_size + spacer) & nearer(right_at)
        return F.when(a.done, a).otherwise(F.struct(F.when(exact | left | right, h).otherwise(a.at).alias("at"), exact.alias("done")))

    return F.aggregate(hits, zero, step, lambda a: a.at)


def around_longest_match(ops: Column) -> Column:
    """The first longest match of a CIGAR: its length, and how many bases of the read stand before and after it; null without one."""
    most = longest_match(ops)
    bases = lambda o: F.when(o.op.isin("D", "N", "H", "P"), 0).otherwise(o.len)
    at = F.array_position(F.transform(ops, lambda o: (o.op == "M") & (o.len == most)), True).cast("int")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, o: t + bases(o))
    before, after = F.slice(ops, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(ops, at + 1, F.size(ops))
    return F.when(at > 0, F.struct(most.alias("len"), total(before).alias("before"), total(after).alias("after")))
